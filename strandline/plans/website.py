"""From numbers to websites: fusion of the sources, choice of a URL, and combination of the results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import fuzzy, texts, urls
from strandline.operators.relational import best_with_ties

# Fixed values.
STRUCTURED_HEADS = ("com", "co", "net", "org", "gov", "edu", "ac", "mil", "ne", "or")


def with_public_suffix(df: DataFrame, host: str, suffixes: DataFrame, suffix: str = "suffix") -> DataFrame:
    """Adds public_suffix: the longest listed suffix of the host, null if none is listed."""
    from strandline.operators.relational import suffix_join

    listed = suffixes.select(F.col(suffix).alias("public_suffix"))
    return suffix_join(df, host, listed, "public_suffix", urls.suffixes)


def sld_label(host: Column, suffix: Column) -> Column:
    """Grouping label: the one left of a suffix such as co.za or of a plain one; for other country suffixes of two labels
    (lviv.ua) the suffix's own first label."""
    parts, own = F.split(host, "\\."), F.split(suffix, "\\.")
    n, k = F.size(parts), F.size(own)
    two_level = (k >= 2) & (F.length(F.element_at(own, -1)) == 2)
    structured = F.get(own, F.lit(0)).isin(*STRUCTURED_HEADS)
    left = F.when(n >= k + 1, F.get(parts, n - k - 1))
    return F.when(n < 2, F.lit(None).cast("string")).when(suffix.isNotNull() & two_level & structured, left).otherwise(F.get(parts, n - 2))


def registrable(host: Column, suffix: Column) -> Column:
    """Suffix and the label left of it; without a listed suffix the host."""
    n = F.size(F.split(suffix, "\\."))
    return F.when(suffix.isNotNull() & (F.size(F.split(host, "\\.")) > n), F.array_join(F.slice(F.split(host, "\\."), F.size(F.split(host, "\\.")) - n, n + 1), ".")).otherwise(host)


def operational(lifetimes: DataFrame, asn: str, end: str, day: str, months: int = 12) -> DataFrame:
    """Numbers whose last life ended within ``months`` before ``day`` or later."""
    cutoff = F.add_months(F.lit(day).cast("date"), -months)
    return lifetimes.groupBy(asn).agg(F.max(end).alias("last")).where(F.col("last") >= cutoff).select(asn)


def gathered(registry: DataFrame, whois: DataFrame, peering: DataFrame, located: DataFrame, info: DataFrame, national: DataFrame, preferred: str = "apnic") -> tuple[DataFrame, DataFrame]:
    """What all sources say about the numbers of a registry: (asn, domain, source; asn, as_name, org_name).

    registry: asn, rir; whois: rir, asn, domains; peering: asn, websites; located: asn, domain; info, national: (rir,) asn, as_name,
    org, descr. A number takes the whois record of its own registry. Names come from ``info`` of its registry, for ``preferred``
    from the national registry where that has the number.
    """
    from strandline.operators.registry import name_pair

    own = registry.select("asn", "rir")
    rows = own.join(whois.select("rir", "asn", "domains"), ["rir", "asn"], "left").join(peering.select("asn", "websites"), "asn", "left").join(located.select("asn", F.col("domain").alias("ip_domain")), "asn", "left")
    said = lambda values, source: F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(urls.clean_host_first(v).alias("domain"), F.lit(source).alias("source")))
    all_said = F.concat(said(F.col("domains"), "whois"), said(F.col("websites"), "peering"), said(F.array_compact(F.array("ip_domain")), "ip"))
    domains = rows.select("asn", F.explode(all_said).alias("s")).select("asn", "s.domain", "s.source").where("domain is not null").distinct()
    of = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") if c not in ("asn", "rir") else F.col(c) for c in df.columns))
    met = own.join(of(info, "i"), ["rir", "asn"], "left").join(of(national, "n").withColumn("n_has", F.lit(True)), "asn", "left")
    use = (F.col("rir") == preferred) & F.col("n_has").isNotNull()
    pick = lambda c: F.when(use, F.col(f"n_{c}")).otherwise(F.col(f"i_{c}"))
    return domains, met.select("asn", name_pair(pick("as_name"), pick("org"), pick("descr")).alias("p")).select("asn", "p.*")


def fuse(candidates: DataFrame, names: DataFrame) -> DataFrame:
    """``candidates``: asn, domain, source, sld; ``names``: asn, as_name, org_name. Returns asn, domains, sources (map).

    With one label all its domains stay. With several, those in the list of mail and registry domains go, and the labels
    closest to the two names stay, ties included.
    """
    rows = candidates.where(F.col("domain").isNotNull()).distinct()
    labels = rows.groupBy("asn").agg(F.countDistinct("sld").alias("labels"))
    rows = rows.join(labels, "asn")
    torn = rows.where((F.col("labels") > 1) & ~F.col("domain").isin(*urls.MAIL_DOMAINS))
    pairs = torn.select("asn", "sld").distinct().join(names, "asn", "left").select("asn", "sld", F.coalesce("as_name", F.lit("")).alias("as_name"), F.coalesce("org_name", F.lit("")).alias("org_name"))
    best = fuzzy.best_names(pairs, "asn", "sld", "as_name", "org_name").select("asn", "sld")
    kept = rows.where("labels <= 1").select("asn", "domain", "source").unionByName(torn.join(best, ["asn", "sld"]).select("asn", "domain", "source"))
    by_domain = kept.groupBy("asn", "domain").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return by_domain.groupBy("asn").agg(F.array_sort(F.collect_set("domain")).alias("domains"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("domain", "sources")))).alias("sources"))


def choose_probe(probes: DataFrame, key: str, status: str, position: str) -> DataFrame:
    """The first accessible row of a key by position, else the first blocked one."""
    from strandline.operators.relational import first_by_class

    rank = F.when(urls.is_accessible(F.col(status)), 0).when(urls.is_blocked(F.col(status)), 1)
    return first_by_class(probes, key, rank, position)


def combine(scope: DataFrame, center: DataFrame, search: DataFrame, imputed: DataFrame) -> DataFrame:
    """asn, url, origin, accessible, note: web search before center before imputed.

    center: asn, original, final, sources; search: asn, answer; imputed: asn, url. Answers that say "no match", that are no
    answers or that point to a registry's own site count as none.
    """
    answer = urls.trim_tail(urls.first_url(F.col("answer")))
    usable = ~texts.is_no_match(F.col("answer")) & ~texts.is_unusable(F.col("answer")) & ~urls.under_any(answer, urls.REGISTRY_DOMAINS)
    s = search.select("asn", F.when(usable, answer).alias("s_url"))
    c = center.select("asn", urls.classify_redirect(F.col("original"), F.col("final")).alias("c"))
    i = imputed.select("asn", F.col("url").alias("i_url"))
    rows = scope.join(s, "asn", "left").join(c, "asn", "left").join(i, "asn", "left")
    url = F.coalesce("s_url", "c.url", "i_url")
    origin = F.when(F.col("s_url").isNotNull(), "web_search").when(F.col("c.url").isNotNull(), "center").when(F.col("i_url").isNotNull(), "imputed").otherwise("none")
    ok = F.when(origin == "center", F.col("c.accessible")).when(url.isNotNull(), True)
    return rows.select("asn", url.alias("url"), origin.alias("origin"), ok.alias("accessible"), F.when(origin == "center", F.col("c.note")).alias("note"))


def best_url(urls_: DataFrame, key: str, url: str, name: str, org: str) -> DataFrame:
    """The URL closest to both names; of equals the smallest."""
    scored = fuzzy.best_names(urls_, key, url, name, org)
    return best_with_ties(scored, key, "score").groupBy(key).agg(F.min(url).alias(url), F.first("score").alias("score"))
