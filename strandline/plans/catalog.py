"""Registered queries: each applies operators of the library to the driver tables; ``ORACLES`` has DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import fuzzy, texts, urls
from strandline.operators import crawl, quality, registry, relational, routing
from strandline.plans import website

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: DuckDB text of the host of pages.url.
HOST = "lower(regexp_replace(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1), ':[0-9]*$', ''))"
NO_WWW = f"regexp_replace({HOST}, '^www\\.', '')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pages_with_host(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").withColumn("host", urls.host(F.col("url"), strip_www=True))


# Sites and pages


@query(f"""
SELECT host, url AS landing_url, n_pages, n_bytes, rk::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY host ORDER BY root DESC, size DESC, url DESC, page_id DESC) AS rk FROM (
    SELECT page_id, url, {NO_WWW} AS host, length(html) AS size, count(*) OVER (PARTITION BY {NO_WWW}) AS n_pages, (sum(length(html)) OVER (PARTITION BY {NO_WWW}))::BIGINT AS n_bytes,
           regexp_matches(lower(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)), '^/*(index|index\\.html|index\\.htm|home|default\\.aspx|default\\.html)?/*$') AS root FROM pages))
WHERE rk = 1""")
def landing_pick(spark: SparkSession, d: str) -> DataFrame:
    """Each site's pages and bytes with its landing page."""
    pages = pages_with_host(spark, d).select("host", "url", "page_id", F.length("html").alias("size"))
    order = [urls.is_root_like(F.col("url")), F.col("size"), F.col("url"), F.col("page_id")]
    first = relational.argmax_by(pages, "host", order, {"n_pages": F.count("*"), "n_bytes": F.sum("size")})
    return first.select("host", F.col("url").alias("landing_url"), "n_pages", "n_bytes", F.lit(1).alias("rank"))


@query(f"""
SELECT domain, host, n_pages, n_bytes FROM (
  SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n_pages DESC, n_bytes DESC, host DESC) AS rk FROM (
    SELECT regexp_extract({NO_WWW}, '([^.]+\\.[^.]+)$', 1) AS domain, {NO_WWW} AS host, count(*) AS n_pages, sum(length(html))::BIGINT AS n_bytes FROM pages GROUP BY ALL)) WHERE rk = 1""")
def winner_site(spark: SparkSession, d: str) -> DataFrame:
    """The host that wins a registered domain."""
    pages = pages_with_host(spark, d).withColumn("domain", urls.rough_domain(F.col("url"))).withColumn("size", F.length("html"))
    return crawl.winner_site(pages, "domain", "host", "size").select("domain", "host", F.col("pages").alias("n_pages"), F.col("bytes").alias("n_bytes"))


@query(f"SELECT regexp_extract({NO_WWW}, '([^.]+\\.[^.]+)$', 1) AS domain, count(DISTINCT {NO_WWW}) AS sites FROM pages GROUP BY 1 HAVING sites > 1")
def conflict_stats(spark: SparkSession, d: str) -> DataFrame:
    """Domains with several hosts."""
    return crawl.conflicts(pages_with_host(spark, d).withColumn("domain", urls.rough_domain(F.col("url"))), "domain", "host")


@query(f"""
SELECT page_id, {HOST} AS host, {NO_WWW} AS key, regexp_extract({NO_WWW}, '([^.]+\\.[^.]+)$', 1) AS domain,
       lower(regexp_replace(regexp_replace(url, '^(?i)https?://', ''), '/+$', '')) AS url_key,
       regexp_matches(lower(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)), '^/*(index|index\\.html|index\\.htm|home|default\\.aspx|default\\.html)?/*$') AS is_root,
       len(list_distinct(['https://' || c, 'https://www.' || c, 'http://' || c, 'http://www.' || c])) AS n_variants, 'https://' || c AS first_variant
FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\\.', ''), '/+$', '') AS c FROM pages)""")
def url_functions(spark: SparkSession, d: str) -> DataFrame:
    """Forms of a URL."""
    u = F.col("url")
    forms = urls.variants(urls.clean_host_first(u))
    return table(spark, d, "pages").select(
        "page_id", urls.host(u).alias("host"), urls.website_key(u).alias("key"), urls.rough_domain(u).alias("domain"), urls.url_key(u).alias("url_key"),
        urls.is_root_like(u).alias("is_root"), F.size(forms).cast("long").alias("n_variants"), forms[0].alias("first_variant"),
    )


@query(f"""
WITH t AS (SELECT DISTINCT regexp_extract({NO_WWW}, '([^.]+\\.[^.]+)$', 1) AS target FROM pages UNION SELECT DISTINCT {NO_WWW} FROM pages WHERE {NO_WWW} LIKE 'blog.%'),
h AS (SELECT page_id, {NO_WWW} AS host FROM pages)
SELECT page_id, host, (SELECT arg_max(target, length(target)) FROM t WHERE host = target OR ends_with(host, '.' || target)) AS target FROM h""")
def suffix_join(spark: SparkSession, d: str) -> DataFrame:
    """Hosts with their longest suffix among two-label targets and blogs."""
    pages = pages_with_host(spark, d)
    targets = pages.select(urls.rough_domain(F.col("url")).alias("target")).union(pages.where("host like 'blog.%'").select("host"))
    return relational.suffix_join(pages.select("page_id", "host"), "host", targets, "target", urls.suffixes)


@query(f"""
WITH p AS (SELECT page_id, url, {NO_WWW} AS host, regexp_extract({NO_WWW}, '([^.]+\\.[^.]+)$', 1) AS domain, lower(regexp_replace(regexp_replace(url, '^(?i)https?://', ''), '/+$', '')) AS k FROM pages),
a AS (SELECT k, min('page ' || page_id) AS v FROM p WHERE contains(url, 'utm_source') GROUP BY 1), b AS (SELECT host, min('host ' || page_id) AS v FROM p WHERE contains(url, '.html') GROUP BY 1),
c AS (SELECT domain, min('domain ' || page_id) AS v FROM p WHERE contains(url, '#') GROUP BY 1)
SELECT page_id, coalesce(a.v, b.v, c.v, 'Unknown_ASN') AS owner FROM p LEFT JOIN a USING (k) LEFT JOIN b USING (host) LEFT JOIN c USING (domain)""")
def fallback_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The first hit among URL, host and domain tables."""
    p = pages_with_host(spark, d).select("page_id", "url", "host", urls.rough_domain(F.col("url")).alias("domain"), urls.url_key(F.col("url")).alias("k"))
    part = lambda mark, c, w: p.where(F.contains("url", F.lit(mark))).select(F.col(c).alias("on"), F.concat(F.lit(w), F.col("page_id")).alias("v"))
    lookups = [(F.col("k"), part("utm_source", "k", "page "), "on", "v"), (F.col("host"), part(".html", "host", "host "), "on", "v"), (F.col("domain"), part("#", "domain", "domain "), "on", "v")]
    return relational.fallback_lookup(p, lookups, "owner", "Unknown_ASN").select("page_id", "owner")


_STRIP = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r\n\f]+', ' ', 'g'))"""


@query(f"SELECT page_id, length(t) AS n_chars, sha256(t) AS text_sha256, CASE WHEN length(t) >= 120 THEN 'accept' WHEN length(t) >= 60 THEN 'wait' ELSE 'reject' END AS gate, floor(length(t) / 2.5)::BIGINT AS n_tokens FROM (SELECT page_id, {_STRIP} AS t FROM pages)")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    """Page text, its length class and token estimate."""
    rows = table(spark, d, "pages").select("page_id", "html", texts.strip_html(F.col("html")).alias("t"))
    n = F.length("t")
    gate = F.when(n >= 120, "accept").when(n >= 60, "wait").otherwise("reject")
    return rows.select("page_id", n.cast("long").alias("n_chars"), F.sha2("t", 256).alias("text_sha256"), gate.alias("gate"), texts.estimated_tokens(F.col("t")).alias("n_tokens"))


@query(r"""
SELECT page_id, regexp_matches(substr(html, 1, 5000), 'Just a moment|Enable JavaScript and cookies to continue|cf-browser-verification|__cf_chl|cf-chl-|challenge-form') AS challenge,
       coalesce(nullif(regexp_extract(lower(html), '<html[^>]*[ \t\n]lang=["'']?([a-z]{2})', 1), ''), nullif(regexp_extract(lower(html), 'content-language["''][^>]*content=["'']([a-z]{2})', 1), ''), 'en') AS lang FROM pages""")
def page_language(spark: SparkSession, d: str) -> DataFrame:
    """Challenge pages and declared languages."""
    return table(spark, d, "pages").select("page_id", texts.is_challenge(F.col("html")).alias("challenge"), texts.html_language(F.col("html")).alias("lang"))


@query(f"""
WITH p AS (SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN url || '/' WHEN 2 THEN 'https://login.live.com/x' WHEN 3 THEN 'https://other.test/' ELSE url || '?' || repeat('q', (page_id % 60)::INT) END AS final,
           regexp_extract({NO_WWW}, '([^.]+\\.[^.]+)$', 1) AS dom, length(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)) AS plen,
           length(coalesce(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '')) AS qlen FROM pages),
c AS (SELECT *, CASE WHEN final IS NULL THEN 1 WHEN lower(regexp_replace(final, '/+$', '')) = lower(regexp_replace(url, '/+$', '')) THEN 2 WHEN page_id % 5 IN (2, 3) THEN 3
      WHEN regexp_matches(final, '(?i)(REALMOID|SMAUTHREASON|SMAGENTNAME|TARGET=\\$SM|!ut/p/|;jsessionid=)') OR length(regexp_extract(final, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)) > 60
        OR length(coalesce(regexp_extract(final, '^[^?#]*\\?([^#]*)', 1), '')) > 40 THEN 4 ELSE 5 END AS k FROM p)
SELECT page_id, CASE WHEN k IN (1, 3, 4) THEN url ELSE final END AS url, k <> 3 AS accessible, CASE k WHEN 3 THEN 'unreachable' WHEN 4 THEN 'messy_redirect_cleaned' ELSE '' END AS note FROM c""")
def redirect_classify(spark: SparkSession, d: str) -> DataFrame:
    """P10: which URL of a redirect to record."""
    case = F.col("page_id") % 5
    final = F.when(case == 0, F.lit(None).cast("string")).when(case == 1, F.concat("url", F.lit("/"))).when(case == 2, "https://login.live.com/x").when(case == 3, "https://other.test/")
    final = final.otherwise(F.concat("url", F.lit("?"), F.expr("repeat('q', cast(page_id % 60 as int))")))
    return table(spark, d, "pages").select("page_id", urls.classify_redirect(F.col("url"), final).alias("c")).select("page_id", "c.*")


_SEEN = "CASE WHEN contains(url, 'blog.') THEN 'https://challenges.cloudflare.com/' || page_id WHEN contains(url, '//m.') THEN ' About:blank' WHEN contains(url, '#top') THEN 'https://www.facebook.com/x' WHEN contains(url, '/es/') THEN 'https://db.ripe.net/y' WHEN contains(url, '/de/') THEN '' ELSE url END"
_SEEN_HOST = "lower(regexp_replace(regexp_extract(u, '^[^:/?#]+://([^/?#]*)', 1), ':[0-9]*$', ''))"


def _under(domains: tuple[str, ...]) -> str:
    return "regexp_matches(" + _SEEN_HOST + ", '(^|\\.)(" + "|".join(x.replace(".", "\\.") for x in domains) + ")$')"


@query(f"""
SELECT page_id, {_under(urls.REGISTRY_DOMAINS)} AS registry, {_under(urls.SOCIAL_DOMAINS)} AS social, {' OR '.join(f"contains(lower(u), '{m}')" for m in urls.MIDDLEBOX_MARKERS)} AS middlebox,
       trim(u) = '' OR regexp_matches(lower(trim(u)), '^(chrome-error:|about:|data:|file:|javascript:)') AS internal, CASE WHEN page_id % 7 < 3 THEN 'accessible' WHEN page_id % 7 < 6 THEN 'blocked' ELSE 'none' END AS reach
FROM (SELECT page_id, {_SEEN} AS u FROM pages)""")
def url_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Registry and social sites, middleboxes, internal addresses, classes of status, on what a browser ended at."""
    u = F.col("u")
    status = F.element_at(F.array(*(F.lit(x) for x in (200, 301, 399, 401, 403, 429, 500))), (F.col("page_id") % 7 + 1).cast("int"))
    reach = F.when(urls.is_accessible(status), "accessible").when(urls.is_blocked(status), "blocked").otherwise("none")
    return table(spark, d, "pages").select("page_id", F.expr(_SEEN).alias("u")).select(
        "page_id", urls.under_any(u, urls.REGISTRY_DOMAINS).alias("registry"), urls.under_any(u, urls.SOCIAL_DOMAINS).alias("social"), urls.contains_any(u, urls.MIDDLEBOX_MARKERS).alias("middlebox"), urls.is_internal(u).alias("internal"), reach.alias("reach"),
    )


# Registries, maps and merges


@query("SELECT p_partkey, unnest(range(p_partkey, p_partkey + p_size)) AS n FROM part WHERE p_size >= 1")
def range_expand(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of numbers."""
    return relational.range_expand(table(spark, d, "part"), "p_partkey", "p_size", "n").select("p_partkey", "n")


@query("""
SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS rk FROM events GROUP BY 1, 2) WHERE rk = 1""")
def mode_per_key(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent value, the first seen of equals."""
    return relational.mode_first_seen(table(spark, d, "events"), "user_id", "event_type", "event_id")


@query("""
SELECT event_type, arg_max(user_id, event_id) AS user_id, coalesce(sum((prev <> user_id)::INT), 0)::BIGINT AS conflicts FROM (SELECT *, lag(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS prev FROM events) GROUP BY 1""")
def upsert_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Last holder and changes of holder."""
    return relational.upsert_conflicts(table(spark, d, "events"), "event_type", "user_id", "event_id", 2048)


@query("""
SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING max(o_orderdate) >= TIMESTAMP '1999-06-30' - INTERVAL 12 MONTH)""")
def operational_scope(spark: SparkSession, d: str) -> DataFrame:
    """Keys that were alive within a year."""
    alive = website.operational(table(spark, d, "orders"), "o_custkey", "o_orderdate", "1999-06-30")
    return table(spark, d, "customer").join(alive, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("""
SELECT * FROM (SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id) = 1)""")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    """The newest row of a key."""
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return relational.latest_by(rows, ["user_id", "event_type"], "ts", "event_id")


@query("""
WITH s AS (SELECT DISTINCT c_custkey, c_nationkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey),
h AS (SELECT c_nationkey, o_orderpriority, list_sort(list(DISTINCT c_custkey::VARCHAR)) AS h FROM s GROUP BY 1, 2), u AS (SELECT DISTINCT c_custkey, c_nationkey FROM s)
SELECT u.c_custkey, h.o_orderpriority, 'Inherit from ' || array_to_string(h.h, ', ') AS note FROM u JOIN h USING (c_nationkey) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.c_custkey = u.c_custkey AND s.o_orderpriority = h.o_orderpriority)""")
def sibling_inherit(spark: SparkSession, d: str) -> DataFrame:
    """Labels from members of the same group."""
    held = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_nationkey", "o_orderpriority")
    return relational.inherit_within_group(held, "c_custkey", "c_nationkey", "o_orderpriority")


@query("""
WITH a AS (SELECT user_id, arg_min(event_type, event_id) AS t, count(*) % 2 AS n FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), b AS (SELECT user_id, arg_min(event_type, event_id) AS t, count(*) % 2 AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'new' WHEN b.user_id IS NULL THEN 'gone' WHEN a.t = b.t AND a.n = b.n THEN 'same' ELSE 'changed' END AS outcome FROM a FULL JOIN b ON a.user_id = b.user_id""")
def identity_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Identities compared across two overlapping periods."""
    events = table(spark, d, "events")
    side = lambda period: events.where(period).groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("t"), (F.count("*") % 2).alias("n"))
    return relational.identity_reuse(side("ts < '2024-01-16'"), side("ts >= '2024-01-10'"), "user_id", ["t", "n"])


@query("""
SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 'fallback' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'wiki' WHEN c_acctbal > 2000 THEN 'site' END AS source,
       CASE WHEN c_nationkey < 5 THEN c_mktsegment WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN lower(c_mktsegment) WHEN c_acctbal > 2000 THEN c_name END AS value
FROM customer WHERE c_nationkey < 5 OR c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_acctbal > 2000""")
def precedence_merge(spark: SparkSession, d: str) -> DataFrame:
    """A later part replaces the record."""
    c = table(spark, d, "customer")
    part = lambda which, name, value: c.where(which).select("c_custkey", F.lit(name).alias("source"), value.alias("value"))
    return relational.precedence_merge([part("c_acctbal > 2000", "site", F.col("c_name")), part("c_mktsegment IN ('BUILDING', 'MACHINERY')", "wiki", F.lower("c_mktsegment")), part("c_nationkey < 5", "fallback", F.col("c_mktsegment"))], "c_custkey")


@query("""
SELECT c_custkey, coalesce(CASE WHEN c_nationkey < 12 THEN nullif(c_mktsegment, 'BUILDING') END, CASE WHEN c_acctbal > 0 THEN c_name END) AS url, CASE WHEN c_nationkey < 12 THEN 3 ELSE 2 END AS n
FROM customer WHERE c_acctbal > 0 OR c_nationkey < 12""")
def coalesce_merge(spark: SparkSession, d: str) -> DataFrame:
    """The highest value that isn't null, column by column."""
    c = table(spark, d, "customer")
    low = c.where("c_acctbal > 0").select("c_custkey", F.col("c_name").alias("url"), F.lit(2).alias("n"))
    high = c.where("c_nationkey < 12").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("url"), F.lit(3).alias("n"))
    return relational.precedence_merge([low, high], "c_custkey", blend=True)


@query("""
SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'N') QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'A' THEN 0 ELSE 1 END, l_linenumber) = 1""")
def first_accessible(spark: SparkSession, d: str) -> DataFrame:
    """The first of the best class."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return relational.first_by_class(rows, "l_orderkey", F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1), "l_linenumber")


@query("""
WITH e AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'), g AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag <> 'N')
SELECT coalesce(o_orderkey, l_orderkey) AS id, CASE WHEN l_orderkey IS NULL THEN 'missing' WHEN o_orderkey IS NULL THEN 'unknown' ELSE 'both' END AS state FROM e FULL JOIN g ON o_orderkey = l_orderkey""")
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Expected against received."""
    expected = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"))
    return relational.reconcile(expected, table(spark, d, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("id")), "id")


@query("""
WITH s AS (SELECT DISTINCT last_day(o_orderdate::DATE) AS d FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 480000),
w AS (SELECT DISTINCT o_orderdate::DATE AS want FROM orders),
best AS (SELECT want, (SELECT arg_min(d, struct_pack(a := date_trunc('month', d) <> date_trunc('month', want), b := abs(date_diff('day', d, want)), c := d)) FROM s) AS d FROM w)
SELECT o_orderkey, best.d::DATE::VARCHAR AS snapshot FROM orders JOIN best ON o_orderdate::DATE = want""")
def nearest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The nearest snapshot, of the same month first."""
    orders = table(spark, d, "orders")
    wanted = orders.select("o_orderkey", F.to_date("o_orderdate").alias("want"))
    days = orders.where("o_orderstatus = 'F' AND o_totalprice > 480000").select(F.last_day("o_orderdate").alias("snapshot"))
    return relational.nearest_snapshot(wanted, "want", days, "snapshot").select("o_orderkey", F.col("snapshot").cast("string").alias("snapshot"))


# Prompts, routing and budgets


@query("""
SELECT doc_id, source, greatest(0, least(n_chars, 20000 - coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS granted FROM documents""")
def token_budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    """A running budget per key."""
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return relational.budget_prefix(rows, "source", [F.col("doc_id")], "n_chars", 20_000, "granted", F.expr("doc_id div 512")).select("doc_id", "source", F.col("granted").cast("long").alias("granted"))


@query("""
WITH RECURSIVE r AS (SELECT row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i, lang, doc_id, octet_length(encode(text)) + 1 AS b, (n_chars // 4)::BIGINT AS t FROM documents),
s AS (SELECT i, lang, doc_id, 0::BIGINT AS bin, 1::BIGINT AS n, b::BIGINT AS b, t FROM r WHERE i = 1
  UNION ALL SELECT r.i, r.lang, r.doc_id, CASE WHEN s.n >= 40 OR s.b + r.b > 90000 OR s.t + r.t > 20000 THEN s.bin + 1 ELSE s.bin END, CASE WHEN s.n >= 40 OR s.b + r.b > 90000 OR s.t + r.t > 20000 THEN 1 ELSE s.n + 1 END,
    CASE WHEN s.n >= 40 OR s.b + r.b > 90000 OR s.t + r.t > 20000 THEN r.b ELSE s.b + r.b END, CASE WHEN s.n >= 40 OR s.b + r.b > 90000 OR s.t + r.t > 20000 THEN r.t ELSE s.t + r.t END
  FROM s JOIN r ON r.lang = s.lang AND r.i = s.i + 1)
SELECT lang AS stream, doc_id AS ordinal, bin FROM s""")
def bin_pack(spark: SparkSession, d: str) -> DataFrame:
    """Request files under three limits."""
    rows = table(spark, d, "documents").select("lang", "doc_id", (F.octet_length("text") + 1).alias("b"), F.expr("n_chars div 4").alias("t"))
    return routing.pack_bins(rows, "lang", "doc_id", "b", "t", 20_000, 40, 90_000)


@query("""
WITH k AS (SELECT sha256(text) AS h, min(doc_id) AS prompt_id, count(*) AS copies FROM documents GROUP BY 1)
SELECT doc_id, prompt_id, copies, h AS text_sha256 FROM documents JOIN k ON h = sha256(text)""")
def content_dedup(spark: SparkSession, d: str) -> DataFrame:
    """A14, J15, O-04: one prompt per distinct content, fanned out."""
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    unique = rows.groupBy("text_sha256").agg(F.min("doc_id").alias("prompt_id"), F.count("*").alias("copies"))
    return rows.join(unique, "text_sha256").select("doc_id", "prompt_id", "copies", "text_sha256")


@query("""
SELECT doc_id, CASE WHEN p IS NOT NULL AND p < 5 AND NOT torn AND t <= 6000 THEN 'gpt-5.6-luna' ELSE 'gpt-5.6-terra' END AS model,
  CASE WHEN torn THEN 'ambiguous_previous_classification' WHEN p IS NULL THEN 'missing_previous_classification' WHEN p >= 5 THEN 'prior_categories_ge_5' WHEN t <= 6000 THEN 'short_prompt_le_6000' ELSE 'long_prompt_gt_6000' END AS reason,
  true AS family
FROM (SELECT d.doc_id, n_chars // 4 AS t, source = 'src3' AS torn, l.quality * 3 + l.toxic * 2 + d.doc_id % 3 AS p FROM documents d LEFT JOIN labels l USING (doc_id))""")
def route_decision(spark: SparkSession, d: str) -> DataFrame:
    """Which model a prompt goes to."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    prior = F.col("quality") * 3 + F.col("toxic") * 2 + F.col("doc_id") % 3
    routed = rows.select("doc_id", routing.route(prior, F.expr("n_chars div 4"), prior.isNotNull(), F.col("source") == "src3").alias("r")).select("doc_id", "r.*")
    return routed.withColumn("family", routing.is_family(F.col("model")))


@query("""
WITH s AS (SELECT o_custkey, o_orderstatus, list_sort(list(DISTINCT o_orderpriority)) AS c FROM orders GROUP BY 1, 2),
k AS (SELECT o_custkey, list(DISTINCT c) AS sets FROM s GROUP BY 1)
SELECT o_custkey, CASE WHEN len(sets) > 1 THEN 'ambiguous' ELSE 'ok' END AS status, array_to_string(list_sort(list_distinct(flatten(sets))), '|') AS categories FROM k""")
def prior_class_index(spark: SparkSession, d: str) -> DataFrame:
    """One, several or no category sets per key."""
    sets = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.collect_set("o_orderpriority").alias("c"))
    return routing.prior_class_index(sets, "o_custkey", "c").select("o_custkey", "status", F.array_join("categories", "|").alias("categories"))


@query("""
SELECT l_returnflag AS model, count(*) AS requests, sum(l_linenumber)::BIGINT AS tokens_in, sum(l_suppkey)::BIGINT AS tokens_out, round((sum(l_linenumber) * p.i * 1.25 + sum(l_suppkey) * p.o) / 1e6, 6) AS ceiling
FROM lineitem JOIN (VALUES ('A', 2.0, 12.0), ('N', 0.2, 1.2), ('R', 0.5, 3.0)) p(m, i, o) ON m = l_returnflag GROUP BY 1, p.i, p.o""")
def cost_ceiling(spark: SparkSession, d: str) -> DataFrame:
    """The most a run can cost."""
    models = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("i"), F.col("l_suppkey").alias("o"))
    price = lambda *rows: spark.createDataFrame(list(rows), "model string, price_in double, price_out double")
    prices = routing.resolve_prices(models, price(("A", 2.0, 12.0)), price(("A", 9.0, 9.0), ("N", 0.2, 1.2)), (0.5, 3.0))
    return routing.cost_ceiling(models, prices, "model", "i", "o").withColumn("ceiling", F.round("ceiling", 6))


@query("""
SELECT l_returnflag AS model, l_linestatus AS part, sum(l_linenumber)::BIGINT AS cached, sum(l_suppkey)::BIGINT AS prompt, round(100.0 * sum(l_linenumber) / sum(l_suppkey), 4) AS percent
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus))""")
def cache_telemetry(spark: SparkSession, d: str) -> DataFrame:
    """Sums by model and by part in one pass."""
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("part"), "l_linenumber", "l_suppkey")
    sums = rows.groupingSets([["model"], ["model", "part"]], "model", "part").agg(F.sum("l_linenumber").alias("cached"), F.sum("l_suppkey").alias("prompt"))
    return sums.withColumn("percent", F.round(F.lit(100.0) * F.col("cached") / F.col("prompt"), 4))


@query("SELECT o_orderstatus, sha256(string_agg(o_orderkey::VARCHAR, chr(10) ORDER BY o_orderkey::VARCHAR)) AS ids_sha256, count(*) AS n FROM orders GROUP BY 1")
def id_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """The fingerprint of a set of identifiers."""
    return relational.id_set_fingerprints(table(spark, d, "orders"), "o_orderstatus", "o_orderkey")


# States, metrics and checks


@query("""
SELECT c_custkey, coalesce(n, 0) AS pages, CASE WHEN n > 0 THEN 'DONE' WHEN s = 'P' THEN 'SKIPPED' WHEN s = 'F' THEN 'FAILED' WHEN s IS NOT NULL THEN 'ATTEMPTED' ELSE 'NEVER' END AS state
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 440000 GROUP BY 1) a ON a.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS s FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1) b ON b.o_custkey = c_custkey""")
def progress_state(spark: SparkSession, d: str) -> DataFrame:
    """Where each seed stands."""
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    word = F.when(F.col("o_orderstatus") == "P", "skipped").when(F.col("o_orderstatus") == "F", "failed").otherwise("other")
    return crawl.progress(table(spark, d, "customer"), "c_custkey", orders.where("o_totalprice > 440000"), orders.where("o_orderpriority <> '1-URGENT'").withColumn("status", word), "status", "o_orderkey")


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE c_acctbal < 0) AS negative, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building FROM customer")
def partition_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts by condition."""
    return quality.metrics(table(spark, d, "customer"), {"negative": F.col("c_acctbal") < 0, "building": F.col("c_mktsegment") == "BUILDING"})


@query("""
SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS duplicates, (SELECT count(*) FROM customer WHERE (c_acctbal < 100)::INT + (c_acctbal > 50)::INT <> 1) AS unplaced,
       (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1)) AS torn""")
def invariants(spark: SparkSession, d: str) -> DataFrame:
    """Violations counted."""
    a = quality.duplicate_keys(table(spark, d, "orders"), "o_orderkey").agg(F.count("*").alias("duplicates"))
    b = quality.partition_violations(table(spark, d, "customer"), "c_custkey", {"low": F.col("c_acctbal") < 100, "high": F.col("c_acctbal") > 50}).agg(F.count("*").alias("unplaced"))
    c = quality.streams_per_member(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag").agg(F.count("*").alias("torn"))
    return a.crossJoin(b).crossJoin(c)  # one row each


@query("""
WITH a AS (SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_acctbal > 0), b AS (SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN 'x' ELSE s_name END AS s_name, s_nationkey + (s_acctbal > 5000)::INT AS s_nationkey FROM supplier WHERE s_nationkey <> 7)
SELECT * FROM (SELECT coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, CASE WHEN b.s_suppkey IS NULL THEN 'missing' WHEN a.s_suppkey IS NULL THEN 'extra' WHEN a.s_name IS DISTINCT FROM b.s_name THEN 's_name' WHEN a.s_nationkey IS DISTINCT FROM b.s_nationkey THEN 's_nationkey' END AS problem
FROM a FULL JOIN b ON a.s_suppkey = b.s_suppkey) WHERE problem IS NOT NULL""")
def artifact_check(spark: SparkSession, d: str) -> DataFrame:
    """A manifest against what is there."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    actual = s.where("s_nationkey <> 7").select("s_suppkey", F.when(F.col("s_nationkey") < 5, "x").otherwise(F.col("s_name")).alias("s_name"), (F.col("s_nationkey") + (F.col("s_acctbal") > 5000).cast("int")).alias("s_nationkey"))
    return quality.artifact_differences(s.where("s_acctbal > 0"), actual, "s_suppkey", ["s_name", "s_nationkey"])


@query("""
SELECT event_id, CASE WHEN a IS NULL AND w IS NULL THEN 'passthrough' WHEN a IS NULL OR w IS NULL THEN 'invalid' WHEN w IN (3, 4) THEN 'skipped' ELSE 'kept' END AS state
FROM (SELECT event_id, CASE WHEN event_id % 4 > 0 THEN event_id END AS a, CASE WHEN event_id % 6 > 0 THEN user_id % 10 END AS w FROM events)""")
def reference_scrub(spark: SparkSession, d: str) -> DataFrame:
    """Rows by the state of what they refer to."""
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 > 0, F.col("event_id")).alias("a"), F.when(F.col("event_id") % 6 > 0, F.col("user_id") % 10).alias("w"))
    return quality.classify_refs(rows, "a", "w", spark.createDataFrame([(3,), (4,)], "warc long")).select("event_id", "state")


@query("SELECT event_type, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3)")
def top_counters(spark: SparkSession, d: str) -> DataFrame:
    """The most common values."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("SELECT sizes, count(*) AS n FROM (SELECT count(DISTINCT event_type) AS sizes FROM events GROUP BY user_id) GROUP BY 1")
def set_size_histogram(spark: SparkSession, d: str) -> DataFrame:
    """How many keys have how many values."""
    return table(spark, d, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("sizes")).groupBy("sizes").agg(F.count("*").alias("n"))


@query("""
SELECT user_id, event_id, value, rk::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rk FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1)) WHERE rk <= 6""")
def top_links(spark: SparkSession, d: str) -> DataFrame:
    """The best few of a key, one per class."""
    best = relational.argmax_by(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.col("value"), -F.col("event_id")])
    return relational.top_k_by(best, "user_id", [F.desc("value"), F.col("event_id")], 6).select("user_id", "event_id", "value", "rank")


@query("SELECT user_id, array_to_string(list(event_type ORDER BY o), ',') AS types FROM (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values in order of appearance."""
    found = relational.ordered_distinct(table(spark, d, "events"), "user_id", "event_type", "event_id", "types")
    return found.withColumn("types", F.array_join("types", ","))


# Texts and answers


@query(r"""
SELECT conv_id, turn, trim(text) = '' OR regexp_matches(text, '(?i)^[ \t\r\n]*(no[ \t\r\n]+match\.?|none|\(none\)|n/a|null|not[ \t\r\n]+found|–|-|—)[ \t\r\n]*$') AS no_match,
  CASE WHEN trim(text) = '' THEN true WHEN regexp_matches(lower(text), 'https?://|www\.') THEN false
    WHEN regexp_matches(lower(trim(text)), '^(based on|no match|i couldn''t|i could not|i was unable|unfortunately|i''m sorry|i am sorry|i don''t|i do not|there is no|there''s no|i cannot|i can''t|it appears|it seems|after searching|after extensive)') THEN true
    ELSE contains(trim(text), ' ') AND length(trim(text)) > 30 END AS unusable,
  nullif(regexp_extract(text, '((?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})', 1), '') AS first_url
FROM conversations""")
def llm_text_filters(spark: SparkSession, d: str) -> DataFrame:
    """What an answer is worth."""
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", texts.is_no_match(t).alias("no_match"), texts.is_unusable(t).alias("unusable"), urls.first_url(t).alias("first_url"))


_TOKENS = "list_filter(list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+')), lambda x: x <> '')"


@query(f"""
WITH w AS (SELECT doc_id, {_TOKENS} AS a FROM documents), b AS (SELECT item_id, {_TOKENS} AS b FROM benchmark),
j AS (SELECT doc_id, item_id, len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b)))) AS jaccard FROM w, b)
SELECT doc_id, item_id, round(jaccard, 6) AS jaccard FROM j WHERE jaccard >= 0.2""")
def token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """texts that share many words with an item, by an equi-join on rare words."""
    side = lambda name, key: table(spark, d, name).select(key, texts.tokens(F.col("text")).alias("words"))
    pairs = relational.overlap_join(side("documents", "doc_id"), side("benchmark", "item_id"), "doc_id", "item_id", "words", 0.2)
    return pairs.select("doc_id", "item_id", F.round("jaccard", 6).alias("jaccard"))


@query("""
WITH l AS (SELECT list_sort(list(DISTINCT w)) AS l FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part UNION ALL SELECT p_type FROM part))
SELECT p_partkey, array_to_string(list_filter(l, lambda x: contains(lower(p_type || ' ' || p_name || ' ' || p_brand), lower(x))), '|') AS labels FROM part, l""")
def category_extract_exact(spark: SparkSession, d: str) -> DataFrame:
    """F07, tiers without Python: whole labels contained in a text."""
    part = table(spark, d, "part")
    labels = part.select(F.explode(F.split("p_name", " ")).alias("w")).union(part.select("p_type")).agg(F.array_sort(F.collect_set("w")).alias("l"))
    rows = part.crossJoin(F.broadcast(labels))  # one row
    return rows.select("p_partkey", F.array_join(fuzzy.labels_verbatim(F.concat_ws(" ", "p_type", "p_name", "p_brand"), F.col("l")), "|").alias("labels"))


@query("SELECT event_id, CAST(props::JSON ->> '$.k' AS VARCHAR) AS k, json_valid(props) AS is_json FROM events")
def props_json(spark: SparkSession, d: str) -> DataFrame:
    """fields of polymorphic JSON."""
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "string").alias("k"), v.isNotNull().alias("is_json"))


@query()
def fuzzy_names(spark: SparkSession, d: str) -> DataFrame:
    """Names closest to a customer's among the suppliers of its nation, ties included."""
    suppliers = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_name")
    customers = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_name", "c_mktsegment").where("c_custkey is not null")
    best = fuzzy.best_in_blocks(customers, suppliers, "nation", "c_name", "c_mktsegment", "s_name").select(F.col("nation").alias("n"), F.col("c_name").alias("a"), F.col("c_mktsegment").alias("b"), F.col("s_name").alias("v"), "score")
    own = customers.join(best, (F.col("nation") == F.col("n")) & F.col("c_name").eqNullSafe(F.col("a")) & F.col("c_mktsegment").eqNullSafe(F.col("b"))).select("c_custkey", "n", "v", "score")
    own = own.withColumn("top", F.max("score").over(Window.partitionBy("c_custkey"))).where("score = top")
    return own.join(suppliers, (F.col("n") == F.col("nation")) & F.col("v").eqNullSafe(F.col("s_name"))).select("c_custkey", "s_name", F.round("score", 6).alias("score"))


@query()
def taxonomy_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Labels in free text, verbatim, in normal form and by candidate lines."""
    part = table(spark, d, "part").withColumn("p_name", F.initcap("p_name")).withColumn("p_type", F.initcap("p_type"))
    label = F.concat_ws(" - ", "p_type", "p_name")
    taxonomy = part.select(label.alias("label")).distinct().withColumn("ordinal", F.xxhash64("label"))
    answer = F.concat(F.lit("Resulting categories:\n1. "), F.upper("p_type"), F.lit(" – "), F.expr("substr(p_name, 1, length(p_name) - 1)"), F.lit("\n2) other "), F.col("p_name"))
    answers = part.select("p_partkey", answer.alias("text"))
    labelled = fuzzy.extract_labels(answers, "text", taxonomy, "label")
    return answers.join(labelled, "text").select("p_partkey", F.array_join("labels", "|").alias("labels"))


@query(f"""
WITH p AS (SELECT {NO_WWW} AS host, page_id, {_STRIP} AS t FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id DESC) AS rk, floor(length(t) / 2.5)::BIGINT AS c FROM p WHERE t <> ''),
g AS (SELECT host, greatest(0, least(c, 1000 - coalesce(sum(c) OVER (PARTITION BY host ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS granted FROM r)
SELECT host, sum(granted)::BIGINT AS tokens, count(*) AS n_pages FROM g WHERE granted > 0 GROUP BY 1""")
def prompt_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Texts of a site under a budget."""
    pages = pages_with_host(spark, d).select("host", "url", "page_id", texts.strip_html(F.col("html")).alias("t")).where("t <> ''")
    ranked = pages.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("page_id"))))
    costed = relational.budget_prefix(ranked.withColumn("cost", texts.estimated_tokens(F.col("t"))), "host", [F.col("rank")], "cost", 1000, "granted").where("granted > 0")
    return costed.groupBy("host").agg(F.sum("granted").cast("long").alias("tokens"), F.count("*").alias("n_pages"))


@query("""
WITH b AS (SELECT user_id, event_type FROM events WHERE value < 20 GROUP BY 1, 2), m AS (SELECT user_id, event_type FROM events WHERE value >= 20 GROUP BY 1, 2)
SELECT * FROM b UNION ALL (SELECT * FROM m EXCEPT SELECT * FROM b)""")
def additive_merge(spark: SparkSession, d: str) -> DataFrame:
    """What is missing is added."""
    part = lambda which: table(spark, d, "events").where(which).select("user_id", "event_type").distinct()
    return relational.additive_merge(part("value < 20"), part("value >= 20"), ["user_id", "event_type"])


@query("""
SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Extension: tumbling windows as the streaming operators compute them."""
    rows = table(spark, d, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("day"), "event_type", "n")


@query("SELECT event_type, arg_max(event_id, struct_pack(ts := ts, e := event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def job_states(spark: SparkSession, d: str) -> DataFrame:
    """The latest state of an event-sourced table."""
    return table(spark, d, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


# Around the registry


@query("""
WITH r AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'CONSTRUCTION' ELSE c_mktsegment END AS v FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'MACHINERY'), f AS (SELECT c_custkey, 'forced' AS v FROM customer WHERE c_nationkey = 7)
SELECT coalesce(f.c_custkey, r.c_custkey) AS c_custkey, coalesce(f.v, r.v) AS domain FROM r FULL JOIN f ON r.c_custkey = f.c_custkey""")
def manual_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Listed values dropped, the others rewritten, then forced by key."""
    c = table(spark, d, "customer")
    rewrites = spark.createDataFrame([("BUILDING", "CONSTRUCTION")], "from string, to string")
    forced = c.where("c_nationkey = 7").select("c_custkey", F.lit("forced").alias("domain"))
    own = registry.drop_listed(c.where("c_acctbal > 0").select("c_custkey", F.col("c_mktsegment").alias("domain")), "domain", ("MACHINERY",))
    return registry.apply_overrides(own, "c_custkey", "domain", rewrites, forced)


@query("""
WITH l AS (SELECT o_custkey AS s, min(o_orderkey % 1500) AS t FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), a AS (SELECT c_custkey, coalesce(t, c_custkey) AS e, (t IS NOT NULL)::INT AS h FROM customer LEFT JOIN l ON c_custkey = s),
b AS (SELECT c_custkey, coalesce(t, e) AS e, h + (t IS NOT NULL)::INT AS h FROM a LEFT JOIN l ON e = s), c AS (SELECT c_custkey, coalesce(t, e) AS e, h + (t IS NOT NULL)::INT AS h FROM b LEFT JOIN l ON e = s)
SELECT c_custkey, coalesce(t, e) AS "end", h + (t IS NOT NULL)::INT AS hops FROM c LEFT JOIN l ON e = s""")
def redirect_chain(spark: SparkSession, d: str) -> DataFrame:
    """Ends of chains of at most four hops."""
    links = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("s"), (F.col("o_orderkey") % 1500).alias("t"))
    return registry.follow(table(spark, d, "customer").select("c_custkey"), "c_custkey", links, "s", "t")


@query("SELECT count(*) AS targets, count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)) AS covered, round(100.0 * covered / targets, 2) AS percent FROM customer")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many targets were reached."""
    found = table(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return registry.coverage(table(spark, d, "customer"), found, "c_custkey")


@query("SELECT p_name, count(*) AS n FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size = 1) GROUP BY 1")
def unknown_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels outside the taxonomy."""
    part = table(spark, d, "part").select("p_size", "p_name")
    return registry.unknown_labels(part, "p_name", part.where("p_size = 1"))


@query("SELECT s_nationkey, array_to_string(list_sort(list(DISTINCT s_suppkey)), ',') AS keys FROM supplier GROUP BY 1")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    """Keys by value."""
    return registry.inverted(table(spark, d, "supplier"), "s_suppkey", "s_nationkey").select("s_nationkey", F.array_join(F.col("keys").cast("array<string>"), ",").alias("keys"))


@query("""
WITH s AS (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 1), l AS (SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1)
SELECT o_custkey, round(v, 4) AS v FROM s UNION ALL SELECT o_custkey, round(v, 4) FROM l WHERE o_custkey NOT IN (SELECT o_custkey FROM s)""")
def log_recovery(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot, and the log where it has nothing."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("v"))
    snapshot = orders.where("o_orderpriority = '2-HIGH'").groupBy("o_custkey").agg(F.max("v").alias("v"))
    return registry.recover_log(snapshot, orders, "o_custkey", "o_orderkey").withColumn("v", F.round("v", 4))


@query("SELECT p_brand, arg_max(p_name, p_partkey) AS p_name FROM part GROUP BY 1")
def likely_open(spark: SparkSession, d: str) -> DataFrame:
    """The last file of a group."""
    return registry.likely_open(table(spark, d, "part"), "p_brand", "p_name", "p_partkey")


@query("""
SELECT doc_id, contains(lower(text), 'the')::INT + contains(lower(text), 'der')::INT + contains(lower(text), 'que')::INT AS score FROM documents""")
def keyword_score(spark: SparkSession, d: str) -> DataFrame:
    """keywords found in a text."""
    return table(spark, d, "documents").select("doc_id", registry.keyword_score(F.lower("text"), ["the", "der", "que"]).alias("score"))


@query("""
SELECT o_orderkey, sha1(o_orderkey::VARCHAR || '|' || o_orderstatus) AS cache_key, o_orderdate::DATE::VARCHAR AS day, CASE WHEN o_orderstatus = 'F' THEN 'x' END AS note FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 2)""")
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """J06, J17, F37, F38, O-08: requests not yet answered, by a content hash."""
    orders, done = table(spark, d, "orders"), table(spark, d, "lineitem").where("l_linenumber > 2").select(F.col("l_orderkey").alias("o_orderkey"))
    missing = orders.join(done, "o_orderkey", "left_anti")
    return missing.select("o_orderkey", F.sha1(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus")).alias("cache_key"), F.to_date("o_orderdate").cast("string").alias("day"), F.when(F.col("o_orderstatus") == "F", "x").alias("note"))
