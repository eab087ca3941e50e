"""Steps around the number registry: overrides, identities, recovery of logs, chains and coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import urls
from strandline.operators.relational import precedence_merge


def drop_listed(df: DataFrame, value: str, listed: Sequence[str] = urls.MAIL_DOMAINS) -> DataFrame:
    """Rows whose value isn't in a short list; null stays."""
    return df.where(F.col(value).isNull() | ~F.col(value).isin(*listed))


def apply_overrides(df: DataFrame, key: str, value: str, rewrites: DataFrame, forced: DataFrame) -> DataFrame:
    """key, value: values are first rewritten (from, to), then forced by key (key, value), which also adds keys."""
    r = rewrites.select(F.col("from").alias("__from"), F.col("to").alias("__to"))
    rewritten = df.select(key, value).join(r, F.col(value) == F.col("__from"), "left").select(key, F.coalesce("__to", value).alias(value))
    f = forced.select(F.col(key).alias("__key"), F.col(value).alias("__value"))
    return rewritten.join(f, F.col(key) == F.col("__key"), "full_outer").select(F.coalesce("__key", key).alias(key), F.coalesce("__value", value).alias(value))


def name_pair(as_name: Column, org: Column, descr: Column) -> Column:
    """struct(as_name, org_name): the description stands in only for a missing organisation, not for an empty one."""
    return F.struct(F.coalesce(as_name, F.lit("")).alias("as_name"), F.coalesce(org, descr, F.lit("")).alias("org_name"))


def identities(parts: Sequence[DataFrame]) -> DataFrame:
    """asn, as_name, org, descr of several registries; the record of a later one replaces that of an earlier one."""
    return precedence_merge([p.select("asn", "as_name", "org", "descr") for p in parts], "asn")


def recover_log(snapshot: DataFrame, log: DataFrame, key: str, ordinal: str) -> DataFrame:
    """``snapshot`` and, for keys it lacks, the first record of the log."""
    values = [c for c in snapshot.columns if c != key]
    first = log.groupBy(key).agg(F.min_by(F.struct(*values), ordinal).alias("v")).select(key, "v.*")
    return snapshot.unionByName(first.join(snapshot.select(key).distinct(), key, "left_anti"))


def organisation_handles(records: DataFrame) -> DataFrame:
    """asn, org: records of type ASN, upper-case and trimmed, without placeholder organisations."""
    rows = records.where(F.upper(F.trim("type")) == "ASN").select(F.regexp_replace(F.upper(F.trim("asn")), "^AS", "").alias("asn"), F.upper(F.trim("org")).alias("org"))
    return rows.where((F.col("org") != "") & ~F.col("org").endswith("@AUT-AS")).distinct()


def latest_before(days: DataFrame, day: str, current: str) -> DataFrame:
    """One row: the last day before ``current``, null if there is none."""
    return days.where(F.col(day) < F.lit(current)).agg(F.max(day).alias(day))


def previous_pair(snapshots: DataFrame, tag: str, current: str, explicit: str | None = None, wanted: str | None = None) -> DataFrame:
    """One row: the tag whose two files are used: an explicit one, else a wanted one, else the newest older one, each if it has
    both files; null if none has."""
    whole = snapshots.where(F.col("has_mapping") & F.col("has_class"))
    rank = F.when(F.col(tag) == F.lit(explicit), 2).when(F.col(tag) == F.lit(wanted), 1).when(F.col(tag) < current, 0)
    return whole.withColumn("__r", rank).where("__r is not null").agg(F.max_by(tag, F.struct("__r", tag)).alias(tag))


def follow(start: DataFrame, key: str, links: DataFrame, source: str, target: str, hops: int = 4) -> DataFrame:
    """key, end, hops: where a chain of redirects ends after at most ``hops`` steps; a circle ends after that many."""
    unique = links.groupBy(F.col(source).alias("__s")).agg(F.min(target).alias("__t"))
    rows = start.select(F.col(key), F.col(key).alias("end"), F.lit(0).alias("hops"))
    for k in range(hops):
        step = unique.select(F.col("__s").alias(f"__s{k}"), F.col("__t").alias(f"__t{k}"))
        met = rows.join(step, F.col("end") == F.col(f"__s{k}"), "left")
        rows = met.select(key, F.coalesce(f"__t{k}", "end").alias("end"), (F.col("hops") + F.col(f"__t{k}").isNotNull().cast("int")).alias("hops"))
    return rows


def probe_map(provenance: Column, keys: Sequence[Column]) -> Column:
    """The value of the first of several keys that a map has."""
    return F.coalesce(*(F.try_element_at(provenance, k) for k in keys))


def likely_open(files: DataFrame, group: str, path: str, index: str) -> DataFrame:
    """The file with the highest index of a group, which may still be written."""
    return files.groupBy(group).agg(F.max_by(path, index).alias(path))


def unknown_labels(labels: DataFrame, label: str, taxonomy: DataFrame) -> DataFrame:
    """Labels outside the taxonomy and how often they occur."""
    return labels.join(taxonomy.select(label).distinct(), label, "left_anti").groupBy(label).agg(F.count("*").alias("n"))


def coverage(targets: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row: targets, covered, percent."""
    marked = targets.select(key).distinct().join(found.select(key).distinct().withColumn("hit", F.lit(1)), key, "left")
    return marked.agg(F.count("*").alias("targets"), F.count("hit").alias("covered")).withColumn("percent", F.round(100 * F.try_divide(F.col("covered"), F.col("targets")), 2))


def inverted(df: DataFrame, key: str, value: str) -> DataFrame:
    """value, keys: sorted and distinct. An array has all keys of a value, which is what an inverted index is."""
    pairs = df.where(F.col(value).isNotNull()).select(value, key).distinct()
    return pairs.groupBy(value).agg(F.array_sort(F.collect_list(key)).alias("keys"))


def seed_fan_out(prompts: DataFrame, prompt: str, key: str, seeds: DataFrame, seed: str) -> DataFrame:
    """prompt, keys: everyone who shares a prompt's seed, or the prompt's own key."""
    sharers = seeds.groupBy(seed).agg(F.array_sort(F.collect_set(key)).alias("keys"))
    return prompts.join(sharers, seed, "left").select(prompt, F.coalesce("keys", F.array(key)).alias("keys"))


def fold_accents(text: Column, table: Mapping[str, str]) -> Column:
    """Lower-case with the accents of a table folded; other characters stay."""
    return F.translate(F.lower(text), "".join(table), "".join(table.values()))


def keyword_score(text: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords occur."""
    return F.aggregate(F.array(*(F.lit(k) for k in keywords)), F.lit(0), lambda n, k: n + F.contains(text, k).cast("int"))
