"""From pages to labels: prompts under a budget, answers to maps, and the merge of all label sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import crawl, relational


def page_texts(pages: DataFrame, key: str, url: str, captured: str, record: str, text: str, landing: Column) -> DataFrame:
    """The newest capture of each page (by URL key), pages without text left out, ranked: the landing page first."""
    rows = pages.where(F.coalesce(F.trim(F.col(text)), F.lit("")) != "")
    newest = relational.latest_by(rows.withColumn("__o", F.xxhash64(record)), [key, url], captured, "__o").drop("__o")
    return crawl.page_order(newest, key, landing, captured, url, record)


def payloads(ranked: DataFrame, key: str, url: str, text: str, cost: Column, budget: int) -> DataFrame:
    """key, body, tokens, payload_sha256: page texts in order within a budget; the page that crosses it is cut in proportion."""
    costed = relational.budget_prefix(ranked.withColumn("cost", cost.cast("long")), key, [F.col("rank")], "cost", budget, "granted").where("granted > 0")
    part = F.when(F.col("granted") < F.col("cost"), F.substring(F.col(text), F.lit(1), F.floor(F.length(text) * F.col("granted") / F.col("cost")).cast("int"))).otherwise(F.col(text))
    item = F.struct("rank", F.concat(F.lit("URL: "), F.col(url), F.lit("\n"), part).alias("t"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "\n\n")
    out = costed.groupBy(key).agg(body.alias("body"), F.sum("granted").alias("tokens"))
    return out.withColumn("payload_sha256", F.sha2("body", 256))


def unique_prompts(bodies: DataFrame, key: str) -> DataFrame:
    """payload_sha256, prompt_id (smallest key), keys: one prompt per distinct payload, with everyone it stands for."""
    return bodies.groupBy("payload_sha256").agg(F.min(key).alias("prompt_id"), F.array_sort(F.collect_set(key)).alias("keys"), F.first("tokens").alias("tokens"))


def fan_out(answers: DataFrame, prompts: DataFrame, prompt: str = "prompt_id", keys: str = "keys", labels: str = "categories") -> DataFrame:
    """key, category: an answer counts for every key its prompt stands for."""
    return prompts.select(prompt, F.explode(keys).alias("key")).join(answers, prompt).select("key", F.explode(labels).alias("category")).distinct()


def merge_labels(parts: list[tuple[str, DataFrame]], key: str = "asn", label: str = "category") -> DataFrame:
    """asn, category, provenance. Parts from lowest to highest priority; a later part replaces the key's whole record."""
    folded = [p.groupBy(key).agg(F.array_sort(F.collect_set(label)).alias("categories")).withColumn("provenance", F.lit(n)) for n, p in parts]
    merged = relational.precedence_merge(folded, key)
    return merged.select(key, F.explode("categories").alias(label), "provenance")


def with_siblings(labels: DataFrame, groups: DataFrame, key: str = "asn", group: str = "org_id", label: str = "category") -> DataFrame:
    """``labels`` and what numbers of the same organisation add, with provenance."""
    held = labels.select(key, label).join(groups.select(key, group), key)
    members = groups.select(key, group)
    more = relational.inherit_within_group(held.select(key, group, label), key, group, label)
    bare = members.join(held.select(key).distinct(), key, "left_anti").join(held.groupBy(group, label).agg(F.array_sort(F.collect_set(F.col(key).cast("string"))).alias("h")), group)
    note = F.concat(F.lit("Inherit from "), F.array_join("h", ", "))
    return labels.select(key, label, "provenance").unionByName(more.select(key, label, F.col("note").alias("provenance"))).unionByName(bare.select(key, label, note.alias("provenance")))


def overlap(parts: list[tuple[str, DataFrame]], key: str = "asn") -> DataFrame:
    """Keys that several parts label, with the parts' names."""
    named = None
    for n, p in parts:
        own = p.select(key).distinct().withColumn("part", F.lit(n))
        named = own if named is None else named.unionByName(own)
    return named.groupBy(key).agg(F.array_sort(F.collect_set("part")).alias("parts")).where(F.size("parts") > 1)


def organisation_reasons(desc: Column, p31: Column, props: Column, similarity: Column, org_props: list[str], org_words: str, other_words: str, floor: float = 0.34) -> Column:
    """Why an article isn't about the organisation: nothing of one in its data, something else in its description, or a title
    too far from the name. Empty: accepted."""
    low = F.lower(F.coalesce(desc, F.lit("")))
    known = F.arrays_overlap(F.coalesce(props, F.array().cast("array<string>")), F.array(*(F.lit(p) for p in org_props))) | low.rlike(org_words)
    reasons = F.array(F.when(~F.coalesce(known, F.lit(False)), "not_organisation"), F.when(low.rlike(other_words), "other_subject"), F.when(F.coalesce(F.size(p31), F.lit(0)) <= 0, "no_type"), F.when(similarity < floor, "title_differs"))
    return F.array_compact(reasons)
