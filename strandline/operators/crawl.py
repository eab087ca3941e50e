"""Choosing sites, pages and states from a crawl's logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.relational import argmax_by


def winner_site(pages: DataFrame, key: str, site: str, size: str, expected: Column | None = None) -> DataFrame:
    """key, site, pages, bytes: the site that is expected, has most pages, most bytes, and the largest name, in that order."""
    grouped = pages.withColumn("__e", (expected if expected is not None else F.lit(False)).cast("int")).groupBy(key, site).agg(F.max("__e").alias("e"), F.count("*").alias("pages"), F.sum(size).alias("bytes"))
    return argmax_by(grouped, key, [F.col("e"), F.col("pages"), F.col("bytes"), F.col(site)]).select(key, site, "pages", "bytes")


def page_order(pages: DataFrame, key: str, landing: Column, newest: str, url: str, record: str) -> DataFrame:
    """``pages`` with rank: the landing page first (landing, newest, url, record, all descending), then the other pages in the
    same order. Pages without text are left out before, so the next page is promoted when the landing page has none."""
    order = [landing.cast("int").desc(), F.col(newest).desc_nulls_last(), F.col(url).desc(), F.col(record).desc()]
    return pages.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def conflicts(pages: DataFrame, key: str, site: str) -> DataFrame:
    """Keys that map to more than one site: key, sites."""
    return pages.groupBy(key).agg(F.countDistinct(site).alias("sites")).where("sites > 1")


def progress(seeds: DataFrame, seed: str, pages: DataFrame, reports: DataFrame, status: str, ordinal: str) -> DataFrame:
    """seed, pages, state: DONE with pages, else by the last report (skipped, failed, other: ATTEMPTED), else NEVER."""
    got = pages.groupBy(seed).agg(F.count("*").alias("pages"))
    last = reports.groupBy(seed).agg(F.max_by(status, ordinal).alias("last"))
    rows = seeds.select(seed).distinct().join(got, seed, "left").join(last, seed, "left")
    state = F.when(F.col("pages") > 0, "DONE").when(F.col("last") == "skipped", "SKIPPED").when(F.col("last") == "failed", "FAILED").when(F.col("last").isNotNull(), "ATTEMPTED").otherwise("NEVER")
    return rows.select(seed, F.coalesce("pages", F.lit(0)).cast("long").alias("pages"), state.alias("state"))


#: States in the order of a report.
STATES = ("DONE", "SKIPPED", "FAILED", "ATTEMPTED", "NEVER")


def state_order(state: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in STATES)), state)


def changed_keys(rows: DataFrame, key: str, origin: str, reused: str = "reused_from_store") -> DataFrame:
    """Keys with at least one page that wasn't reused."""
    return rows.groupBy(key).agg(F.bool_or(F.coalesce(F.col(origin), F.lit("")) != reused).alias("any")).where("any").select(key)


def variant_winner(variants: DataFrame, target: str, strict: str, subpages: str, landing_len: str) -> DataFrame:
    """Per target the strict host if its landing page has 400 characters or no other variant's is 200 longer; else the best
    other by (subpages, landing length)."""
    order = F.struct(F.col(subpages), F.col(landing_len), F.col("variant"))
    own = F.struct("variant", subpages, landing_len)
    pair = variants.groupBy(target).agg(F.max_by(own, F.when(F.col(strict), order)).alias("s"), F.max_by(own, F.when(~F.col(strict), order)).alias("o"))
    keep = F.col("s").isNotNull() & (F.col("o").isNull() | (F.col(f"s.{landing_len}") >= 400) | (F.col(f"o.{landing_len}") < F.col(f"s.{landing_len}") + 200))
    return pair.select(target, F.when(keep, F.col("s")).otherwise(F.coalesce("o", "s")).alias("w")).select(target, "w.*")
