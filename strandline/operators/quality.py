"""Metrics and integrity checks as DataFrames: a check is a query whose rows are its violations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metrics(df: DataFrame, named: Mapping[str, Column]) -> DataFrame:
    """One row: how many rows satisfy each condition."""
    return df.agg(F.count("*").alias("n_rows"), *(F.count_if(c).alias(n) for n, c in named.items()))


def partition_violations(df: DataFrame, key: str, classes: Mapping[str, Column]) -> DataFrame:
    """Keys that fall into no class or into several."""
    hits = sum((F.coalesce(c, F.lit(False)).cast("int") for c in classes.values()), F.lit(0))
    return df.select(key, hits.alias("classes")).where("classes <> 1")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().where("count > 1").select(F.col(key), F.col("count").alias("times"))


def streams_per_member(df: DataFrame, member: str, stream: str) -> DataFrame:
    """Members that occur in more than one stream."""
    return df.groupBy(member).agg(F.countDistinct(stream).alias("streams")).where("streams > 1")


def artifact_differences(expected: DataFrame, actual: DataFrame, key: str, checks: list[str]) -> DataFrame:
    """key, problem: missing, extra, or the first column of ``checks`` that differs; a null expectation is a difference."""
    a = expected.select(key, *(F.col(c).alias(f"e_{c}") for c in checks), F.lit(True).alias("e"))
    b = actual.select(key, *(F.col(c).alias(f"a_{c}") for c in checks), F.lit(True).alias("a"))
    problem = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra")
    for c in checks:
        problem = problem.when(F.col(f"e_{c}").isNull() | ~F.col(f"e_{c}").eqNullSafe(F.col(f"a_{c}")), c)
    return a.join(b, key, "full_outer").select(key, problem.alias("problem")).where("problem is not null")


def gate(counters: DataFrame) -> DataFrame:
    """One row of counters: passes only if all are zero; blockers names the others."""
    named = [F.when(F.coalesce(F.col(c), F.lit(0)) != 0, F.lit(c)) for c in counters.columns]
    blockers = F.array_compact(F.array(*named))
    return counters.select((F.size(blockers) == 0).alias("passes"), blockers.alias("blockers"))


def classify_refs(rows: DataFrame, record: str, warc: str, broken: DataFrame) -> DataFrame:
    """``rows`` with state: passthrough (no reference), invalid (half a reference), skipped (into a broken file), kept."""
    bad = broken.select(F.col("warc").alias("__b")).distinct()
    joined = rows.join(bad, F.col(warc) == F.col("__b"), "left")
    none, half = F.col(record).isNull() & F.col(warc).isNull(), F.col(record).isNull() | F.col(warc).isNull()
    return joined.withColumn("state", F.when(none, "passthrough").when(half, "invalid").when(F.col("__b").isNotNull(), "skipped").otherwise("kept")).drop("__b")


def needs_check(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files without an unchanged, healthy state (by path, size and time)."""
    ok = state.where("status = 'ok'").select("path", "length", "modificationTime")
    return files.join(ok, ["path", "length", "modificationTime"], "left_anti")
