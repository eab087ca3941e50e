"""Append-only logs as streams: tail reads, stateful deduplication, latest state, and the windows the event table invites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tail(spark: SparkSession, path: str, schema: str, max_files: int = 1000) -> DataFrame:
    """New JSON lines of a growing folder; what was read is held by the query's checkpoint. Broken lines are left out."""
    options = {"maxFilesPerTrigger": str(max_files), "mode": "DROPMALFORMED"}
    return spark.readStream.schema(schema).options(**options).json(path)


def first_of_content(stream: DataFrame, keys: list[str], event_time: str | None = None, keep: str = "7 days") -> DataFrame:
    """The first row of each key. With an event time the state is dropped after ``keep``; else it grows with the keys."""
    if event_time:
        return stream.withWatermark(event_time, keep).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def windowed_counts(stream: DataFrame, event_time: str, width: str, late: str, *keys: str) -> DataFrame:
    return stream.withWatermark(event_time, late).groupBy(F.window(event_time, width), *keys).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, event_time: str, gap: str, late: str, key: str) -> DataFrame:
    return stream.withWatermark(event_time, late).groupBy(F.session_window(event_time, gap), key).agg(F.count("*").alias("n"))


def upsert_latest(batch: DataFrame, table: str, key: str, newest: str) -> None:
    """For ``foreachBatch``: the newest row of each key of a Parquet table and a batch becomes the table's next version.

    Versions are folders ``v<number>``; readers take the last complete one, and a batch that is run again writes the same.
    """
    spark = batch.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(fs_path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))) if fs.exists(fs_path) else []
    rows = batch if not done else batch.unionByName(spark.read.parquet(f"{table}/v{done[-1]}"))
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(newest, *[c for c in rows.columns if c not in (key, newest)])).alias("b")).select("b.*")
    best.write.mode("overwrite").parquet(f"{table}/v{done[-1] + 1 if done else 0}")


def latest_table(spark: SparkSession, table: str) -> DataFrame:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    last = max(int(s.getPath().getName()[1:]) for s in fs.listStatus(fs_path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    return spark.read.parquet(f"{table}/v{last}")


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; a later call goes on where this one ended."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
