"""Writers. Spark's committer makes each write atomic; names carry a content hash where a part may be written twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _entry(key: str, value: str) -> Column:
    return F.to_json(F.create_map(F.col(key).cast("string"), F.col(value)), {"ignoreNullFields": "false"})


def keyed_json(df: DataFrame, path: str, key: str, value: str, gzip: bool = False) -> None:
    """One object ``{key: value}`` a line, in the order of keys; ``readers.keyed_json`` reads it back. Null values are written."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), _entry(key, value).alias("value"))
    rows.repartitionByRange("k").sortWithinPartitions("k").select("value").write.mode("overwrite").option("compression", "gzip" if gzip else "none").text(path)


def keyed_json_object(df: DataFrame, path: str, key: str, value: str, metadata: Column | None = None, gzip: bool = False) -> None:
    """One file with one object, as the pipeline's other tools read it; with ``metadata``, an envelope that has the rows under
    "data". The lines of the object stream through one task, which is meant for tables of registry size."""
    entry = _entry(key, value)
    rows = df.where(F.col(key).isNotNull()).select(F.lit(1).alias("part"), F.col(key).cast("string").alias("k"), F.concat(entry.substr(F.lit(2), F.length(entry) - 2), F.lit(",")).alias("value"))
    opened = F.lit("{") if metadata is None else F.concat(F.lit('{"metadata": '), F.to_json(metadata), F.lit(', "data": {'))
    edge = lambda part, text: df.sparkSession.range(1).select(F.lit(part).alias("part"), F.lit("").alias("k"), text.alias("value"))
    last = rows.agg(F.max("k").alias("last"))
    rows = rows.join(F.broadcast(last), F.col("k") == F.col("last"), "left").withColumn("value", F.when(F.col("last").isNull(), F.col("value")).otherwise(F.regexp_replace("value", ",$", ""))).drop("last")
    whole = edge(0, opened).unionByName(rows).unionByName(edge(2, F.lit("}" if metadata is None else "}}")))
    whole.coalesce(1).sortWithinPartitions("part", "k").select("value").write.mode("overwrite").option("compression", "gzip" if gzip else "none").text(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def site_texts(pages: DataFrame, path: str, site: str, text: str, rank: str) -> None:
    """One text per site, the landing page first, in a folder per site."""
    joined = pages.groupBy(site).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, text))), lambda x: x[text]), "\n\n").alias("value"))
    joined.write.mode("overwrite").partitionBy(site).text(path)


def request_parts(tasks: DataFrame, path: str, stream: str, part: str, line: str, ordinal: str) -> DataFrame:
    """Request lines in a folder per stream and part; returns the manifest: stream, part, requests, bytes, ids_sha256."""
    tasks.select(F.col(stream), F.col(part), F.col(line).alias("value"), F.col(ordinal)).repartition(stream, part).sortWithinPartitions(stream, part, ordinal).drop(ordinal).write.mode("overwrite").partitionBy(stream, part).text(path)
    return manifest(tasks, stream, part, line)


def manifest(tasks: DataFrame, stream: str, part: str, line: str, ids: str = "prompt_id") -> DataFrame:
    from strandline.operators.relational import id_set_fingerprints

    sums = tasks.groupBy(stream, part).agg(F.count("*").alias("requests"), F.sum(F.octet_length(line) + 1).alias("bytes"))
    return sums.join(id_set_fingerprints(tasks, [stream, part], ids).drop("n"), [stream, part])


def rotate_backups(spark: SparkSession, path: str, keep: int = 5) -> list[str]:
    """Copies a file or folder beside itself under the time, and deletes all but the last ``keep`` copies; returns their names."""
    import datetime

    hadoop = spark._jvm.org.apache.hadoop.fs
    source, conf = hadoop.Path(path), spark._jsc.hadoopConfiguration()
    fs = source.getFileSystem(conf)
    stamp = datetime.datetime.now(datetime.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    hadoop.FileUtil.copy(fs, source, fs, hadoop.Path(f"{path}.{stamp}.bak"), False, conf)
    names = sorted(str(s.getPath().getName()) for s in fs.globStatus(hadoop.Path(f"{path}.*.bak")))
    for old in names[:-keep]:
        fs.delete(hadoop.Path(source.getParent(), old), True)
    return names[-keep:]
