"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and the controls from tab to carriage return. ``bytes.split()`` uses the same set.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary one; a cluster must
    name a folder that all executors share."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandline-"))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back, so that a lost executor costs no rerun."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As ``materialize``, as a Parquet table in the same folder: compressed, and read by column. It goes when the driver ends."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.parquet(path)


_ORDERED = re.compile(r"Exchange|Aggregate|Join|Sort|Window|Generate|Existing RDD|MapIn|Python|Limit|Sample|Union|Rebalance", re.I)


def stable(df: DataFrame) -> DataFrame:
    """``df`` if it is read from files row by row, so that a row's partition and place in it are the same in every pass; else
    ``df`` written once. Operators that number rows by position need that."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return materialize(df) if _ORDERED.search(plan) else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def id_crc(col: str | Column) -> Column:
    """CRC-32 of the identifier written in decimal; a null identifier counts as the empty text."""
    return F.crc32(F.coalesce(id_text(col), F.lit("")).cast("binary"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text, null as empty. Handing bytes to Python saves decoding them."""
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, or that with a number, so that it clashes with no column of the caller (names compare caselessly)."""
    low, name, k = {x.lower() for x in taken}, wanted, 0
    while name.lower() in low:
        k += 1
        name = f"{wanted}_{k}"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what is held as Python objects stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def small_batches(spark: SparkSession, rows: int = 2048) -> None:
    """From now on at most ``rows`` rows a batch between Spark and Python in this session, so that texts held on the way take
    little of an executor's memory. A smaller number that is set already stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))
