"""Sharding by a two-pass external shuffle, in DataFrame functions only.

*First pass.* Records are scattered uniformly over buckets by a seeded hash of their position (partition and place in it), so
equal rows and rows without an identifier spread like any others. The number of buckets follows the bytes of the table, so that
a bucket fits in the memory of a task. Records of a bucket meet in one partition that holds no other bucket.

*Second pass.* Each bucket is put into the order of the positions and shuffled by Fisher-Yates with a seed of its own (the seed
of ``shuffle`` and the partition's number), so a rerun after a lost executor gives the same order. With the number of records
before each bucket, a record gets its place in the whole permutation. These numbers are sums in two levels, over runs of
``RUN`` buckets and within each, so no task sees all buckets.

*Shards.* Place p goes to shard p mod n as slot p div n: the counts of shards differ by one at most (law ``rows``), and slots
have no gaps. ``write_shards`` writes a folder per shard, sorted by slot.

Positions must be the same in both passes. They are for a table read from files; any other input is written once before
(``stable``). Null texts count as empty for size and checksum and stay null. Repeated rows are records of their own, and so are
rows with null identifiers. A text longer than a bucket has a bucket to itself in effect, as buckets are sized by the mean. No
column is compared, so maps are allowed. Empty tables give no shards. Columns that clash with the added ones are kept; the added
ones take free names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, stable

SHARDS = 16
SEED = 42
BUCKET_BYTES = 32 << 20
RUN = 1024


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of a text and one more; null has none."""
    return F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long") + 1


def text_crc(text: str = "text") -> Column:
    return F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))


def bucket_of(position: Column, seed: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64(position, F.lit(seed)), F.lit(buckets)).cast("int")


def starts(counts: DataFrame) -> DataFrame:
    """``counts``: bucket, count. b, before: the records in all buckets before."""
    runs = counts.withColumn("run", F.expr(f"bucket div {RUN}"))
    sums = runs.groupBy("run").agg(F.sum("count").alias("n"))
    earlier = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # a row for each RUN buckets
    first = sums.select(F.col("run").alias("r"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    within = Window.partitionBy("run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    own = runs.select("bucket", "run", F.coalesce(F.sum("count").over(within), F.lit(0)).alias("own"))
    return own.join(first, own["run"] == first["r"]).select(F.col("bucket").alias("b"), (F.col("first") + F.col("own")).alias("before"))


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with the columns shard and slot (or free names after these)."""
    own = [f"c{k}" for k in range(len(docs.columns))]
    at_text = own[docs.columns.index(text)]
    rows = stable(docs.toDF(*own))
    size = rows.agg(F.sum(text_size(at_text)).alias("bytes")).first()["bytes"] or 0
    buckets = max(1, -(-size // bucket_bytes))
    placed = rows.withColumn("pos", F.monotonically_increasing_id())
    bucket = bucket_of(F.col("pos"), seed, buckets).alias("bucket")
    before = materialize(starts(placed.select(bucket).groupBy("bucket").count()))
    dealt = placed.select(bucket, F.struct("pos", *own).alias("record")).repartitionById(buckets, F.col("bucket"))
    by_position = lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)
    whole = dealt.groupBy("bucket").agg(F.array_sort(F.collect_list("record"), by_position).alias("records"))
    mixed = whole.select("bucket", F.shuffle("records", seed).alias("records"))
    out = mixed.join(before, mixed["bucket"] == before["b"]).select("before", F.posexplode("records").alias("k", "record"))
    place = F.col("before") + F.col("k")
    shard, slot = free_name(docs.columns, "shard"), free_name(docs.columns, "slot")
    return out.select(*(f"record.{c}" for c in own), F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot")).toDF(*docs.columns, shard, slot)


def write_shards(sharded: DataFrame, path: str, shards: int = SHARDS, shard: str = "shard", slot: str = "slot") -> None:
    """One folder per shard; each file holds a range of slots in order, so reading files by name reads the shard in order."""
    sharded.repartitionByRange(max(shards, int(sharded.sparkSession.conf.get("spark.sql.shuffle.partitions"))), shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
