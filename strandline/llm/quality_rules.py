"""Quality rules with cross-document line frequency.

One pass over the texts counts the base figures and hashes each line (its words, A-Z lower-cased, joined by single spaces;
XXH3, 128 bits). Lines are then counted per host by the distinct documents that have them, where documents with equal texts
count once, so that copies of a page don't make its own lines look like a template. A line is *frequent* on a host when more
than ``LIMIT`` documents have it. The limit is a number, not a share: whether a line is a template doesn't depend on how many
other documents its host has. A document is depleted, and rejected, if without its frequent lines less than ``MIN_WORDS`` words
or less than ``LEFT`` of its words remain; so is one that fails the base rules. ``judge`` counts, ``clean_good`` returns the
accepted texts without their frequent lines, and ``keep_good`` returns them as they were.

The counts are aggregates with partial sums, so a line of half the corpus costs one row a task. Lines meet the frequent ones
in an equi-join whose small side holds frequent lines only; Spark splits its skewed keys.

The host of a document is the column named by ``host``, ``source`` by default; null is a host of its own. Null text: no words.
Repeated rows are judged each; they count as one document. Documents without words fail the base rules. Null identifiers stay.
Very long texts are profiled one at a time. Empty tables give empty results. Other columns keep their values and names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .common import SPACE_BYTES, free_name, materialize, slices, text_bytes
from .exact_dedup import code_points

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50
LIMIT = 20
LEFT = 0.3

_LINE = pa.struct([("hash", pa.binary()), ("words", pa.int32())])
PROFILE = StructType([
    StructField("row", LongType()), StructField("text_hash", BinaryType()),
    *(StructField(n, LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    StructField("lines", ArrayType(StructType([StructField("hash", BinaryType()), StructField("words", IntegerType())]))),
])


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    hit = np.fromiter((times[w] > 1 for w in windows), bool, len(windows))
    cover = np.zeros(len(words), bool)
    for k in range(3):
        cover[k:k + len(windows)] |= hit
    return int(cover.sum())


def profile(raw: bytes) -> tuple:
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, SPACE_BYTES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen, repeats, lines = set(), 0, {}
    for line in raw.split(b"\n"):
        own = line.lower().split()
        if not own:
            continue
        repeats += line in seen
        seen.add(line)
        key = xxhash.xxh3_128_digest(b" ".join(own))
        lines[key] = lines.get(key, 0) + len(own)
    found = [{"hash": k, "words": n} for k, n in lines.items()]
    return xxhash.xxh3_128_digest(raw), len(words), code_points(raw) - spaces, symbols, repeats, repeated_words(words), found


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 36
    kinds = [pa.binary(), *[pa.int64()] * 5, pa.list_(_LINE)]
    for batch in slices(batches):
        got = [profile(raw) for raw in batch.column(batch.num_columns - 1).to_pylist()]
        cols = [pa.array(c, k) for c, k in zip(zip(*got) if got else [[]] * 7, kinds)]
        rows = pa.array(np.arange(row, row + batch.num_rows))
        row += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], rows, *cols], [*batch.schema.names[:-1], *PROFILE.names])


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", limit: int = LIMIT, left: float = LEFT) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base figures, base_failed, n_frequent_words, kept."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), text_bytes(text).alias("body"))
    return _judge(rows, limit, left).drop("host", "row", "frequent")


def _judge(rows: DataFrame, limit: int, left: float) -> DataFrame:
    seen = materialize(rows.mapInArrow(_profiles, StructType([*rows.schema.fields[:-1], *PROFILE.fields])))
    texts = seen.groupBy("host", "text_hash").agg(F.first("lines").alias("lines"))
    counts = texts.select("host", F.explode("lines.hash").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("docs"))
    frequent = counts.where(F.col("docs") > limit).select(F.col("host").alias("on"), F.col("hash").alias("frequent"))
    lines = seen.select("row", "host", F.explode("lines").alias("line"))
    removed = lines.join(frequent, F.col("host").eqNullSafe(F.col("on")) & (F.col("line.hash") == F.col("frequent"))).groupBy("row").agg(F.sum("line.words").alias("n_frequent_words"), F.collect_list("frequent").alias("frequent"))
    out = seen.drop("lines", "text_hash").join(removed, "row", "left").withColumn("n_frequent_words", F.coalesce("n_frequent_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    remain = F.col("n_words") - F.col("n_frequent_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (remain >= MIN_WORDS) & (remain >= left * F.col("n_words")))


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged.

    A verdict holds for all rows with the same identifier, host and text, so rejected rows are told by identifier and, where
    an identifier has both verdicts, by the hash of the text.
    """
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc_id"), F.col(host).cast("string").alias("host"), text_bytes(text).alias("body"))
    verdicts = materialize(_judge(rows, LIMIT, LEFT).groupBy("doc_id").agg(F.bool_or("kept").alias("some"), F.bool_and("kept").alias("all")))
    key = free_name(docs.columns, "key")
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    bad = verdicts.where("not all").select(F.col("doc_id").alias(key))
    kept = docs.join(bad, ident == F.col(key), "left_anti")
    mixed = verdicts.where("some and not all").select(F.col("doc_id").alias(key))
    if mixed.isEmpty():
        return kept
    again = docs.join(mixed, ident == F.col(key), "left_semi")
    return kept.union(_by_text(again, docs, doc_id, text, host))


def without_lines(raw: bytes, gone: set[bytes]) -> bytes:
    """``raw`` without the lines whose hashes are given; all other bytes stay."""
    return b"\n".join(line for line in raw.split(b"\n") if not (own := line.lower().split()) or xxhash.xxh3_128_digest(b" ".join(own)) not in gone)


def _each_without(body: pd.Series, gone: pd.Series) -> pd.Series:
    return pd.Series([None if raw is None else without_lines(raw, set(lines)) for raw, lines in zip(body, gone)], dtype=object)


def clean_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", limit: int = LIMIT, left: float = LEFT, chars: str | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, their texts without frequent lines; ``chars`` names a column that has the text's length.

    Verdict and lines depend on host and text alone. Rows that are rejected or have frequent lines are found by identifier,
    host and SHA-256 of the text, so that neither copies nor null identifiers gather under one key; texts move once.
    """
    own = [f"c{k}" for k in range(len(docs.columns))]
    at = docs.columns.index
    flat = docs.toDF(*own)
    ident, on, body = F.coalesce(F.col(own[at(doc_id)]).cast("string"), F.lit("")), F.col(own[at(host)]).cast("string"), text_bytes(own[at(text)])
    judged = _judge(flat.select(ident.alias("doc_id"), F.sha2(body, 256).alias("sum"), on.alias("host"), body.alias("body")), limit, left)
    touched = judged.where("not kept or frequent is not null").groupBy(F.col("doc_id").alias("i"), F.col("sum").alias("s"), F.col("host").alias("h")).agg(F.bool_and("kept").alias("ok"), F.first("frequent").alias("gone"))
    rows = flat.join(touched, (ident == F.col("i")) & (F.sha2(body, 256) == F.col("s")) & on.eqNullSafe(F.col("h")), "left").where(F.coalesce("ok", F.lit(True)))
    cleaned = F.pandas_udf(_each_without, BinaryType())(F.when(F.col("gone").isNotNull(), body), F.col("gone"))
    rows = rows.select(*own, cleaned.alias("cleaned"))
    new = {text: F.coalesce(F.col("cleaned").cast("string"), F.col(own[at(text)]))}
    if chars:
        new[chars] = F.when(F.col("cleaned").isNotNull(), F.length(F.col("cleaned").cast("string"))).otherwise(F.col(own[at(chars)])).cast(docs.schema[chars].dataType)
    return rows.select(*(new.get(c, F.col(o)).alias(o) for c, o in zip(docs.columns, own))).toDF(*docs.columns)


def _by_text(again: DataFrame, docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    own = [f"c{k}" for k in range(len(docs.columns))]
    at = docs.columns.index
    flat = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc_id"), F.col(host).cast("string").alias("host"), text_bytes(text).alias("body"))
    hashed = flat.withColumn("sum", F.sha2("body", 256)).select("doc_id", "sum", "host", "body")
    good = _judge(hashed, LIMIT, LEFT).where("kept").select(F.col("doc_id").alias("i"), F.col("sum").alias("s"), F.col("host").alias("h")).distinct()
    rows = again.toDF(*own)
    same = (F.coalesce(F.col(own[at(doc_id)]).cast("string"), F.lit("")) == F.col("i")) & (F.sha2(text_bytes(own[at(text)]), 256) == F.col("s")) & F.col(own[at(host)]).cast("string").eqNullSafe(F.col("h"))
    return rows.join(good, same, "left_semi").toDF(*docs.columns)
