"""From documents to token ids: quality rules, exact dedup, near dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes each stage's result as Parquet under the shared checkpoint folder and hands the reread table to the next. A
stage's table is deleted once the next is written, the last one when the driver ends.

Rows may have null or repeated identifiers, null, empty and very long texts, and further columns; each operator's docstring says
what becomes of them. Quality rules reject texts without words, and so null ones; of equal and of near texts one row stays,
under the smallest identifier; a row that is mixed in twice is there twice. An empty table gives an empty table with the columns
of ``documents`` and the token ids.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandline.llm import byte_bpe, exact_dedup, mixing, quality_rules, simhash
from strandline.llm.common import ensure_checkpoint_dir, read_table, small_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality_rules.clean_good(docs, chars="n_chars" if "n_chars" in docs.columns else None)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mixing.mix(docs, mixing.label_domains(read_table(spark, sf_dir, "labels")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of ``documents`` and the token ids."""
    small_batches(spark)
    vocabulary = byte_bpe.share(spark, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return byte_bpe.encode(docs, vocabulary)


STAGES = [
    ("quality_rules", keep_good),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", tokens),
]

#: SQL expresses neither the fingerprints nor the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents`` under ``sf_dir``."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    path_of = lambda k: f"{folder}/{k}-{STAGES[k][0]}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path_of(k))
        docs = spark.read.parquet(path_of(k))
        if k:
            old = spark._jvm.org.apache.hadoop.fs.Path(path_of(k - 1))
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
