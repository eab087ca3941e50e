"""The queries of the training-data operators, one ``opN_<name>`` each, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, byte_cnn, exact_dedup, maxent_lm, mixing, pii, quality_rules, sharding, simhash, url_filter
from .common import read_table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(read_table(spark, sf_dir, "documents"), mixing.label_domains(read_table(spark, sf_dir, "labels")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = byte_bpe.share(spark, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    ids = byte_bpe.encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).drop("text")
    rows = byte_bpe.decode(ids, vocabulary)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return byte_cnn.classify(read_table(spark, sf_dir, "documents").select("doc_id", "text"), labels)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents"))


def op7_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score_documents(read_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(read_table(spark, sf_dir, "documents")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shuffle_into_shards(read_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", sharding.text_size().alias("size"), sharding.text_crc().alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {f.__name__: f for f in (op1_mixing, op2_simhash, op3_byte_bpe, op4_byte_cnn, op5_url_filter, op6_quality_rules, op7_maxent_lm, op8_exact_dedup, op9_pii, op10_sharding)}
