"""Every operator on nulls, empty, blank and long texts, repeated rows, clashing column names, and empty tables."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import byte_bpe, byte_cnn, exact_dedup, maxent_lm, mixing, pii, quality_rules, sharding, simhash, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, shard int, fp long, C0 string, key string"
WORDS = [f"{a}{b}" for a in ("tha", "ner", "ing", "ost", "bel") for b in ("on", "er", "is", "at", "um", "ed", "al")]


def prose(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def rows():
    texts = [prose(k, 80) for k in range(12)] + [None, "", " \n\t ", "one", "one two", "one two three", "a" * 30_000, prose(99, 6000), "日本語 é 😀 " * 30, "퟿ \x0b x"]
    out = [(k, t, "en", "host", None, "d", 1, 2, "c", "k") for k, t in enumerate(texts)]
    out += [out[0], out[0], (None, texts[0], None, None, 5, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return out + [(3, "another text under a used identifier " + prose(7, 60), "en", None, 1, "d", 1, 2, "c", "k")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, int(k % 5 == 0)) for k in range(10)] + [(None, 1, 0), (3, 1, None), (77, 1, 1)], "doc_id long, quality int, toxic int")


def vocabulary(spark):
    return byte_bpe.share(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


OPERATORS = {
    "mixing": lambda s, d, l: mixing.mixing_rates(d, mixing.label_domains(l)),
    "mix": lambda s, d, l: mixing.mix(d, mixing.label_domains(l)),
    "simhash": lambda s, d, l: simhash.near_duplicates(d),
    "simhash_drop": lambda s, d, l: simhash.drop_near_duplicates(d),
    "bpe": lambda s, d, l: byte_bpe.decode(byte_bpe.encode(d, vocabulary(s)), vocabulary(s)),
    "cnn": lambda s, d, l: byte_cnn.classify(d, l.select("doc_id", F.col("quality").alias("label"))),
    "url": lambda s, d, l: url_filter.judge_urls(d, "doc_id", "text"),
    "rules": lambda s, d, l: quality_rules.judge(d),
    "rules_keep": lambda s, d, l: quality_rules.keep_good(d),
    "lm": lambda s, d, l: maxent_lm.score_documents(d),
    "exact": lambda s, d, l: exact_dedup.exact_duplicates(d),
    "exact_drop": lambda s, d, l: exact_dedup.drop_exact_duplicates(d),
    "pii": lambda s, d, l: pii.digest(pii.find_pii(d)),
    "redact": lambda s, d, l: pii.redact(d),
    "shards": lambda s, d, l: sharding.shuffle_into_shards(d),
}
SAME_ROWS = {"mixing", "simhash", "bpe", "cnn", "url", "rules", "lm", "exact", "pii", "redact", "shards"}
SAME_COLUMNS = {"mix", "simhash_drop", "rules_keep", "exact_drop"}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, docs, labels, name):
    out = OPERATORS[name](spark, docs, labels)
    got = out.collect()
    if name in SAME_ROWS:
        assert len(got) == docs.count()
    else:
        assert 0 < len(got) and (name == "mix" or len(got) <= docs.count())
    if name in SAME_COLUMNS:
        assert out.columns == docs.columns
        assert {tuple(r) for r in got} <= {tuple(r) for r in docs.collect()}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, none, labels, name):
    assert OPERATORS[name](spark, none, labels).collect() == []


@pytest.mark.parametrize("name", ["mixing", "cnn"])
def test_no_labels(spark, docs, labels, name):
    got = OPERATORS[name](spark, docs, labels.limit(0)).collect()
    assert len(got) == docs.count()
    if name == "cnn":
        assert {r.score for r in got} == {0.5}


def test_stages_keep_columns(spark, docs, tmp_path):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(12)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, own, str(tmp_path)).columns == own.columns, name


def test_clashing_names_stay(spark, docs):
    out = sharding.shuffle_into_shards(docs)
    assert out.columns == [*docs.columns, "shard_1", "slot"]
    again = byte_bpe.encode(byte_bpe.encode(docs, vocabulary(spark)), vocabulary(spark))
    assert again.columns == [*docs.columns, "ids", "ids_1"]


TEXT_IDS = "doc_id string, text string, lang string, source string, n_chars long, digest string, shard int, fp long, C0 string, key string, m map<string,int>, when date"


@pytest.mark.parametrize("name", OPERATORS)
def test_identifiers_of_text_and_columns_without_order(spark, labels, name):
    """Identifiers that are no numbers, and extra columns of types that can't be compared or have names of functions."""
    import datetime

    own = [(None if r[0] is None else f"id-{r[0]}", *r[1:], {"a": 1}, datetime.date(2024, 1, 1)) for r in rows()]
    docs = spark.createDataFrame(own, TEXT_IDS).repartition(3)
    named = labels.withColumn("doc_id", F.concat(F.lit("id-"), "doc_id"))
    out = OPERATORS[name](spark, docs, named)
    got = out.collect()
    if name in SAME_ROWS:
        assert len(got) == len(own)
    if name in SAME_COLUMNS:
        assert out.columns == docs.columns and len({r.text for r in got}) > 5


@pytest.mark.parametrize("name", ["exact_drop", "simhash_drop", "rules_keep"])
def test_every_distinct_text_survives_repeated_and_null_identifiers(spark, name):
    """Distinct texts of distinct words, under one identifier or none, all stay; equal ones leave one."""
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(60))
    own = [(None if k % 2 else 7, text(k // 2), "en", f"host{k}", 1) for k in range(40)] + [(None, text(0), "en", "other", 1)]
    out = OPERATORS[name](spark, spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long"), None)
    got = sorted(r.text for r in out.collect())
    assert got == (sorted(r[1] for r in own) if name == "rules_keep" else sorted({r[1] for r in own}))
