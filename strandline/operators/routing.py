"""Model routing, prior classes, prices and budgets of prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

# Fixed values.
SMALL_MODEL, LARGE_MODEL = "gpt-5.6-luna", "gpt-5.6-terra"
PRIOR_LIMIT, TOKEN_LIMIT = 5, 6000
CACHE_WRITE_PREMIUM = 1.25
MAX_REQUESTS, MAX_BYTES = 50_000, 190 * 1024 * 1024
CONTRACT_FROM = "2026-09-01"


def route(prior: Column, tokens: Column, has_prior: Column, ambiguous: Column) -> Column:
    """struct(model, reason). Rules in order: ambiguous, missing, many prior categories, short prompt, long prompt."""
    to = lambda model, reason: F.struct(F.lit(model).alias("model"), F.lit(reason).alias("reason"))
    fail = lambda what: F.raise_error(F.lit(what)).cast("struct<model:string,reason:string>")
    usable = F.coalesce(has_prior, F.lit(False)) & prior.isNotNull()
    return (
        F.when(tokens < 0, fail("tokens must not be negative")).when(F.coalesce(ambiguous, F.lit(False)), to(LARGE_MODEL, "ambiguous_previous_classification"))
        .when(~usable, to(LARGE_MODEL, "missing_previous_classification")).when(prior < 0, fail("prior must not be negative"))
        .when(prior >= PRIOR_LIMIT, to(LARGE_MODEL, "prior_categories_ge_5")).when(tokens <= TOKEN_LIMIT, to(SMALL_MODEL, "short_prompt_le_6000"))
        .otherwise(to(LARGE_MODEL, "long_prompt_gt_6000"))
    )


def contract_for(tag: Column) -> Column:
    """``current`` for snapshots from CONTRACT_FROM on, else ``legacy``; a tag without a date is an error."""
    digits = F.regexp_extract(tag, "([0-9]{4})-?([0-9]{2})(?:-?([0-9]{2}))?", 0)
    flat = F.rpad(F.replace(digits, F.lit("-"), F.lit("")), 8, "01")
    day = F.when(digits != "", F.try_to_date(flat, "yyyyMMdd"))
    return F.when(day.isNull(), F.raise_error(F.concat(F.lit("no date in "), tag)).cast("string")).when(day >= F.lit(CONTRACT_FROM).cast("date"), "current").otherwise("legacy")


def is_family(model: Column, family: str = "gpt-5.6") -> Column:
    return (model == family) | model.startswith(family + "-")


def prior_class_index(sets: DataFrame, key: str, categories: str) -> DataFrame:
    """key, status, categories: the distinct non-empty sets of a key's prompts. One: ok; several: ambiguous (their union); none: zero."""
    own = F.array_sort(F.array_distinct(categories))
    found = sets.groupBy(key).agg(F.collect_set(F.when(F.size(own) > 0, own)).alias("sets"))
    status = F.when(F.size("sets") > 1, "ambiguous").when(F.size("sets") == 1, "ok").otherwise("zero_categories")
    return found.select(key, status.alias("status"), F.array_sort(F.array_distinct(F.flatten("sets"))).alias("categories"))


def prior_lookup(prompts: DataFrame, prompt: str, keys: str, index: DataFrame, key: str) -> DataFrame:
    """prompt, status, categories over all keys of a prompt: any ambiguous key or two different sets make it ambiguous."""
    met = prompts.select(prompt, F.explode(F.array_distinct(keys)).alias(key)).join(index, key)
    usable = met.groupBy(prompt).agg(F.bool_or(F.col("status") == "ambiguous").alias("torn"), F.collect_set(F.when(F.col("status") == "ok", F.col("categories"))).alias("sets"), F.count("*").alias("n"))
    status = F.when(F.col("torn") | (F.size("sets") > 1), "ambiguous").when(F.size("sets") == 1, "ok").otherwise("zero_categories")
    found = usable.select(prompt, status.alias("status"), F.when(~F.col("torn") & (F.size("sets") == 1), F.col("sets")[0]).otherwise(F.array().cast("array<string>")).alias("categories"))
    left = prompts.select(prompt).distinct().join(found, prompt, "left")
    return left.select(prompt, F.coalesce("status", F.lit("missing")).alias("status"), F.coalesce("categories", F.array().cast("array<string>")).alias("categories"))


def resolve_prices(models: DataFrame, explicit: DataFrame, default: DataFrame, shared: tuple[float, float] | None) -> DataFrame:
    """model, price_in, price_out (per million tokens): explicit, else default, else shared, else null. NaN, infinite and negative prices are errors."""
    a = explicit.select("model", F.col("price_in").alias("ai"), F.col("price_out").alias("ao"))
    b = default.select("model", F.col("price_in").alias("bi"), F.col("price_out").alias("bo"))
    rows = models.select("model").distinct().join(a, "model", "left").join(b, "model", "left")
    last = [F.lit(x) for x in shared] if shared else [F.lit(None).cast("double")] * 2
    bad = lambda c: F.isnan(c) | (c < 0) | (c == float("inf"))
    checked = lambda c, n: F.when(bad(c), F.raise_error(F.lit("price must be finite and not negative")).cast("double")).otherwise(c).alias(n)
    return rows.select("model", checked(F.coalesce("ai", "bi", last[0]), "price_in"), checked(F.coalesce("ao", "bo", last[1]), "price_out"))


def cost_ceiling(tasks: DataFrame, prices: DataFrame, model: str, tokens_in: str, tokens_out: str) -> DataFrame:
    """model, requests, tokens_in, tokens_out, ceiling: all input at the price of a first cache write, all output at its limit."""
    sums = tasks.groupBy(model).agg(F.count("*").alias("requests"), F.sum(tokens_in).alias("tokens_in"), F.sum(tokens_out).alias("tokens_out"))
    ceiling = (F.col("tokens_in") * F.col("price_in") * CACHE_WRITE_PREMIUM + F.col("tokens_out") * F.col("price_out")) / 1e6
    return sums.join(prices, model, "left").select(model, "requests", "tokens_in", "tokens_out", ceiling.alias("ceiling"))


def pack(limits: tuple[int, int, int], schema: StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Next-fit over rows in order: a bin is closed when the next row would exceed requests, bytes or tokens."""
    most, most_bytes, most_tokens = limits

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, k, n, b, t = None, 0, 0, 0, 0
        for batch in batches:
            bins = []
            for own, size, tokens in zip(*(batch.column(j).to_pylist() for j in (0, 2, 3))):
                if not bins and stream is None or own != stream:
                    stream, k, n, b, t = own, 0, 0, 0, 0
                if n and (n >= most or b + size > most_bytes or t + tokens > most_tokens):
                    k, n, b, t = k + 1, 0, 0, 0
                n, b, t = n + 1, b + size, t + tokens
                bins.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bins, pa.int64())], schema.names)

    return work


def pack_bins(tasks: DataFrame, stream: str, ordinal: str, size: str, tokens: str, token_cap: int, requests: int = MAX_REQUESTS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """stream, ordinal, bin. Where a bin ends depends on all rows before, so a stream goes through one task, in the order of the
    shuffle's sort: three numbers a row, without the request lines, and no more than a batch is held. Streams are independent."""
    rows = tasks.select(F.col(stream).cast("string").alias("stream"), F.col(ordinal).alias("ordinal"), F.col(size).cast("long").alias("bytes"), F.col(tokens).cast("long").alias("tokens"))
    schema = StructType([rows.schema["stream"], rows.schema["ordinal"], StructField("bin", LongType())])
    return rows.repartition("stream").sortWithinPartitions("stream", "ordinal").mapInArrow(pack((requests, max_bytes, token_cap), schema), schema)
