"""Request files of a routed build: their invariants, the files with a manifest, what was submitted, and what is missing."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import responses, texts
from strandline.operators import routing

#: Identifiers that a message names at most.
NAMED = 50


def violations(tasks: DataFrame, mapping: DataFrame, token_cap: int) -> DataFrame:
    """problem, id, detail: every broken invariant between tasks, their request lines and the mapping; no row is a pass.

    tasks: prompt_id, model, line, tokens; mapping: prompt_id, model, asns. Tasks have a model and an identifier of their own;
    their lines are JSON with that identifier and model; the mapping has the same prompts with the same models; a number is in
    one stream only; no task is over the cap.
    """
    line = F.try_parse_json("line")
    found = tasks.select("prompt_id", "model", "tokens", line.isNull().alias("broken"), F.try_variant_get(line, "$.custom_id", "string").alias("line_id"), responses.request_model(F.col("line")).alias("line_model"))
    own = mapping.select("prompt_id", F.col("model").alias("mapped"), F.lit(True).alias("known"))
    met = found.join(own, "prompt_id", "left")
    rule = lambda problem, when, detail: met.where(when).select(F.lit(problem).alias("problem"), F.col("prompt_id").alias("id"), detail.cast("string").alias("detail"))
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    parts = [
        rule("task has no model", F.col("model").isNull(), F.lit("")), rule("line is not valid JSON", F.col("broken"), F.lit("")),
        rule("line custom_id differs", ~F.col("broken") & differs("line_id", "prompt_id"), F.col("line_id")), rule("line model differs", ~F.col("broken") & differs("line_model", "model"), F.col("line_model")),
        rule("no mapping entry", F.col("known").isNull(), F.lit("")), rule("mapping model differs", F.col("known") & differs("mapped", "model"), F.col("mapped")),
        rule("tokens over cap", F.col("tokens") > token_cap, F.col("tokens")),
        tasks.groupBy("prompt_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate custom_id"), "prompt_id", F.col("n").cast("string")),
        mapping.join(tasks.select("prompt_id").distinct(), "prompt_id", "left_anti").select(F.lit("mapping prompt is in no stream"), "prompt_id", F.lit("")),
        mapping.select("model", F.explode("asns").alias("asn")).groupBy("asn").agg(F.array_sort(F.collect_set("model")).alias("m")).where(F.size("m") > 1).select(F.lit("number maps to several streams"), F.col("asn").cast("string"), F.array_join("m", ", ")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def raise_violations(found: DataFrame) -> None:
    """Names the first NAMED violations, by problem and identifier."""
    rows = found.orderBy("problem", "id").limit(NAMED).collect()
    if rows:
        raise ValueError("; ".join(f"{r.problem}: {r.id}" + (f" ({r.detail})" if r.detail else "") for r in rows))


def signature(params: Mapping[str, object], files: DataFrame | None = None) -> str:
    """SHA-256 of a build's parameters and files (path, length, modificationTime), independent of their order."""
    seen = [] if files is None else sorted((r[0], r[1], str(r[2])) for r in files.select("path", "length", "modificationTime").collect())  # a build's few inputs
    return hashlib.sha256(json.dumps({"params": params, "files": seen}, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


def sorted_json(entries: Column) -> Column:
    """JSON of a map with its keys in order, for fingerprints by ``sha2``."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def planned(tasks: DataFrame, token_cap: int, requests: int = routing.MAX_REQUESTS, max_bytes: int = routing.MAX_BYTES) -> DataFrame:
    """``tasks`` with part: bins under three limits within each model, in the order of identifiers."""
    sized = tasks.withColumn("size", F.octet_length("line") + 1)
    bins = routing.pack_bins(sized, "model", "prompt_id", "size", "tokens", token_cap, requests, max_bytes)
    return tasks.join(bins.select(F.col("ordinal").alias("prompt_id"), F.col("bin").alias("part")), "prompt_id")


def write_routed(tasks: DataFrame, mapping: DataFrame, path: str, build: str, token_cap: int, requests: int = routing.MAX_REQUESTS) -> DataFrame:
    """Request files in a folder per model and part, the mapping, and the manifest, which is returned: model, part, requests,
    tokens, bytes, ids_sha256, asns, build. Nothing is written if an invariant is broken, or over files of another build."""
    from strandline.sources.readers import exists
    from strandline.sources.sinks import manifest

    spark = tasks.sparkSession
    if exists(spark, f"{path}/manifest") and (other := spark.read.parquet(f"{path}/manifest").select("build").first()) and other[0] != build:
        raise ValueError(f"{path} has files of build {other[0]}")
    raise_violations(violations(tasks, mapping, token_cap))
    parts = planned(tasks, token_cap, requests)
    lines = parts.select("model", "part", F.col("line").alias("value"), "prompt_id").repartition("model", "part").sortWithinPartitions("model", "part", "prompt_id")
    lines.drop("prompt_id").write.mode("overwrite").partitionBy("model", "part").text(f"{path}/requests")
    mapping.write.mode("overwrite").parquet(f"{path}/mapping")
    numbers = parts.join(mapping.select("prompt_id", F.size("asns").alias("k")), "prompt_id").groupBy("model", "part").agg(F.sum("k").alias("asns"), F.sum("tokens").alias("tokens"))
    manifest(parts, "model", "part", "line").join(numbers, ["model", "part"]).withColumn("build", F.lit(build)).write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def verify_routed(spark: SparkSession, path: str) -> DataFrame:
    """model, part, problem: parts that are missing, extra, or differ from the manifest in number, bytes or identifiers."""
    from strandline.operators.quality import artifact_differences
    from strandline.sources.sinks import manifest

    lines = spark.read.schema("value string, model string, part bigint").text(f"{path}/requests")
    own = lines.withColumn("prompt_id", F.try_variant_get(F.try_parse_json("value"), "$.custom_id", "string"))
    key = F.concat_ws("/", "model", F.col("part").cast("string")).alias("key")
    checks = ["requests", "bytes", "ids_sha256"]
    actual = manifest(own, "model", "part", "value").select(key, *checks)
    return artifact_differences(spark.read.parquet(f"{path}/manifest").select(key, *checks), actual, "key", checks)


def prompt_dump(prompts: DataFrame, path: str, limit: int | None = None) -> None:
    """Prompts with their numbers, gzip JSON lines in the order of the smallest number (as a number), the first ``limit``."""
    rows = prompts.withColumn("__first", F.array_min(F.transform("asns", lambda a: F.regexp_replace(a, "[^0-9]", "").try_cast("long")))).orderBy(F.col("__first").asc_nulls_last(), "prompt_id")
    (rows.limit(limit) if limit else rows).drop("__first").write.mode("overwrite").option("compression", "gzip").json(path)


def already_submitted(tasks: DataFrame, jobs: DataFrame) -> DataFrame:
    """prompt_id of tasks whose part (model, part) has a job."""
    done = jobs.where("job_id is not null").select("model", "part").distinct()
    return tasks.join(done, ["model", "part"], "left_semi").select("prompt_id")


def submission_gaps(parts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Parts of a manifest without a job; no row is a complete submission."""
    return parts.select("model", "part").join(jobs.where("job_id is not null").select("model", "part").distinct(), ["model", "part"], "left_anti")


def line_tokens(line: Column, framing: int, default_completion: int, count: Callable[[Column], Column] = texts.estimated_tokens) -> Column:
    """Tokens of a request line: those of all texts of its messages, the framing, and what is reserved for the answer. The texts
    are counted one by one, so ``count`` must be a Column function."""
    v = F.try_parse_json(line)
    messages = F.coalesce(F.try_variant_get(v, "$.body.messages", "array<variant>"), F.array().cast("array<variant>"))
    plain = F.transform(messages, lambda m: F.when(F.schema_of_variant(F.try_variant_get(m, "$.content", "variant")) == "STRING", F.try_variant_get(m, "$.content", "string")))
    pieces = F.flatten(F.transform(messages, lambda m: F.transform(F.coalesce(F.try_variant_get(m, "$.content", "array<variant>"), F.array().cast("array<variant>")), lambda p: F.try_variant_get(p, "$.text", "string"))))
    counted = F.transform(F.array_compact(F.concat(plain, pieces)), lambda t: count(t))
    reserved = F.coalesce(F.nullif(F.try_variant_get(v, "$.body.max_completion_tokens", "long"), F.lit(0).cast("long")), F.lit(default_completion).cast("long"))
    return F.aggregate(counted, F.lit(0).cast("long"), lambda a, x: a + x) + framing + reserved


def retry_state(events: DataFrame, key: str, status: str, at: str, attempts: int = 3, requeues: int = 2, base_seconds: int = 1) -> DataFrame:
    """key, tries, state, due: what is to be done about each key of an event log (status ok, failed or other; at: timestamp).

    A key that ever was ok is done. Failures up to ``attempts`` in a round are tried again after base * 2^tries seconds; then the
    key goes to the next of ``requeues`` rounds at once; after the last it has failed for good.
    """
    seen = events.groupBy(key).agg(F.bool_or(F.col(status) == "ok").alias("ok"), F.count_if(F.col(status) == "failed").alias("tries"), F.max(at).alias("last"))
    inner = F.col("tries") % attempts
    state = F.when(F.col("ok"), "done").when(F.col("tries") >= attempts * (1 + requeues), "failed").when(F.col("tries") == 0, "pending").when(inner == 0, "requeue").otherwise("retry")
    rows = seen.select(key, "tries", state.alias("state"), "last", inner.alias("inner"))
    due = F.when(F.col("state") == "retry", F.timestamp_seconds(F.unix_micros("last") / 1e6 + base_seconds * F.pow(F.lit(2), F.col("inner")))).when(F.col("state") == "requeue", F.col("last"))
    return rows.select(key, "tries", "state", due.alias("due"))
