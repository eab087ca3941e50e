"""Model responses: polymorphic JSON as VARIANT, flattened and held against a contract."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
SENTINEL = "C097"
STATUSES = ("ok", "empty", "refusal", "invalid_json", "legacy_name_match", "contract_violation")


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _items(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _is_list(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("ARRAY"), F.lit(False))


def flatten_content(v: Column, path: str = "$") -> Column:
    """Text of a content value: a string itself, or the texts of a list's strings and objects, joined."""
    parts = F.transform(_items(v, path), lambda x: F.coalesce(F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")), F.try_variant_get(x, "$.text", "string"), F.lit("")))
    return F.coalesce(F.when(_is_list(v, path), F.array_join(parts, "")), _text(v, path), F.lit(""))


def chat_parts(line: Column) -> Column:
    """struct(text, refusal, finish_reason) of a batch line in the shape of chat completions."""
    v, at = F.try_parse_json(line), "$.response.body.choices[0]"
    return F.struct(flatten_content(v, f"{at}.message.content").alias("text"), F.nullif(_text(v, f"{at}.message.refusal"), F.lit("")).alias("refusal"), _text(v, f"{at}.finish_reason").alias("finish_reason"))


def output_text(line: Column, only_messages: bool = False) -> Column:
    """Text of a line in the shape with an output list: texts of the content of its items, of messages only if asked."""
    v = F.try_parse_json(line)
    items = F.coalesce(_items(v, "$.output"), F.array().cast("array<variant>"))
    if only_messages:
        items = F.filter(items, lambda x: F.try_variant_get(x, "$.type", "string") == "message")
    texts = F.transform(items, lambda x: F.array_join(F.transform(F.coalesce(F.try_variant_get(x, "$.content", "array<variant>"), F.array().cast("array<variant>")), lambda c: F.coalesce(F.try_variant_get(c, "$.text", "string"), F.lit(""))), ""))
    return F.coalesce(F.nullif(_text(v, "$.output_text"), F.lit("")), F.array_join(texts, ""))


def request_model(line: Column) -> Column:
    """The model of a request line; null where the line isn't JSON."""
    return _text(F.try_parse_json(line), "$.body.model")


def classify(responses: DataFrame, text: str, refusal: str, taxonomy: dict[str, str], legacy: bool = False) -> DataFrame:
    """Adds categories and status. ``taxonomy``: identifier to name, without the sentinel.

    The contract: an object whose category_ids is a list of known identifiers, not empty, the sentinel only alone. Repeats are
    dropped. Numbers in the list violate it, which needs the type of each item and so VARIANT rather than a cast.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    names = F.create_map(*(F.lit(x) for kv in taxonomy.items() for x in kv)) if taxonomy else F.lit(None).cast("map<string,string>")
    v = F.try_parse_json(t)
    raw = _items(v, "$.category_ids")
    rows = responses.withColumn("__list", F.when(_is_list(v, "$.category_ids"), raw))
    text_of = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
    rows = rows.withColumn("__ids", F.array_distinct(F.transform("__list", text_of)))
    known = F.filter(F.filter("__ids", lambda i: i.isNotNull() & (i != SENTINEL)), lambda i: F.element_at(names, i).isNotNull())
    listed = F.transform(known, lambda i: F.element_at(names, i))
    strange = F.exists("__ids", lambda i: i.isNull() | ((i != SENTINEL) & F.element_at(names, i).isNull()))
    mixed = F.array_contains(F.array_compact("__ids"), SENTINEL) & (F.size(F.array_compact("__ids")) > 1)
    bad = (F.size("__list") == 0) | F.coalesce(strange, F.lit(False)) | F.coalesce(mixed, F.lit(False))
    lower = F.array(*(F.lit(n) for n in taxonomy.values())).cast("array<string>")
    by_name = F.filter(lower, lambda n: F.contains(F.lower(t), F.lower(n)))
    none = F.array().cast("array<string>")
    refused, blank = F.coalesce(F.col(refusal), F.lit("")) != "", F.trim(t) == ""
    as_json = F.when(F.col("__list").isNull(), "invalid_json").when(bad, "contract_violation").otherwise("ok")
    as_name = F.when(F.size(by_name) > 0, "legacy_name_match").otherwise("invalid_json")
    status = F.when(refused, "refusal").when(blank, "empty").otherwise(as_name if legacy else as_json)
    found = F.when(refused | blank, none).otherwise(by_name if legacy else F.coalesce(listed, none))
    return rows.withColumn("categories", found).withColumn("status", status).drop("__list", "__ids")


def response_schema(ids: Sequence[str], name: str = "categories") -> str:
    """The response format as JSON: an object whose category_ids is a list of the given identifiers, and nothing else."""
    items = {"type": "array", "items": {"type": "string", "enum": list(ids)}}
    schema = {"type": "object", "properties": {"category_ids": items}, "required": ["category_ids"], "additionalProperties": False}
    return json.dumps({"type": "json_schema", "json_schema": {"name": name, "strict": True, "schema": schema}})


def _free(x: Column) -> Column:
    return F.parse_json(F.to_json(x))  # parts differ in shape, so they are VARIANTs


def request_body(model: Column, system: Column, prefix: Column, body: Column, cached: Column, *more: Column) -> Column:
    """A request's body as VARIANT: the user part in two pieces with a cache mark where the model family caches, else joined.
    ``more``: further fields; null ones are left out."""
    message = lambda role, content: _free(F.struct(F.lit(role).alias("role"), content.alias("content")))
    mark = F.struct(F.lit("text").alias("type"), prefix.alias("text"), F.struct(F.lit("explicit").alias("mode")).alias("prompt_cache_breakpoint"))
    rest = F.struct(F.lit("text").alias("type"), body.alias("text"))
    whole = lambda user: _free(F.struct(model.alias("model"), *more, F.array(message("developer", system), message("user", user)).alias("messages")))
    return F.when(cached, whole(F.array(_free(mark), _free(rest)))).otherwise(whole(F.concat(prefix, body)))


def request_line(custom_id: Column, model: Column, system: Column, prefix: Column, body: Column, temperature: float, most_tokens: int, cached: Column, cache_key: str, schema: str | None) -> Column:
    """A line of a batch file. Models that cache get a cache key made of ``cache_key`` and the model; ``schema`` None: an answer in
    free text, as under the older contract, which has no cache either."""
    cached = cached if schema else F.lit(False)
    slug = F.concat(F.lit(f"{cache_key}-"), F.regexp_replace(model, "[^a-zA-Z0-9_-]+", "-"))
    options = F.struct(F.lit("explicit").alias("mode"), F.lit("30m").alias("ttl"))
    more = [
        F.lit(float(temperature)).alias("temperature"), F.lit(most_tokens).alias("max_completion_tokens"), F.lit("none").alias("reasoning_effort"),
        (F.parse_json(F.lit(schema)) if schema else F.lit(None).cast("string")).alias("response_format"),
        F.when(cached, slug).alias("prompt_cache_key"), F.when(cached, options).alias("prompt_cache_options"),
    ]
    filled = request_body(model, system, prefix, body, cached, *more)
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), filled.alias("body")))


def article_text(line: Column) -> Column:
    """Text of a recorded answer about an article, in either shape: chat choices, or an output list or text."""
    return F.coalesce(F.nullif(chat_parts(line)["text"], F.lit("")), F.nullif(body_output_text(line), F.lit("")), output_text(line, True))


def body_output_text(line: Column) -> Column:
    """As ``output_text`` for a batch line, whose answer is under response.body."""
    return output_text(F.to_json(F.try_variant_get(F.try_parse_json(line), "$.response.body", "variant")), True)
