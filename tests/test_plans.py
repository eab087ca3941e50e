"""Parts of the plans that have no table of their own."""

import json

from pyspark.sql import functions as F

from strandline.functions import responses, texts, urls
from strandline.operators import crawl, quality, relational, routing
from strandline.plans import labels, website
from strandline.sources import readers, sinks


def test_variant_winner(spark):
    rows = [("a", "s", True, 3, 500), ("a", "o", False, 9, 900), ("b", "s", True, 1, 100), ("b", "o", False, 2, 350), ("c", "s", True, 1, 100), ("c", "o", False, 2, 250), ("d", "o", False, 1, 10), ("d", "p", False, 1, 20)]
    frame = spark.createDataFrame(rows, "target string, variant string, strict boolean, subpages int, landing int")
    assert {r.target: r.variant for r in crawl.variant_winner(frame, "target", "strict", "subpages", "landing").collect()} == {"a": "s", "b": "o", "c": "s", "d": "p"}


def test_changed_keys_and_states(spark):
    rows = spark.createDataFrame([("a", "reused_from_store"), ("a", None), ("b", "reused_from_store")], "k string, o string")
    assert [r.k for r in crawl.changed_keys(rows, "k", "o").collect()] == ["a"]
    states = spark.createDataFrame([(s,) for s in ("NEVER", "DONE", "FAILED")], "s string").orderBy(crawl.state_order(F.col("s")))
    assert [r.s for r in states.collect()] == ["DONE", "FAILED", "NEVER"]


def test_reject_reasons(spark):
    rows = spark.createDataFrame([("internet provider", ["Q1"], ["P452"], 1.0), ("family name", ["Q2"], [], 0.9), (None, None, None, 0.1)], "d string, t array<string>, p array<string>, s double")
    reasons = labels.organisation_reasons(F.col("d"), F.col("t"), F.col("p"), F.col("s"), ["P452"], "company|provider", "family name|given name")
    assert [r.r for r in rows.select(reasons.alias("r")).collect()] == [[], ["not_organisation", "other_subject"], ["not_organisation", "no_type", "title_differs"]]


def test_request_lines(spark):
    models = ["gpt-5.6", "gpt-5.6-terra", "gpt-5.6-luna", "gpt-5.2"]
    rows = spark.createDataFrame([(m,) for m in models], "model string")
    ids = [f"C{k:03d}" for k in range(1, 98)]
    line = lambda schema: responses.request_line(F.lit("b:1"), F.col("model"), F.lit("sys"), F.lit("pre"), F.lit("body"), 0.0, 1024, routing.is_family(F.col("model")), "own-v2", schema)
    got = {r.model: json.loads(r.line) for r in rows.select("model", line(responses.response_schema(ids)).alias("line")).collect()}
    for model, x in got.items():
        b = x["body"]
        assert (x["custom_id"], x["method"], x["url"]) == ("b:1", "POST", "/v1/chat/completions")
        assert (b["model"], b["temperature"], b["max_completion_tokens"], b["reasoning_effort"]) == (model, 0.0, 1024, "none")
        assert b["messages"][0] == {"role": "developer", "content": "sys"}
        schema = b["response_format"]["json_schema"]
        assert schema["strict"] is True and schema["schema"]["additionalProperties"] is False and schema["schema"]["properties"]["category_ids"]["items"]["enum"] == ids
        user = b["messages"][1]["content"]
        if model == "gpt-5.2":
            assert user == "prebody" and "prompt_cache_key" not in b and "prompt_cache_options" not in b
        else:
            assert user == [{"type": "text", "text": "pre", "prompt_cache_breakpoint": {"mode": "explicit"}}, {"type": "text", "text": "body"}]
            assert b["prompt_cache_key"] == "own-v2-" + model.replace(".", "-") and b["prompt_cache_options"] == {"mode": "explicit", "ttl": "30m"}
    old = [json.loads(r.line)["body"] for r in rows.select(line(None).alias("line")).collect()]
    assert all(b["messages"][1]["content"] == "prebody" and "response_format" not in b and "prompt_cache_key" not in b for b in old)


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("1", ["a"]), ("2", [])], "asn string, v array<string>")
    many = spark.createDataFrame([(str(k), [f"v{k}"] if k % 3 else None) for k in range(50)], "asn string, v array<string>").repartition(4)
    want = sorted((r.asn, r.v) for r in many.collect())
    for gz in (False, True):
        sinks.keyed_json(many, f"{tmp_path}/{gz}", "asn", "v", gzip=gz)
        sinks.keyed_json_object(many, f"{tmp_path}/one{gz}", "asn", "v", gzip=gz)
        sinks.keyed_json_object(many, f"{tmp_path}/data{gz}", "asn", "v", F.struct(F.lit(50).alias("n")), gzip=gz)
        for name in ("", "one", "data"):
            assert sorted(map(tuple, readers.keyed_json(spark, f"{tmp_path}/{name}{gz}", "array<string>").collect())) == want, name
    text = next(f for f in (tmp_path / "dataFalse").iterdir() if f.suffix == ".txt").read_text()
    assert json.loads(text)["metadata"] == {"n": 50} and list(json.loads(text)["data"]) == sorted(r[0] for r in want)
    pages = spark.createDataFrame([("s", 2, "sub"), ("s", 1, "landing")], "site string, rank int, text string")
    sinks.site_texts(pages, f"{tmp_path}/texts", "site", "text", "rank")
    assert [r.value for r in spark.read.text(f"{tmp_path}/texts", wholetext=True).collect()] == ["landing\n\nsub\n"]
    sinks.csv(frame.select("asn"), f"{tmp_path}/csv")
    assert readers.exists(spark, f"{tmp_path}/csv") and not readers.exists(spark, f"{tmp_path}/no*")


def test_health_needs_check(spark):
    files = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", 1, 5)], "path string, length long, modificationTime long")
    state = spark.createDataFrame([("a", 1, 5, "ok"), ("b", 2, 5, "ok"), ("c", 1, 5, "broken")], "path string, length long, modificationTime long, status string")
    assert sorted(r.path for r in quality.needs_check(files, state).collect()) == ["b", "c"]


def test_probes_and_urls(spark):
    probes = spark.createDataFrame([("a", 0, 404), ("a", 1, 403), ("a", 2, 200), ("b", 0, 401), ("b", 1, 500), ("c", 0, 500), ("d", 0, None)], "clean string, variant int, status int")
    assert {r.clean: r.variant for r in website.choose_probe(probes, "clean", "status", "variant").collect()} == {"a": 2, "b": 0}
    names = spark.createDataFrame([("1", "acme.com", "ACME", "Acme Inc"), ("1", "zzz.org", "ACME", "Acme Inc")], "asn string, url string, name string, org string")
    assert website.best_url(names, "asn", "url", "name", "org").first().url == "acme.com"
    keys = spark.createDataFrame([("http://www.A.com:80/x",), ("",)], "u string").select(urls.site_key(F.col("u")).alias("k"))
    assert [r.k[:5] for r in keys.collect()] == ["a.com", "site_"]
    assert spark.range(1).select(texts.normalise_space(F.lit(" a \t b\r\n\n\n\nc ")).alias("t")).first().t == "a b\n\nc"


def test_prompt_fan_out(spark):
    bodies = spark.createDataFrame([("2", "h", 5), ("1", "h", 5), ("3", "g", 7)], "asn string, payload_sha256 string, tokens int")
    prompts = labels.unique_prompts(bodies, "asn")
    assert sorted((r.prompt_id, r["keys"]) for r in prompts.collect()) == [("1", ["1", "2"]), ("3", ["3"])]
    answers = spark.createDataFrame([("1", ["A", "B", "A"])], "prompt_id string, categories array<string>")
    assert sorted(map(tuple, labels.fan_out(answers, prompts).collect())) == [("1", "A"), ("1", "B"), ("2", "A"), ("2", "B")]


def inherited(rows):
    """member, label, note by brute force."""
    out = []
    for m in {m for m, _, _ in rows}:
        groups, own = {g for x, g, _ in rows if x == m and g is not None}, {t for x, _, t in rows if x == m and t is not None}
        for t in {t for _, g, t in rows if g in groups} - own:
            out.append((m, t, "Inherit from " + ", ".join(sorted({str(x) for x, g, u in rows if g in groups and u == t and x is not None}))))
    return sorted(out, key=str)


def test_inheritance_with_several_groups_nulls_and_pieces(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (2, "b", "y"), (3, "b", "z"), (4, "b", None), (10, "a", "x"), (5, None, "w"), (6, "c", "q"), (1, "b", "x"), (7, "a", "z")]
    held = spark.createDataFrame(rows, "member long, grp string, label string")
    for size in (1, 1 << 29):
        got = relational.inherit_within_group(held, "member", "grp", "label", size).collect()
        assert sorted(map(tuple, got), key=str) == inherited(rows)


def test_inheritance_moves_no_note_once_a_member(spark):
    held = spark.range(3000).selectExpr("id * 7919 AS member", "1 AS grp", "id % 2 AS label")
    written = lambda: sum(x.totalShuffleWrite() for x in _executors(spark))
    before = written()
    relational.inherit_within_group(held, "member", "grp", "label").write.format("noop").mode("overwrite").save()
    assert written() - before < 5_000_000


def _executors(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return [found.apply(k) for k in range(found.length())]
