"""Routed request files: invariants, files, checks, submissions, tokens, retries; and the loaders and rules around them."""

import json

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandline.functions import responses, texts, urls
from strandline.functions.tokens import Tokenizer
from strandline.operators import artifacts, registry
from strandline.plans import website
from strandline.sources import readers, sinks

LUNA, TERRA = "gpt-5.6-luna", "gpt-5.6-terra"


def task(cid, model, line_id=None, line_model=None, tokens=100):
    return cid, model, json.dumps({"custom_id": line_id or cid, "body": {"model": line_model or model}}), tokens


def frames(spark, tasks, mapping):
    return spark.createDataFrame(tasks, "prompt_id string, model string, line string, tokens long"), spark.createDataFrame(mapping, "prompt_id string, model string, asns array<string>")


@pytest.mark.parametrize(("tasks", "mapping", "problem"), [
    ([task("dup", LUNA), task("dup", TERRA)], [("dup", LUNA, ["1"])], "duplicate custom_id"),
    ([task("p1", LUNA), task("p2", TERRA)], [("p1", LUNA, ["7"]), ("p2", TERRA, ["7"])], "number maps to several streams"),
    ([task("p1", LUNA)], [("p1", LUNA, ["1"]), ("ghost", TERRA, ["2"])], "mapping prompt is in no stream"),
    ([("p1", None, task("p1", LUNA)[2], 1)], [("p1", LUNA, ["1"])], "task has no model"),
    ([task("p1", LUNA, line_model=TERRA)], [("p1", LUNA, ["1"])], "line model differs"),
    ([task("p1", LUNA, line_id="OTHER")], [("p1", LUNA, ["1"])], "line custom_id differs"),
    ([task("p1", LUNA)], [("p1", TERRA, ["1"])], "mapping model differs"),
    ([task("p1", LUNA)], [], "no mapping entry"),
    ([("p1", LUNA, "{broken", 1)], [("p1", LUNA, ["1"])], "line is not valid JSON"),
    ([task("p1", LUNA, tokens=999_999)], [("p1", LUNA, ["1"])], "tokens over cap"),
])
def test_invariants(spark, tmp_path, tasks, mapping, problem):
    own = frames(spark, tasks, mapping)
    assert problem in {r.problem for r in artifacts.violations(*own, 1000).collect()}
    with pytest.raises(ValueError, match=problem):
        artifacts.write_routed(*own, f"{tmp_path}/out", "b", 1000)
    assert not (tmp_path / "out").exists()


def test_written_parts(spark, tmp_path):
    own = frames(spark, [task(f"p{k}", LUNA if k % 3 else TERRA) for k in range(20)], [(f"p{k}", LUNA if k % 3 else TERRA, [str(k), str(100 + k)] if k % 3 else [str(k)]) for k in range(20)])
    assert artifacts.violations(*own, 1000).count() == 0
    made = artifacts.write_routed(*own, f"{tmp_path}/out", "one", 1000, requests=6)
    assert sorted((r.model, r.part, r.requests, r.tokens, r.asns) for r in made.collect()) == [(LUNA, 0, 6, 600, 12), (LUNA, 1, 6, 600, 12), (LUNA, 2, 1, 100, 2), (TERRA, 0, 6, 600, 6), (TERRA, 1, 1, 100, 1)]
    assert artifacts.verify_routed(spark, f"{tmp_path}/out").count() == 0
    with pytest.raises(ValueError, match="build one"):
        artifacts.write_routed(*own, f"{tmp_path}/out", "two", 1000)
    made = artifacts.write_routed(*own, f"{tmp_path}/out", "one", 1000, requests=6)
    assert made.count() == 5
    part = next((tmp_path / "out" / "requests" / f"model={TERRA}" / "part=1").glob("*.txt"))
    part.with_name(f".{part.name}.crc").unlink()
    part.write_text(part.read_text().replace("custom_id\": \"p", "custom_id\": \"q"))
    assert [(r.key, r.problem) for r in artifacts.verify_routed(spark, f"{tmp_path}/out").collect()] == [(f"{TERRA}/1", "ids_sha256")]
    part.unlink()
    assert [(r.key, r.problem) for r in artifacts.verify_routed(spark, f"{tmp_path}/out").collect()] == [(f"{TERRA}/1", "missing")]
    jobs = spark.createDataFrame([(LUNA, 0, "j1"), (LUNA, 1, None), (TERRA, 0, "j2")], "model string, part long, job_id string")
    assert sorted((r.model, r.part) for r in artifacts.submission_gaps(made, jobs).collect()) == [(LUNA, 1), (LUNA, 2), (TERRA, 1)]
    assert artifacts.already_submitted(artifacts.planned(own[0], 1000, 6), jobs).count() == 12


def test_signatures_and_dumps(spark, tmp_path):
    files = spark.createDataFrame([("a", 1, 5), ("b", 2, 6)], "path string, length long, modificationTime long")
    assert artifacts.signature({"x": 1, "y": 2}, files) == artifacts.signature({"y": 2, "x": 1}, files.orderBy(F.desc("path"))) != artifacts.signature({"x": 1, "y": 3}, files)
    keys = spark.createDataFrame([({"b": "2", "a": "1"},), ({"a": "1", "b": "2"},)], "m map<string,string>").select(F.sha2(artifacts.sorted_json(F.col("m")), 256).alias("s"))
    assert keys.distinct().count() == 1
    prompts = spark.createDataFrame([("p", ["100", "20"]), ("q", ["3"]), ("r", ["AS7"])], "prompt_id string, asns array<string>")
    artifacts.prompt_dump(prompts, f"{tmp_path}/dump", 2)
    assert [r.prompt_id for r in spark.read.json(f"{tmp_path}/dump").collect()] == ["q", "r"]
    (tmp_path / "index.json").write_text("{}")
    for _ in range(4):
        names = sinks.rotate_backups(spark, f"{tmp_path}/index.json", 3)
    assert len(names) == 3 == len(list(tmp_path.glob("index.json.*.bak")))


def test_line_tokens(spark):
    line = json.dumps({"body": {"messages": [{"content": "one two"}, {"content": [{"text": "three"}, {"text": "four five six"}, {"image": 1}]}], "max_completion_tokens": 30}})
    rows = spark.createDataFrame([(line,), ('{"body": {"messages": [{"content": "a"}]}}',), ("broken",)], "line string")
    words = lambda t: F.size(F.split(t, " ")).cast("long")
    assert [r.n for r in rows.select(artifacts.line_tokens(F.col("line"), 10, 500, words).alias("n")).collect()] == [6 + 10 + 30, 1 + 10 + 500, 510]


def test_exact_tokens(spark):
    import base64
    from pathlib import Path

    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(line.split()[0]): int(line.split()[1]) for line in Path(path).read_text().splitlines()}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, cases = Tokenizer(spark, path, public_tokenizers.PATTERN), ["the quick brown fox", "", "日本語 text é", "x" * 300]
    rows = spark.createDataFrame([(t,) for t in [*cases, None]], "t string").select("t", own.count(F.col("t")).alias("n"), own.truncate(F.col("t"), 3).alias("cut")).collect()
    for r in rows:
        ids = library.encode_ordinary(r.t or "")
        assert r.n == len(ids) and r.cut == (None if r.t is None else library.decode(ids[:3]))


def test_retries(spark):
    log = [("done", "failed", 1), ("done", "ok", 2), ("again", "failed", 10), ("again", "failed", 20), ("round", "failed", 1), ("round", "failed", 2), ("round", "failed", 3), ("new", "started", 1)] + [("dead", "failed", k) for k in range(9)]
    events = spark.createDataFrame(log, "k string, s string, n long").withColumn("at", F.timestamp_seconds("n"))
    got = {r.k: (r.state, r.tries, r.due) for r in artifacts.retry_state(events, "k", "s", "at").select("k", "state", "tries", F.unix_seconds("due").alias("due")).collect()}
    assert got == {"done": ("done", 1, None), "again": ("retry", 2, 24), "round": ("requeue", 3, 3), "new": ("pending", 0, None), "dead": ("failed", 9, None)}


@pytest.mark.parametrize("shape", ["bare", "wrapped", "list"])
def test_site_mapping(spark, tmp_path, shape):
    data = {"64500": {"Website": "https://www.A.com/x/", "Source": "s", "b.org": 1}, "64499": "a.com/x", "64498": ["https://c.net:8080", "facebook.com/d", ""], "64497": {"Confidence": 1}, "64496": None}
    records = [{"asn": int(k), **(v if isinstance(v, dict) else {"url": v if isinstance(v, str) else v[0]})} for k, v in data.items() if v]
    (tmp_path / "m.json").write_text(json.dumps({"metadata": {"n": 1}, "data": data} if shape == "wrapped" else records if shape == "list" else data))
    rows = readers.site_mapping(spark, f"{tmp_path}/m.json")
    urls_of = {}
    for r in rows.orderBy("ordinal", "pos").collect():
        urls_of.setdefault(r.asn, []).append(r.url)
    more = [] if shape == "list" else ["facebook.com/d"]
    assert urls_of == {"64500": ["https://www.A.com/x/", "b.org"], "64499": ["a.com/x"], "64498": ["https://c.net:8080", *more]}
    found = {n: {r[0]: r[1] for r in t.collect()} for n, t in readers.site_lookups(rows).items()}
    assert found["url"]["a.com/x"] == "64499" and found["url"]["www.a.com/x"] == "64500"
    assert found["host"] == {"www.a.com": "64500", "a.com": "64499", "b.org": "64500", "c.net": "64498"}
    assert found["expected"]["64500"] == ["a.com", "b.org"] and "c.net:8080" in found["expected"]["64498"]
    assert found["seed"] == {"www.a.com/x": "64500", "a.com/x": "64499", "c.net:8080": "64498"} and found["sharers"]["a.com/x"] == ["64499"]


def test_public_addresses(spark):
    cases = {
        "pub": (["93.184.216.34"], True), "private": (["10.0.0.1"], False), "loop": (["127.0.0.1"], False), "link": (["169.254.169.254"], False), "v6loop": (["::1"], False),
        "mapped": (["::ffff:127.0.0.1"], False), "mapped_ok": (["::ffff:93.184.216.34"], True), "mixed": (["93.184.216.34", "10.0.0.1"], False), "none": ([], False), "null": (None, False), "v6": (["2606:4700::1"], True),
        "multicast": (["224.0.0.1"], False), "odd": (["300.1.1.1"], False), "text": (["x"], False), "shared": (["100.64.0.1"], True), "same": (["93.184.216.34"], True),
    }
    rows = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "host string, ips array<string>")
    assert {r.host: r.ok for r in urls.with_public(rows, "ips", "ok").collect()} == {k: v[1] for k, v in cases.items()}


def test_gathered_sources(spark):
    f = spark.createDataFrame
    domains, names = website.gathered(
        f([("1", "arin"), ("2", "apnic"), ("3", "apnic")], "asn string, rir string"), f([("arin", "1", ["a.com"]), ("ripe", "1", ["no.com"])], "rir string, asn string, domains array<string>"),
        f([("1", ["https://www.a.com/", "b.org"])], "asn string, websites array<string>"), f([("2", "c.net"), ("3", None)], "asn string, domain string"),
        f([("apnic", "2", "N2", "O2", "D2"), ("apnic", "3", "N3", None, "D3"), ("ripe", "1", "X", "X", "X")], "rir string, asn string, as_name string, org string, descr string"),
        f([("2", "J2", None, "JD2")], "asn string, as_name string, org string, descr string"),
    )
    assert sorted(map(tuple, domains.collect())) == [("1", "a.com", "peering"), ("1", "a.com", "whois"), ("1", "b.org", "peering"), ("2", "c.net", "ip")]
    assert {r.asn: (r.as_name, r.org_name) for r in names.collect()} == {"1": ("", ""), "2": ("J2", "JD2"), "3": ("N3", "D3")}


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_text_rules(spark):
    assert [one(spark, " asAS12", lambda c, n=n: texts.asn_label(c, n)) for n in ("prefix", "letters", "two", "upper")] == ["AS12", "12", "AS12", "asAS12"]
    assert one(spark, "AS64496", lambda c: texts.asn_label(c, "upper")) == "64496"
    assert one(spark, "Acme, Inc. GmbH", texts.brand) == "Acme" and one(spark, "X Co., Ltd", texts.brand) == "X" and one(spark, "Saab AB", texts.brand) == "Saab"
    assert one(spark, "about ACME networks", lambda c: texts.mentions(c, F.lit("Acme Ltd."))) and not one(spark, "about others", lambda c: texts.mentions(c, F.lit("Inc."))) and one(spark, None, lambda c: texts.mentions(c, F.lit("a"))) is False
    assert one(spark, "<p>x</p>", lambda c: texts.html_language(c, F.lit("pt-BR"))) == "pt" and one(spark, "<p>x</p>", lambda c: texts.html_language(c, F.lit("??"))) == "en"
    assert one(spark, "<b>" + "é" * 10, lambda c: texts.page_text(c, 8)) == "éé"
    stamp = lambda x: one(spark, x, lambda c: F.date_format(texts.parse_timestamp(c), "yyyy-MM-dd HH:mm"))
    assert [stamp(x) for x in ("2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "2024-01-02 03:04:05", "2024-01-02", "x")] == ["2024-01-02 03:04", "2024-01-02 01:04", "2024-01-02 03:04", "2024-01-02 00:00", None]
    assert readers.statistics_glob("/d", "ripe") == "/d/delegated-ripencc*extended*"
    chat = json.dumps({"response": {"body": {"choices": [{"message": {"content": "hi"}}]}}})
    listed = json.dumps({"response": {"body": {"output": [{"type": "message", "content": [{"text": "yo"}]}]}}})
    assert [one(spark, x, responses.article_text) for x in (chat, listed)] == ["hi", "yo"]


def test_previous_pair(spark):
    tags = spark.createDataFrame([("2026-01-01", True, True), ("2026-03-01", True, True), ("2026-06-01", True, False), ("2026-09-01", True, True)], "tag string, has_mapping boolean, has_class boolean")
    pick = lambda **k: registry.previous_pair(tags, "tag", "2026-09-01", **k).first()[0]
    assert [pick(), pick(explicit="2026-01-01"), pick(wanted="2026-01-01"), pick(explicit="2026-06-01", wanted="2026-01-01"), pick(wanted="2026-06-01")] == ["2026-03-01", "2026-01-01", "2026-01-01", "2026-01-01", "2026-03-01"]
