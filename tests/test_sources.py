"""Readers, archives, logs and patterns on files made here."""

import gzip
import json

from pyspark.sql import functions as F

from strandline.operators import quality, relational, routing
from strandline.plans import labels, website
from strandline.sources import readers, sinks, warc
from strandline.streaming import logs


def test_keyed_json(spark, tmp_path):
    (tmp_path / "bare.json").write_text(json.dumps({"64496": ["arin", "US"], "64497": ["ripe", "DE"]}))
    with gzip.open(tmp_path / "wrapped.json.gz", "wt") as f:
        json.dump({"metadata": {"n": 2}, "data": {"64496": ["arin", "US"], "64498": None}}, f)
    rows = lambda n: sorted((r.asn, r.value) for r in readers.keyed_json(spark, f"{tmp_path}/{n}", "array<string>").collect())
    assert rows("bare.json") == [("64496", ["arin", "US"]), ("64497", ["ripe", "DE"])]
    assert rows("wrapped.json.gz") == [("64496", ["arin", "US"]), ("64498", None)]
    assert readers.keyed_json_or_empty(spark, f"{tmp_path}/none.json", "string").count() == 0


def test_json_lines_skip_broken(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"seed": "a", "status": "ok"}\n{broken\n{"seed": "b", "status": "failed"}\n')
    assert sorted(r.seed for r in readers.json_lines(spark, f"{tmp_path}/log.jsonl", readers.EVENT_SCHEMA).collect()) == ["a", "b"]


def test_order_over_files(spark, tmp_path):
    """Rows are numbered by path and line, though Spark deals out large files first."""
    for name, n in (("a b", 3), ("b", 400), ("c", 20)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"seed": name, "status": str(k)}) + "\n" for k in range(n)))
        (tmp_path / f"{name}.csv").write_text("start_ip,end_ip,asn,name,domain\n" + "".join(f"{k},x,{name},n,d\n" for k in range(n)))
        (tmp_path / f"{name}.db").write_text("".join(f"aut-num: {name}{k}\n\n" for k in range(n)))
    rows = readers.json_lines(spark, f"{tmp_path}/*.jsonl", readers.EVENT_SCHEMA).orderBy("ordinal").collect()
    want = [(name, k) for name, n in (("a b", 3), ("b", 400), ("c", 20)) for k in range(n)]
    assert [(r.seed, int(r.status)) for r in rows] == want
    assert [(r.asn, int(r.start_ip)) for r in readers.ipinfo(spark, f"{tmp_path}/*.csv").orderBy("ordinal").collect()] == want
    assert [r.id for r in readers.blocks(spark, f"{tmp_path}/*.db").orderBy("ordinal").collect()] == [f"{name}{k}" for name, k in want]
    last = relational.latest_by(readers.json_lines(spark, f"{tmp_path}/*.jsonl", readers.EVENT_SCHEMA).withColumn("k", F.lit(1)), "k", "ordinal", "ordinal").first()
    assert (last.seed, last.status) == ("c", "19")


def test_delegated(spark):
    text = ["2|arin|x", "# note", "", "arin|us|asn|64496|3|20200101|allocated|x", "ripencc|DE|asn|64500|1|20200101|reserved", "ripencc|de|asn|64501|1|20200101|assigned", "arin|US|ipv4|1.0.0.0|256|20200101|allocated", "new|XX|asn|64510|1|2020|allocated", "arin|US|asn|abc|1|2020|allocated", "arin|US|asn|5|0|2020|allocated"]
    got = readers.delegated(spark.createDataFrame([(t,) for t in text], "value string"), ["allocated", "assigned"], "other").collect()
    assert sorted((r.asn, r.rir, r.cc) for r in got) == [("64496", "arin", "US"), ("64497", "arin", "US"), ("64498", "arin", "US"), ("64501", "ripe", "DE"), ("64510", "other", "XX")]


def test_blocks(spark, tmp_path):
    (tmp_path / "db.txt").write_text("aut-num: AS64496\nas-name: ONE\norg: ORG-1\n\n\naut-num: AS64497\nas-name: TWO\n\norganisation: ORG-1\norg-name: First\ne-mail: x@Example.org\ne-mail: y@example.org\ne-mail: none\n")
    got = {r.asn: r for r in readers.autnum_domains(readers.blocks(spark, f"{tmp_path}/db.txt")).collect()}
    assert (got["64496"].org_name, got["64496"].domains, got["64496"].as_name) == ("First", ["example.org"], "ONE") and got["64497"].domains == []


def test_handles(spark):
    frame = spark.createDataFrame
    got = readers.handle_domains(frame([("1", "O"), ("2", "P")], "asn string, org_id string"), frame([("O", ["H", "I", "H"])], "org_id string, handles array<string>"), frame([("H", ["a@x.org", "b@x.org"]), ("I", ["c@y.org", "bad"])], "handle string, mailboxes array<string>"))
    assert {r.asn: r.domains for r in got.collect()} == {"1": ["x.org", "y.org"], "2": []}


def test_peering(spark, tmp_path):
    dump = {"org": {"data": [{"id": 1, "name": "A", "website": "https://a.org", "aka": "", "country": "US"}, {"id": 2, "name": "B http://b.org x", "website": "", "aka": "", "country": "DE"}]}, "net": {"data": [{"asn": 1, "org_id": 1, "website": ""}, {"asn": 1, "org_id": 2, "website": "https://late.org"}, {"asn": 2, "org_id": 2, "website": "https://own.org"}, {"asn": 3, "org_id": 9, "website": "https://none.org"}]}}
    (tmp_path / "dump.json").write_text(json.dumps(dump))
    assert {r.asn: r.websites for r in readers.peering(spark, f"{tmp_path}/dump.json").collect()} == {"1": ["https://a.org"], "2": ["https://own.org", "http://b.org"]}


def test_seeds_and_snapshots(spark, tmp_path):
    for name, text in (("a", '["x.org", " y.org "]'), ("b", '{"urls": ["x.org"]}'), ("c", "x.org\n# no\n\nz.org\n")):
        (tmp_path / name).write_text(text)
    assert [[r.url for r in readers.seeds(spark, f"{tmp_path}/{n}").collect()] for n in "abc"] == [["x.org", "y.org"], ["x.org"], ["x.org", "z.org"]]
    for n in ("data_20240102.json", "data_2024-02-03.json", "other.json"):
        (tmp_path / n).write_text("{}")
    assert sorted(str(r.day) for r in readers.snapshots(spark, f"{tmp_path}/*.json").collect()) == ["2024-01-02", "2024-02-03"]


def record(rid, body, kind="response"):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\nWARC-Target-URI: http://e.org/{rid}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_archives(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record(f"r{k}", b"page %d" % k)) for k in range(5)))
    (tmp_path / "b.warc").write_bytes(record("p0", b"plain") + record("p1", b"more"))
    whole = gzip.compress(record("x0", b"ok")) + gzip.compress(record("x1", b"cut"))
    (tmp_path / "c.warc.gz").write_bytes(whole[:-20])
    found = warc.scan(spark, f"{tmp_path}/*warc*").cache()
    assert {r.record_id: bytes(r.payload) for r in found.where("error is null").collect()} == {f"r{k}": b"page %d" % k for k in range(5)} | {"p0": b"plain", "p1": b"more", "x0": b"ok"}
    assert {r.warc.rsplit("/", 1)[1]: r.ok for r in warc.health(found).collect()} == {"a.warc.gz": True, "b.warc": True, "c.warc.gz": False}
    index = warc.offset_index(found).where("record_id in ('r3', 'r1', 'p1')").withColumn("offset", F.when(F.col("record_id") != "r3", F.col("offset")))
    assert {r.record_id: bytes(r.payload) for r in warc.seek(spark, index, f"{tmp_path}/a*").collect()} == {"r1": b"page 1", "r3": b"page 3", "p1": b"more"}
    stale = warc.offset_index(found).where("record_id = 'r2'").withColumn("record_id", F.lit("other"))
    assert [r.error for r in warc.seek(spark, stale).collect()] == ["LookupError: not at this place"]


def test_one_member_for_all_records(spark, tmp_path):
    (tmp_path / "w.warc.gz").write_bytes(gzip.compress(b"".join(record(f"r{k}", b"x" * k) for k in range(2500))))
    found = warc.scan(spark, f"{tmp_path}/w.warc.gz").collect()
    assert sorted(len(r.payload) for r in found) == list(range(2500)) and {r.offset for r in found} == {0} and not any(r.error for r in found)


def test_large_archive_takes_linear_time(tmp_path):
    """256 MB of members, streamed: two times the records take about two times as long, and a seek reads its record only."""
    import os
    import time

    body, seconds = os.urandom(32_000), []
    for n in (4000, 8000):
        path, places = tmp_path / f"{n}.warc.gz", []
        with path.open("wb") as f:
            for k in range(n):
                places.append(f.tell())
                f.write(gzip.compress(record(f"r{k}", body), 0))
        began = time.time()
        with warc.opened(str(path)) as handle:
            assert sum(size for *_, size in warc.records(handle)) == path.stat().st_size
        seconds.append(time.time() - began)
    assert path.stat().st_size > 256_000_000 and seconds[1] < 20 and seconds[1] < 4 * seconds[0]


def test_written_archives(spark, tmp_path):
    rows = spark.createDataFrame([(f"r{k}", "response", f"http://e.org/{k}", "2024-01-01T00:00:00Z", bytes([65 + k % 26]) * 50, f"r{k - 1}" if k == 7 else None) for k in range(40)], "record_id string, type string, uri string, day string, payload binary, refers_to string").repartition(2)
    index = warc.write(rows, f"{tmp_path}/out", max_records=8)
    assert index.groupBy("warc").count().agg(F.max("count")).first()[0] == 8 and index.count() == 40
    found = {r.record_id: r for r in warc.scan(spark, f"{tmp_path}/out/*.warc.gz").collect()}
    assert {k: bytes(r.payload) for k, r in found.items()} == {f"r{k}": bytes([65 + k % 26]) * 50 if k != 7 else b"" for k in range(40)} and found["r7"].type == "revisit"
    got = warc.seek(spark, index.where("record_id in ('r3', 'r39')")).collect()
    assert sorted((r.record_id, r.uri) for r in got) == [("r3", "http://e.org/3"), ("r39", "http://e.org/39")]
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(record("a", b"1") + record("b", b"2")))
    again = warc.reencode(spark, f"{tmp_path}/whole.warc.gz", f"{tmp_path}/again")
    assert {r.record_id: bytes(r.payload) for r in warc.seek(spark, again).collect()} == {"a": b"1", "b": b"2"}


def test_rebuild_scrub_and_replace(spark, tmp_path):
    store, own = f"file:{tmp_path}/store.warc.gz", f"file:{tmp_path}/own.warc.gz"
    (tmp_path / "store.warc.gz").write_bytes(gzip.compress(record("s1", b"stored")) + gzip.compress(record("s2", b"other")))
    (tmp_path / "own.warc.gz").write_bytes(gzip.compress(record("o1", b"own")))
    rows = [("o1", own, None, None), ("o2", own, "s1", store), ("o3", own, "s9", "gone.warc.gz"), ("o4", own, None, store)]
    index = spark.createDataFrame(rows, "record_id string, warc string, store_record string, store_warc string")
    broken = spark.createDataFrame([("gone.warc.gz",)], "warc string")
    made, counts = warc.rebuild(spark, index, broken, f"{tmp_path}/new")
    assert {r.state: r.n for r in counts.collect()} == {"passthrough": 1, "kept": 1, "skipped": 1, "invalid": 1}
    assert {r.record_id: bytes(r.payload) for r in warc.seek(spark, made).collect()} == {"o1": b"own", "o2": b"stored"}
    assert sorted(r.record_id for r in warc.scrub(index.na.fill("", ["store_warc"]), "store_warc", broken).collect()) == ["o1", "o2", "o4"]
    lines = spark.createDataFrame([("a gone.warc.gz b",), ("fine",)], "value string")
    assert [r.value for r in warc.scrub_lines(lines, broken).collect()] == ["fine"]
    slices = spark.createDataFrame([("a", 1), ("b", 1)], "warc string, n int")
    assert sorted(map(tuple, warc.replaced(slices, spark.createDataFrame([("b", 2), ("c", 2)], "warc string, n int")).collect())) == [("a", 1), ("b", 2), ("c", 2)]


def test_parts_and_manifest(spark, tmp_path):
    tasks = spark.createDataFrame([("m", k, f"p{k}", f"line {k}") for k in range(10)], "model string, n long, prompt_id string, line string").withColumn("size", F.octet_length("line") + 1).withColumn("t", F.lit(5))
    bins = routing.pack_bins(tasks, "model", "n", "size", "t", 20)
    parts = tasks.join(bins.select(F.col("ordinal").alias("n"), F.col("bin").alias("part")), "n")
    made = sinks.request_parts(parts, f"{tmp_path}/out", "model", "part", "line", "n")
    assert sorted((r.part, r.requests, r.bytes) for r in made.collect()) == [(0, 4, 28), (1, 4, 28), (2, 2, 14)]
    assert spark.read.text(f"{tmp_path}/out").count() == 10
    tampered = made.withColumn("ids_sha256", F.when(F.col("part") == 1, "x").otherwise(F.col("ids_sha256"))).where("part <> 2")
    assert {(r.part, r.problem) for r in quality.artifact_differences(made, tampered, "part", ["requests", "ids_sha256"]).collect()} == {(1, "ids_sha256"), (2, "missing")}


def test_fusion(spark):
    frame = spark.createDataFrame
    candidates = frame([("1", "a.com", "whois", "a"), ("1", "a.org", "peering", "a"), ("2", "gmail.com", "whois", "gmail"), ("3", "acme.com", "whois", "acme"), ("3", "other.com", "ip", "other"), ("3", "gmail.com", "ip", "gmail")], "asn string, domain string, source string, sld string")
    got = {r.asn: r.domains for r in website.fuse(candidates, frame([("3", "ACME-AS", "Acme Corp")], "asn string, as_name string, org_name string")).collect()}
    assert got == {"1": ["a.com", "a.org"], "2": ["gmail.com"], "3": ["acme.com"]}


def test_combination(spark):
    frame = spark.createDataFrame
    out = website.combine(
        frame([(str(k),) for k in range(5)], "asn string"), frame([("1", "http://c.com", "http://c.com/x"), ("2", "http://d.com", "http://e.com")], "asn string, original string, final string"),
        frame([("0", "https://s.com."), ("1", "No match."), ("2", "https://bgp.he.net/AS2")], "asn string, answer string"), frame([("3", "http://i.com")], "asn string, url string"),
    )
    got = {r.asn: (r.url, r.origin, r.accessible) for r in out.collect()}
    assert got == {"0": ("https://s.com", "web_search", True), "1": ("http://c.com/x", "center", True), "2": ("http://d.com", "center", False), "3": ("http://i.com", "imputed", True), "4": (None, "none", None)}


def test_label_merge(spark):
    frame = lambda rows: spark.createDataFrame(rows, "asn string, category string")
    site, wiki = frame([("1", "A"), ("1", "B"), ("2", "A")]), frame([("1", "C")])
    merged = labels.merge_labels([("site", site), ("wiki", wiki)])
    assert sorted(map(tuple, merged.collect())) == [("1", "C", "wiki"), ("2", "A", "site")]
    groups = spark.createDataFrame([("1", "O"), ("2", "O"), ("3", "O")], "asn string, org_id string")
    got = sorted(map(tuple, labels.with_siblings(merged, groups).collect()))
    assert got == [("1", "A", "Inherit from 2"), ("1", "C", "wiki"), ("2", "A", "site"), ("2", "C", "Inherit from 1"), ("3", "A", "Inherit from 2"), ("3", "C", "Inherit from 1")]
    assert [tuple(r) for r in labels.overlap([("site", site), ("wiki", wiki)]).collect()] == [("1", ["site", "wiki"])]


def test_payloads(spark):
    pages = spark.createDataFrame([("k", "u1", "2024-01-01", "r1", "a" * 10), ("k", "u1", "2024-02-01", "r2", "b" * 10), ("k", "u2", "2024-01-05", "r3", "c" * 10), ("k", "u3", None, "r4", " ")], "key string, url string, at string, rid string, text string")
    ranked = labels.page_texts(pages, "key", "url", "at", "rid", "text", F.col("url") == "u2")
    assert [r.url for r in ranked.orderBy("rank").collect()] == ["u2", "u1"]
    body = labels.payloads(ranked, "key", "url", "text", F.length("text"), 15).first()
    assert (body.body, body.tokens) == ("URL: u2\ncccccccccc\n\nURL: u1\nbbbbb", 15)


def test_dedup_apply_and_gate(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "x string")
    out = relational.dedup_apply(rows, "x", lambda d: d.withColumn("y", F.upper("x")))
    assert sorted(str(r.y) for r in out.collect()) == ["A", "A", "B", "None"]
    assert [tuple(r) for r in quality.gate(spark.createDataFrame([(0, 3)], "a int, b int")).collect()] == [(False, ["b"])]


def test_streams(spark, tmp_path):
    folder, table, mark = tmp_path / "in", f"{tmp_path}/table", f"{tmp_path}/mark"
    folder.mkdir()
    schema = "id string, status string, ts long"

    def add(name, *rows):
        (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))

    def run():
        stream = logs.tail(spark, str(folder), schema)
        logs.run_available(stream, lambda batch, _: logs.upsert_latest(batch, table, "id", "ts"), mark).awaitTermination()
        return {r.id: r.status for r in logs.latest_table(spark, table).collect()}

    add("1.json", {"id": "a", "status": "submitted", "ts": 1}, {"id": "b", "status": "submitted", "ts": 1})
    assert run() == {"a": "submitted", "b": "submitted"}
    add("2.json", {"id": "a", "status": "completed", "ts": 5}, {"id": "b", "status": "old", "ts": 0})
    assert run() == {"a": "completed", "b": "submitted"}
    seen = logs.first_of_content(logs.tail(spark, str(folder), schema), ["id"])
    seen.writeStream.format("memory").queryName("seen").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("seen").count() == 2
    events = logs.tail(spark, str(folder), schema).withColumn("at", F.timestamp_seconds("ts"))
    logs.windowed_counts(events, "at", "1 minute", "10 seconds", "status").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sum(r.n for r in spark.table("counts").collect()) == 4
