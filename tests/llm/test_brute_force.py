"""Operators against plain versions on small fixtures."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from strandline.llm import byte_bpe, byte_cnn, components, exact_dedup, maxent_lm, mixing, pii, quality_rules, sharding, simhash, sql, url_filter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sql.ORACLES)
def test_sql(same, name):
    same(driver.queries()[name], sql.ORACLES[name])


# exact dedup


def plain_groups(rows):
    space = str.maketrans("", "", " \t\n\x0b\x0c\r")
    groups = defaultdict(list)
    for doc, text in rows:
        groups[(text or "").translate(space)].append((-len(text or ""), doc))
    return {k: (min(v)[1], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize(("digest_bytes", "salt_rows"), [(32, 64), (32, 2), (1, 2), (1, 64)])
def test_exact_groups(spark, digest_bytes, salt_rows):
    rnd = random.Random(1)
    rows = [(k, rnd.choice(["a b", "ab", "a  b", "c", None, "", " ", "d" * (k % 7), f"t{k % 40}"])) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want, space = plain_groups(rows), str.maketrans("", "", " \t\n\x0b\x0c\r")
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(df, digest_bytes=digest_bytes, salt_rows=salt_rows).collect()}
    for doc, text in rows:
        key = (text or "").translate(space)
        assert (got[doc].keep_id, got[doc].group_size, got[doc].kept) == (*want[key], want[key][0] == doc)
        assert got[doc].text_sha256 == hashlib.sha256(key.encode()).hexdigest()[: 2 * digest_bytes]
    kept = exact_dedup.drop_exact_duplicates(df, digest_bytes=digest_bytes, salt_rows=salt_rows).collect()
    assert sorted(r.doc_id for r in kept) == sorted(k for k, _ in want.values())


def test_repeated_row_stays_once(spark):
    df = spark.createDataFrame([(1, "x y")] * 300 + [(2, "xy")], "doc_id long, text string").repartition(4)
    assert sum(r.kept for r in exact_dedup.exact_duplicates(df, salt_rows=4).collect()) == 1
    assert [r.doc_id for r in exact_dedup.drop_exact_duplicates(df, salt_rows=4).collect()] == [1]


def test_memtables_flush_sorted():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([str(k % 20).encode() for k in range(50)])], ["doc_id", "body"])
    runs = list(exact_dedup.memtables(32, pa.int64(), 4, 8)(iter([batch])))
    assert len(runs) > 1 and all((d := r.column(1).to_pylist()) == sorted(d) and (s := r.column(0).to_pylist()) == sorted(s) for r in runs)
    assert sum(sum(r.column(4).to_pylist()) for r in runs) == 50


def test_levels_merge(spark):
    """Compaction of two batches equals that of all rows; each shard is one sorted run."""
    rows = [(k, f"text {k % 70}" + " " * (k % 3)) for k in range(400)]
    frame = lambda part: spark.createDataFrame(part, "doc_id long, body string").withColumn("body", F.col("body").cast("binary")).repartition(3)
    whole = exact_dedup.compact(exact_dedup.flush_runs(frame(rows), 32, 4, 16), 4)
    half = exact_dedup.compact(exact_dedup.flush_runs(frame(rows[:150]), 32, 4, 16), 4)
    both = exact_dedup.extend(half, frame(rows[150:]), 4, text="body")
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, whole.collect())) and whole.count() == 70
    assert sorted((r.best_id, r.best_len, r.n) for r in whole.collect()) == sorted((min(i for i, t in g if len(t) == (m := max(len(t) for _, t in g))), m, len(g)) for g in ([(i, t) for i, t in rows if t.strip() == f"text {j}"] for j in range(70)))
    for part in whole.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.collect_list("digest").alias("d"), F.collect_set("shard").alias("s")).collect():
        assert list(map(bytes, part.d)) == sorted(map(bytes, part.d)) and len(part.s) == 1


def test_filters_have_few_false_positives():
    digests = [hashlib.sha256(b"%d" % k).digest() for k in range(40_000)]
    shard = exact_dedup.shard_of(exact_dedup._words(digests), 5)
    parts = {k: exact_dedup.run_filter([d for d, s in zip(digests[:20_000], shard) if s == k]) for k in range(4)}
    filters = exact_dedup.Filters(5, parts)
    assert all(f or s == 4 for f, s in zip(filters.may_have(digests[:20_000]), shard))
    wrong = filters.may_have(digests[20_000:])
    assert wrong.mean() < 0.008 and not wrong[shard[20_000:] == 4].any()
    # Filters grow with their entries, so the rate for 1e8 entries is that for any number: (1 - e^(-kn/m))^k.
    k, bits, n = exact_dedup.FILTER_HASHES, exact_dedup.FILTER_BITS, 10**8
    assert (1 - math.exp(-k * n / (bits * n))) ** k < 0.004
    assert n * bits // 8 < exact_dedup.FILTER_BYTES


@pytest.mark.parametrize("kind", ["null", "text", "unfiltered"])
def test_exact_groups_under_awkward_identifiers(spark, kind):
    """Hot groups under null identifiers, identifiers of text, and an index too large for its filters."""
    name = {"null": lambda k: None if k % 3 else k, "text": lambda k: f"id{k:04d}", "unfiltered": lambda k: k}[kind]
    rows = [(name(k), "same  text" if k % 2 else f"own {k}" if k % 4 else "same text") for k in range(1200)]
    df = spark.createDataFrame(rows, "doc_id string, text string" if kind == "text" else "doc_id long, text string").repartition(3)
    size = 0 if kind == "unfiltered" else exact_dedup.FILTER_BYTES
    got = exact_dedup.exact_duplicates(df, salt_rows=8, filter_bytes=size).collect()
    groups = Counter((t or "").replace(" ", "") for _, t in rows)
    keep = min(((d is None, d) for d, t in rows if t == "same  text"))[1]
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    assert Counter((r.keep_id, r.group_size) for r in got if r.group_size > 1) == {(keep, groups["sametext"]): groups["sametext"]}
    kept = exact_dedup.drop_exact_duplicates(df, salt_rows=8, filter_bytes=size).collect()
    assert Counter(r.text.replace(" ", "") for r in kept) == {t: 1 for t in groups}
    assert [(r.doc_id, r.text) for r in kept if r.text.startswith("same")] == [(keep, "same  text")]


def test_hot_copies_under_null_identifiers_are_dealt_evenly(spark):
    df = spark.createDataFrame([(None, "one text")] * 4000, "doc_id long, text string").repartition(2)
    rows = df.select("doc_id", F.col("text").cast("binary").alias("body"))
    index = exact_dedup.build_index(rows, 32, 64)
    probed = rows.mapInArrow(exact_dedup.probe(index.shared, 32), "doc_id long, n_points long, digest binary, pos long, salt int, body binary")
    sizes = [r["count"] for r in probed.groupBy("salt").count().collect()]
    assert len(sizes) == 63 and max(sizes) <= 80


# near dedup


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    docs = list(prints)
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(docs):
        for b in docs[i + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in docs}


def test_simhash(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    base = [f"word{k} thing{k % 7} more{k % 5}" for k in range(60)]
    rows += [(10_000 + k, " ".join(base[: 60 - k % 3] + ["tail"] * (k % 4))) for k in range(40)] + [(20_000, None), (20_001, ""), (20_002, "A b")]
    prints = {d: plain_fingerprint(t) for d, t in rows}
    want = plain_components(prints)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    assert {d: int(r.fingerprint, 16) for d, r in got.items()} == prints
    assert {d: r.component_id for d, r in got.items()} == want
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect()) == sorted(set(want.values()))


def test_reused_and_null_identifiers_lose_no_class(spark):
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(40))
    rows = [(1, text(0)), (1, text(1)), (1, text(1)), (2, text(2)), (2, text(0)), (3, text(3)), (4, text(3))] + [(None, text(k)) for k in (4, 5, 6, 6, 3)]
    out = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in out) == sorted([(1, text(0)), (1, text(1)), (2, text(2)), (3, text(3))] + [(0, text(k)) for k in (4, 5, 6)])


@pytest.mark.parametrize("kind", ["random", "pairs", "ball", "count"])
def test_tree_loses_no_link(spark, kind):
    rng = np.random.default_rng(5)
    points = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    if kind == "pairs":
        flips = np.array([1 << int(k) for k in rng.integers(0, 64, 700)], np.uint64) ^ np.array([1 << int(k) for k in rng.integers(0, 64, 700)], np.uint64)
        points = np.concatenate([points, points[:700] ^ flips])
    if kind == "ball":
        points = np.array([99 ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 64, (4000, 3))], np.uint64)
    if kind == "count":
        points = np.arange(1500, dtype=np.uint64) * np.uint64(3)
    points = np.unique(points)
    want = np.arange(len(points))
    for k in range(0, len(points), 256):
        a, b = np.nonzero(np.bitwise_count(points[k:k + 256, None] ^ points[None, :]) <= 2)
        simhash._join(want, k + a, b)
    assert (simhash.shard_links(points) == want).all()
    prints = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long").repartition(3)
    signed = points.view(np.int64)
    for shard in (64, 100_000):
        stars = components.components(simhash.links(prints, len(points), shard_points=shard)).collect()
        at = {int(p): k for k, p in enumerate(signed)}
        got = np.arange(len(points))
        for r in stars:
            simhash._join(got, np.array([at[r.u]]), np.array([at[r.v]]))
        for r in stars:
            simhash._join(got, np.array([at[r.u]]), np.array([at[r.v]]))
        assert (got == want).all()


def test_components_of_a_path(spark):
    n = 200
    order = list(range(n))
    random.Random(2).shuffle(order)
    path = spark.createDataFrame([(order[k], order[k + 1]) for k in range(n - 1)] + [(1000, 1001), (5000, 5000)], "u long, v long")
    for hub in (components.HUB, 3):
        got = {r.u: r.v for r in components.components(path, hub).collect()}
        assert got == {k: 0 for k in range(1, n)} | {1001: 1000}


def test_components_of_stars(spark):
    stars = [(k, k % 3) for k in range(3, 600)] + [(600, 5), (601, 600)]
    for hub in (components.HUB, 50):
        got = {r.u: r.v for r in components.components(spark.createDataFrame(stars, "u long, v long"), hub).collect()}
        assert got == {k: k % 3 for k in range(3, 600)} | {600: 2, 601: 2}


@pytest.mark.parametrize("spread", ["uniform", "cluster"])
def test_leaves_are_split_again(spark, spread):
    """A sample of 32 points misjudges the leaves; afterwards none has more points than twice the shard's."""
    rng = np.random.default_rng(7)
    points = rng.integers(0, 2**63, 30_000, dtype=np.uint64)
    if spread == "cluster":
        points[1000:] = points[1000:] & np.uint64((1 << 22) - 1) | np.uint64(0xABCDEF << 24)
    points = np.unique(points)
    prints = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long").repartition(3).cache()
    tree = simhash.upper_tree(prints, len(points), 2000, sample=32)
    sizes = np.zeros(len(tree.dense), int)
    for leaf, rows in tree.route(points):
        sizes[leaf] += len(rows)
    assert max(n for n, dense in zip(sizes, tree.dense) if not dense) <= 4000 and sum(tree.dense) <= len(tree.dense) // 4


def test_near_duplicates_under_identifiers_of_text(spark):
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(40))
    rows = [(f"id{k:02d}", text(k // 2)) for k in range(12)] + [(None, text(3)), (None, text(9))]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = simhash.near_duplicates(df).collect()
    assert sorted((r.doc_id or "", r.component_id or "") for r in got) == sorted([(f"id{k:02d}", f"id{k // 2 * 2:02d}") for k in range(12)] + [("", "id06"), ("", "")])
    assert sorted((r.doc_id or "", r.text) for r in simhash.drop_near_duplicates(df).collect()) == sorted([(f"id{k:02d}", text(k // 2)) for k in range(0, 12, 2)] + [("", text(9))])


# tokens


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def test_bpe_equals_library(codec):
    from array import array

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rnd = random.Random(4)
    atoms = ["a", "ab", "the", " ", "  ", "\n", "\t", "é", "😀", "1", "23", "!", "&&", "|", "'s", "'ll", "\x1c", "\xa0", "　", "日本", "zz", "tion", " th", "\r\n", ".", ",", "ing."]
    texts = ["".join(rnd.choices(atoms, k=rnd.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(rnd.choices("abcdeéthinos", k=n)) for n in (7, 25, 26, 100, 3000)] + [c * n for c in "a -=日\n" for n in (1, 24, 25, 1999)]
    for t in texts:
        ids = array("i")
        codec.encode(t, ids)
        assert ids.tolist() == library.encode_ordinary(t), t[:50]
        assert codec.decode(ids.tolist()) == t.encode()


def test_reduction_equals_direct_merging(codec):
    rnd = random.Random(9)
    for n in range(1, 400, 7):
        part = "".join(rnd.choices("thionser éß", k=n)).encode()
        assert codec.reduce(part) == codec.merge(part)


def test_unknown_id(codec):
    for bad in (-1, 10**6):
        with pytest.raises(ValueError):
            codec.decode([1, bad])


def test_two_vocabularies_in_one_session(spark, tmp_path):
    """Each broadcast is used with its own codec, whatever address or order it comes in."""
    import base64

    own = tmp_path / "own.tiktoken"
    own.write_text("".join(f"{base64.b64encode(bytes([k])).decode()} {k}\n" for k in range(256)) + f"{base64.b64encode(b'ab').decode()} 256\n")
    docs = spark.createDataFrame([(1, "ab the abab"), (2, "bab")], "doc_id long, text string").repartition(2)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = {p: tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(p), special_tokens={}) for p in (path, str(own))}
    for p in (path, str(own), path, str(own), path):
        got = byte_bpe.decode(byte_bpe.encode(docs, byte_bpe.share(spark, p, public_tokenizers.PATTERN)), byte_bpe.share(spark, p, public_tokenizers.PATTERN)).collect()
        assert all(r.ids == library[p].encode_ordinary(r.text) and bytes(r.decoded) == r.text.encode() for r in got)


# classifier


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = driver.queries()["op4_byte_cnn"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == r.quality for r in held) / len(held) >= 0.9


def test_gradients():
    rng = np.random.default_rng(0)
    net = byte_cnn.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts, labels = [byte_cnn.chunks(bytes(rng.integers(32, 120, n).astype(np.uint8))) for n in (10, 300, 900)], np.array([0.0, 1.0, 1.0])

    def loss():
        s = np.clip([_forward(net, t) for t in texts], 1e-9, 1 - 1e-9)
        return -np.mean(labels * np.log(s) + (1 - labels) * np.log(1 - s))

    grads = net.gradients(texts, labels)
    for name, p in net.p.items():
        at = np.unravel_index(int(np.abs(grads[name]).argmax()), p.shape)
        keep, eps = p[at], 1e-4
        p[at] = keep + eps
        up = loss()
        p[at] = keep - eps
        down = loss()
        p[at] = keep
        assert grads[name][at] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=1e-4), name


def _forward(net, rows):
    p = net.p
    sites = (net.windows(rows).reshape(-1, byte_cnn.WIDTH * byte_cnn.VECTOR) @ p["filters"]).reshape(len(rows), -1, byte_cnn.FILTERS)
    h = np.maximum(np.maximum(sites.max(1) + p["filter_bias"], 0) @ p["hidden"] + p["hidden_bias"], 0)
    return 1 / (1 + np.exp(-(np.concatenate([h.max(0), h.mean(0)]) @ p["out"] + p["out_bias"][0])))


def test_scores_equal_plain_convolutions(spark):
    """Scores of whole texts by loops over chunks, sites and filters."""
    sf, net = "/root/testdata/sf0.001", byte_cnn.Network()
    net.p["out"] = np.random.default_rng(1).standard_normal(len(net.p["out"]))
    docs = spark.createDataFrame([(1, "short"), (2, None), (3, "x y " * 400)], "doc_id long, text string").union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(3))
    p = {k: v.astype(float) for k, v in net.p.items()}
    texts = [(r.text or "").encode() for r in docs.collect()]
    for raw, r in zip(texts, byte_cnn.score(docs, net).collect()):
        hidden = []
        for at in range(0, max(1, len(raw) - byte_cnn.CHUNK + byte_cnn.STEP), byte_cnn.STEP):
            part = raw[at:at + byte_cnn.CHUNK].ljust(byte_cnn.CHUNK, b"\0")
            sites = [np.concatenate([p["vectors"][b] for b in part[k:k + byte_cnn.WIDTH]]) for k in range(0, byte_cnn.CHUNK - byte_cnn.WIDTH + 1, byte_cnn.STRIDE)]
            pooled = np.maximum(np.max([s @ p["filters"] for s in sites], 0) + p["filter_bias"], 0)
            hidden.append(np.maximum(pooled @ p["hidden"] + p["hidden_bias"], 0))
        z = np.concatenate([np.max(hidden, 0), np.mean(hidden, 0)]) @ p["out"] + p["out_bias"][0]
        assert r.score == pytest.approx(1 / (1 + math.exp(-min(30, max(-30, z)))), abs=1e-4)


def test_training_reads_whole_texts():
    """A mark behind the first 40 chunks of long texts decides the label."""
    rnd = random.Random(5)
    body = lambda n: "".join(rnd.choices("abcdefgh ", k=n))
    texts = [(body(10_000) + ("ZZZZZZZZ" if k % 2 else "") + body(200)).encode() for k in range(60)]
    net = byte_cnn.Network()
    net.fit(texts, np.array([float(k % 2) for k in range(60)]), 60)
    assert np.mean([(s >= 0.5) == (k % 2 == 1) for k, s in enumerate(net.scores(texts))]) >= 0.95


def test_chunks_cover_the_text():
    for n in (0, 1, 255, 256, 257, 480, 481, 5000):
        starts = byte_cnn.chunk_starts(n)
        assert starts[0] == 0 and starts[-1] + byte_cnn.CHUNK >= n and all(b - a < byte_cnn.CHUNK for a, b in zip(starts, starts[1:]))


# language model


def test_base_score(spark, docs):
    rows = docs.collect()
    words = lambda t: (t or "").encode().lower().split() + [b""]
    train = Counter(w for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for w in words(r.text))
    n, v = sum(train.values()), len(train)
    for listed in (1 << 20, 300):
        got = {r.doc_id: r for r in maxent_lm.score_documents(docs, listed=listed).collect()}
        for r in rows:
            own, x = words(r.text), got[r.doc_id]
            assert (x.n_tokens, x.n_known, x.train_tokens) == (len(own), sum(train[w] > 0 for w in own), n)
            assert x.base_score == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
        held = [x for x in got.values() if x.held_out]
        assert sum(x.score for x in held) > sum(x.base_score for x in held)


def _plain_hash(x, salt):
    return ((x + salt) * 0x9E3779B97F4A7C15 % 2**64) >> 33


def _plain_factor(bias, rows, weights, branch):
    z = [float(b) + sum(float(weights[r][k]) for r in rows) for k, b in enumerate(bias)]
    top = max(z)
    return z[branch] - top - math.log(sum(math.exp(x - top) for x in z))


def _plain_group(m, g, one, two):
    r = m.shape.rows
    return _plain_factor(m.biases[0][0], [_plain_hash(one, 1) % r, _plain_hash(two, 2) % r + r], m.weights[0], g)


def _plain_block(m, g, b, one, two):
    r = m.shape.rows
    return _plain_factor(m.biases[1][g], [_plain_hash(one * 131_071 + g, 4) % r], m.weights[1], b)


def _plain_score(m, v, place, words, count):
    """Base-10 logarithm of a text's probability, token by token from the model's arrays."""
    n, r, total = len(v.listed), m.shape.rows, 0.0
    suffix = lambda w: int.from_bytes(w[-2:].rjust(2), "big") * 40503 % 65521 % maxent_lm.SUFFIXES
    at = [place[w] if w in place else n + suffix(w) for w in words]
    ctx = [int(m.context[-1])] * 2 + [int(m.context[t]) for t in at]
    for k, t in enumerate(at):
        one, two, g, b = ctx[k + 1], ctx[k], int(m.group[t]), int(m.block[t])
        total += _plain_group(m, g, one, two) + _plain_block(m, g, b, one, two)
        if m.place[t] >= 0:
            node = g * m.shape.blocks + b
            total += _plain_factor(m.biases[2][node], [_plain_hash(one * 131_071 + node, 6) % r], m.weights[2], int(m.place[t]))
        else:
            total += math.log((count[words[k]] + 1) / m.tail_mass[g])
    return total / math.log(10)


@pytest.mark.parametrize("listed", [1 << 20, 300])
def test_score_equals_plain_sums(spark, docs, listed):
    _, counts, shared, _, m = maxent_lm.prepare(docs, "doc_id", "text", listed)
    v, count = shared.value, Counter({bytes(r.token): r.n for r in counts.collect()})
    place = {w: k for k, w in enumerate(v.listed)}
    got = {r.doc_id: r.score for r in maxent_lm.score_documents(docs, listed=listed).collect()}
    for r in sorted(docs.collect(), key=lambda r: r.n_chars)[::9]:
        assert got[r.doc_id] == pytest.approx(_plain_score(m, v, place, (r.text or "").encode().lower().split() + [b""], count), rel=1e-5), r.doc_id
    known = np.arange(len(v.listed))
    for one, two in ((3, 9), (int(m.context[-1]), int(m.context[-1])), (17, int(m.context[-2]))):
        p = np.exp(maxent_lm.log_probability(m, known, np.full(len(known), one), np.full(len(known), two)))
        share = np.where(m.place[known] < 0, (v.counts + 1) / m.tail_mass[m.group[known]], 1)
        rest = sum(  # unlisted and unseen tokens by suffix, and the word that stands for all unseen ones of a group
            np.exp(maxent_lm.log_probability(m, np.array([t]), np.array([one]), np.array([two])))[0] * (v.unlisted[t - len(v.listed)]) / m.tail_mass[m.group[t]]
            for t in range(len(v.listed), len(v.listed) + maxent_lm.SUFFIXES)
        )
        unseen = sum(math.exp(_plain_group(m, g, one, two) + _plain_block(m, g, m.shape.blocks, one, two)) / m.tail_mass[g] for g in range(m.shape.groups))
        assert float((p * share).sum() + rest + unseen) == pytest.approx(1, abs=1e-4)


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    runs = [{r.doc_id: (r.held_out, r.n_tokens, r.base_score, r.score) for r in maxent_lm.score_documents(docs.repartition(n)).collect()} for n in (1, 32, 200)]
    for other in runs[1:]:
        assert max(abs(other[d][3] - x[3]) for d, x in runs[0].items()) < 1e-6
    held = [x for x in runs[0].values() if x[0]]
    assert sum(x[3] - x[2] for x in held) / sum(x[1] for x in held) >= 0.1


def test_gradient_is_expected_minus_observed(spark, docs):
    _, _, shared, _, m = maxent_lm.prepare(docs, "doc_id", "text", 1 << 20)
    v = shared.value
    s = maxent_lm.encode([b"the of and the in", b"der die und"], {w: k for k, w in enumerate(v.listed)}, m.context)
    sums = [np.zeros((len(w), w.shape[1] + 1), np.int64) for w in m.weights]
    maxent_lm.gradient(m, s.at, s.one, s.two, sums)
    m.weights, m.biases = [w.astype(np.float64) for w in m.weights], [b.astype(np.float64) for b in m.biases]
    for w, g in zip(m.weights, sums):
        for row, col in zip(*np.nonzero(np.abs(g[:, :-1]) > 0.05 * maxent_lm.UNIT)):
            loss = []
            for step in (1e-4, -2e-4):
                w[row, col] += step
                loss.append(-maxent_lm.log_probability(m, s.at, s.one, s.two).sum())
            w[row, col] += 1e-4
            assert g[row, col] / maxent_lm.UNIT == pytest.approx((loss[0] - loss[1]) / 2e-4, abs=1e-3)


# mixing


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 500)
    t = rng.integers(1, 1000, 500)
    known = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p)], "t long, p array<double>")
    for weights in ((0.6, 0.3, 0.1), (0.98, 0.01, 0.01)):
        w = np.array(weights)
        fit = mixing.fit_rates(known, w)
        rates = np.array([r[0] for r in known.select(mixing._rate("p", fit.steps)).collect()])
        now = np.array([r.t for r in known.collect()]) * rates @ np.array([r.p for r in known.collect()])
        assert (rates >= 0).all()
        assert now / now.sum() == pytest.approx(w, abs=0.01) and now == pytest.approx(fit.reached)


def test_missed_targets_are_reported(spark):
    """All posteriors agree, so no rates reach other shares; the fit says so."""
    known = spark.createDataFrame([(10, [0.6, 0.4])] * 20, "t long, p array<double>")
    with pytest.warns(UserWarning, match="missed by"):
        fit = mixing.fit_rates(known, np.array([0.1, 0.9]), 200.0)
    assert fit.missed > 0.1 and fit.goal == pytest.approx([20, 180])


def _plain_rates(t, p, goal):
    """The same projected steps with plain loops."""
    rates, step_length, k = [1.0] * len(t), 1.0, len(goal)
    totals = lambda r: np.array([sum(r[d] * t[d] * p[d][j] for d in range(len(t))) for j in range(k)])
    now = totals(rates)
    for _ in range(mixing.ROUNDS):
        error = now - goal
        if np.abs(error).sum() <= mixing.TOLERANCE * goal.sum():
            break
        h = np.array([[sum(t[d] * p[d][a] * p[d][b] for d in range(len(t)) if rates[d] > 0) for b in range(k)] for a in range(k)])
        step = step_length * np.linalg.solve(h + 1e-9 * np.trace(h) * np.eye(k), error)
        tried = [max(0.0, r - float(np.dot(p[d], step))) for d, r in enumerate(rates)]
        then = totals(tried)
        if (then - goal) @ (then - goal) < error @ error:
            rates, now, step_length = tried, then, min(1.0, 2 * step_length)
        else:
            step_length /= 2
    return rates


def test_query_equals_plain_rates(spark):
    """Rates, copies and totals of the registered query, recomputed from its posteriors on the whole small table."""
    got = driver.queries()["op1_mixing"](spark, SF).collect()
    t, p = [r.n_tokens for r in got], [[r[f"p_{d}"] for d in mixing.DOMAINS] for r in got]
    now = np.array([sum(a * b[j] for a, b in zip(t, p)) for j in range(3)])
    goal = mixing.goals(now, np.array(mixing.TARGETS), None, np.array([True, False, False]))
    assert [r.rate for r in got] == pytest.approx(_plain_rates(t, p, goal), abs=1e-6)
    assert all(math.floor(r.rate) <= r.copies <= math.floor(r.rate) + 1 for r in got)
    reached = np.array([sum(r.rate * r.n_tokens * q[j] for r, q in zip(got, p)) for j in range(3)])
    assert reached == pytest.approx(goal, rel=1e-3)
    assert sum(r.copies * r.n_tokens for r in got) == pytest.approx(goal.sum(), rel=0.05)


def test_copies_follow_rates(spark):
    """Repeated rows and rows without identifiers draw on their own."""
    model = mixing.Classifier({}, np.zeros(256), np.ones(256), np.zeros((256, 2)), np.zeros(2))
    for doc in (None, b"7"):
        rows = spark.createDataFrame([(doc, b"same text")] * 20_000, "id binary, body binary").repartition(4)
        drawn = rows.mapInArrow(mixing._annotate(model, ["t", "p", "u"]), "t long, p array<double>, u double").withColumn("rate", F.lit(1.3))
        assert abs(drawn.agg(F.avg(mixing.copies("rate", "u")).alias("m")).first().m - 1.3) < 0.02


@pytest.mark.parametrize("toxic", [0, 3])
def test_scarce_unwanted_domain_costs_no_clean_rows(spark, toxic):
    """No poor row at all, and no toxic one or 0.2 %."""
    rng = random.Random(3)
    text = lambda k: " ".join(rng.choices([f"foul{j}xx" for j in range(9)] if k < toxic else [f"plain{j}" for j in range(40)], k=60))
    rows = spark.createDataFrame([(k, text(k)) for k in range(1500)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, "toxic" if k < toxic else "good") for k in range(1500)], "doc_id long, domain string")
    kept = [r.doc_id for r in mixing.mix(rows, labels).select("doc_id").collect()]
    assert len({d for d in kept if d >= toxic}) >= 0.97 * (1500 - toxic) and len(kept) <= 1.03 * 1500


def test_common_unwanted_domains_are_cut():
    now, w, wanted = np.array([810.0, 70, 120]), np.array(mixing.TARGETS), np.array([True, False, False])
    assert mixing.goals(now, w, None, wanted) == pytest.approx(w * 810 / 0.95)
    assert mixing.goals(np.array([990.0, 8, 2]), w, None, wanted) == pytest.approx([990, 8, 2])
    assert mixing.goals(now, w, 500.0, wanted) == pytest.approx(w * 500)


# URL filter


def test_terms_decide(spark):
    """URLs that no rule fits: borders, escapes, joined words, plurals, and sums of soft terms."""
    urls = {
        "https://a.test/porn/1": ("block", 1, 0), "https://a.test/xpornx": ("allow", 0, 0), "https://a.test/%50%6Frn": ("block", 1, 0), "https://a.test/%2570orn": ("allow", 0, 0),
        "https://a.test/online%20casino": ("block", 1, 1), "https://a.test/Online_Casinos": ("block", 1, 1), "https://a.test/onlinecasino": ("allow", 0, 0),
        "https://adult.test/poker": ("block", 0, 2), "https://adult.test/adult/adults": ("allow", 0, 1), "https://a.test/cheap/pills/deal": ("block", 0, 3),
        "https://a.test/cheap/pills": ("allow", 0, 2), "https://a.test/news/sussex": ("allow", 0, 0), "porn": ("block", 1, 0), "https://a.test/éporné": ("block", 1, 0), "": ("allow", 0, 0),
    }
    got = url_filter.judge_urls(spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")).orderBy("page_id").collect()
    assert {u: (r.verdict, r.n_strict, r.n_soft) for u, r in zip(urls, got)} == urls and not any(r.rule for r in got)
    assert got[0].weight == 3 and got[7].weight == 3 and got[10].weight == 2


def test_vocabulary_table(spark):
    table = spark.createDataFrame([("Bad Word", 2.0), ("bad word", 1.0), ("odd", 1.0), (None, 5.0), ("worse", None)], "term string, weight double")
    terms = url_filter.vocabulary(table)
    assert terms == {"Bad Word": 2.0, "bad word": 1.0, "odd": 1.0}
    urls = spark.createDataFrame([(1, "http://h/bad+word/odd"), (2, "http://h/worse")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge_urls(urls, terms={"bad word": 2.0, "odd": 1.0}).orderBy("page_id").collect()] == ["block", "allow"]
    assert [r.verdict for r in url_filter.judge_urls(urls, terms={}).collect()] == ["allow", "allow"]


def test_terms_decide_on_the_test_tables(spark):
    got = driver.queries()["op5_url_filter"](spark, "/root/testdata/sf0.1").where("rule is null").groupBy("verdict").count().collect()
    assert {r.verdict for r in got} == {"allow", "block"}


# quality rules, personal data, sharding


def test_repeated_words():
    for text, n in (("a b c d", 0), ("a b c a b c", 6), ("a a a a", 4), ("x a b c y a b c", 6), ("a b c", 0), ("", 0)):
        assert quality_rules.repeated_words(text.encode().split()) == n, text


def test_frequent_lines_deplete(spark):
    own = lambda k: " ".join(f"own{k}w{j}" for j in range(60))
    shared = " ".join(f"menu{j}" for j in range(200))
    rows = [(k, f"{own(k)}\n{shared}" if k < 30 else own(k), "h" if k % 2 else "g") for k in range(120)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), limit=10).collect()}
    assert sorted(d for d, r in got.items() if not r.kept) == list(range(30)) and got[0].n_frequent_words == 200
    copies = spark.createDataFrame([(k, own(0), "h") for k in range(50)], "doc_id long, text string, source string")
    assert all(r.kept for r in quality_rules.judge(copies, limit=10).collect())


def test_template_of_a_hot_host(spark):
    """A line in 100 of several thousand documents of one host is a template there; one in 20 isn't, nor is it elsewhere."""
    own = lambda k, n: " ".join(f"own{k}w{j}" for j in range(n))
    menu, rare = " ".join(f"menu{j}" for j in range(40)), " ".join(f"rare{j}" for j in range(40))
    text = lambda k: f"{own(k, 45)}\n{menu}" if k < 100 else f"{own(k, 45)}\n{rare}" if k < 120 else own(k, 60)
    rows = [(k, text(k), "hot") for k in range(4000)] + [(4000 + k, f"{own(4000 + k, 45)}\n{menu}", "cold") for k in range(20)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)).collect()}
    assert sorted(d for d, r in got.items() if not r.kept) == list(range(100)) and not any(r.base_failed for r in got.values())
    assert {r.n_frequent_words for d, r in got.items() if d >= 100} == {0}


def test_lines_decide_on_the_test_tables(spark):
    """The verdict of some documents of the tables comes from their lines, not from the base rules."""
    got = driver.queries()["op6_quality_rules"](spark, "/root/testdata/sf0.1").where("not base_failed").selectExpr("count(*) n", "count_if(not kept) gone", "count_if(n_frequent_words > 0) touched").first()
    assert got.touched > 1000 and 0 < got.gone < 0.02 * got.n


def test_frequent_lines_leave_the_texts(spark, tmp_path):
    own = lambda k: "\n\n".join(" ".join(f"own{k}p{i}w{j}" for j in range(40)) for i in range(2))
    line = "Menu  of this\tsite"
    rows = [(k % 100 or None, f"{line}\n{own(k)}\nmenu OF this site" if k < 60 else own(k), "en", "h" if k < 130 else None, 7) for k in range(160)] + [(500, "short " + line, "en", "h", 9), (501, None, "en", "h", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.text, r.n_chars) for r in corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).collect())
    assert got == sorted((own(k), len(own(k)) if k < 60 else 7) for k in range(160))


def test_added_kinds(spark):
    texts = ["GB82WEST12345698765432", "GB82WEST12345698765433", "ssn 123-45-6789", "123-45-6789", "my social 000-12-3456", "AKIA" + "A" * 16, 'token = "abcdefgh1"', "a" * 40_000 + "@b" + ".c" * 4000]
    got = pii.digest(pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).orderBy("doc_id").collect()
    assert [r.spans.split(":")[0] for r in got] == ["iban", "", "ssn", "", "", "key", "secret", "email"]
    out = pii.redact(spark.createDataFrame([(1, "é a@b.cc, 1.2.3.4")], "doc_id long, text string")).first().text
    assert out == "é <email>, <ip>"


def test_borders_groups_and_context(spark):
    texts = ["iban GB82 WEST 1234 5698 7654 32 ok", "xGB82WEST12345698765432", "ssn 123-45-67890", "passport X12345678.", "X12345678", "ssn " + "a" * 37 + "123-45-6789", "ssn " + "a" * 36 + " 123-45-6789 and " + "1.2.3.4 " * 3 + "social"]
    got = pii.digest(pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).orderBy("doc_id").collect()
    assert [r.spans for r in got] == ["iban:5:32", "", "", "pass:9:18", "", "", "ip:57:64,ip:65:72,ip:73:80"]


def test_many_matches_take_linear_time(spark):
    import time

    n = 320_000
    began = time.time()
    row = pii.digest(pii.find_pii(spark.createDataFrame([(1, "to é@ bob.smith@example.com, " * n)], "doc_id long, text string"))).select("n_email", F.substring("spans", -40, 40).alias("end")).first()
    assert row.n_email == n and row.end.endswith(f"email:{29 * (n - 1) + 6}:{29 * (n - 1) + 27}") and time.time() - began < 60


def test_shards(spark, docs):
    for bucket in (1 << 30, 40_000):
        out = sharding.shuffle_into_shards(docs, bucket_bytes=bucket)
        got = out.collect()
        again = sharding.shuffle_into_shards(docs, bucket_bytes=bucket).collect()
        assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in again}
        sizes = Counter(r.shard for r in got)
        assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(16))
        assert all(sorted(r.slot for r in got if r.shard == k) == list(range(n)) for k, n in sizes.items())
        assert sorted(tuple(r)[:5] for r in got) == sorted(map(tuple, docs.collect()))
        assert [r.doc_id for r in sorted(got, key=lambda r: r.slot * 16 + r.shard)] != sorted(r.doc_id for r in got)


def test_equal_rows_spread_over_buckets(spark):
    """A million equal rows without identifiers, with a column that has no order."""
    df = spark.range(1_000_000, numPartitions=8).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    sizes = [r["count"] for r in df.select(sharding.bucket_of(F.monotonically_increasing_id(), 42, 100).alias("b")).groupBy("b").count().collect()]
    assert len(sizes) == 100 and max(sizes) < 1.1 * 10_000
    small = df.limit(2000).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    got = sharding.shuffle_into_shards(small, bucket_bytes=500).collect()
    assert sorted(r.shard + 16 * r.slot for r in got) == list(range(2000)) and got[0].m == {"a": 1}


def test_starts_add_up(spark):
    counts = spark.range(5000).select(F.col("id").cast("int").alias("bucket"), (F.col("id") % 7).alias("count"))
    total = 0
    for r in sharding.starts(counts).orderBy("b").collect():
        assert r.before == total
        total += r.b % 7


def test_written_shards(spark, docs, tmp_path):
    sharding.write_shards(sharding.shuffle_into_shards(docs), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == docs.count()


# pipeline


def plain_lines(text):
    low = str.maketrans(dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return [(line, " ".join(re.findall(r"[^\x20\x09-\x0D]+", line.translate(low)))) for line in (text or "").split("\n")]


def plain_quality(rows):
    """(key, source, text) of accepted rows, texts without frequent lines, by plain sets of distinct texts."""
    with_line = defaultdict(set)
    for _, host, text in rows:
        for _, norm in plain_lines(text):
            if norm:
                with_line[host, norm].add(text or "")
    out = []
    for key, host, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = Counter(zip(words, words[1:], words[2:]))
        repeated = {j for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in (k, k + 1, k + 2)}
        gone = {norm for _, norm in plain_lines(text) if norm and len(with_line[host, norm]) > quality_rules.LIMIT}
        left = len(words) - sum(len(norm.split(" ")) for _, norm in plain_lines(text) if norm in gone)
        if len(words) >= 50 and 100 * len(repeated) <= 50 * len(words) and left >= 50 and left >= 0.3 * len(words):
            out.append((key, host, "\n".join(line for line, norm in plain_lines(text) if not norm or norm not in gone) if gone else text))
    return out


def plain_exact(rows):
    space, best = str.maketrans("", "", " \t\n\x0b\x0c\r"), {}
    for row in rows:
        rank = (-len(row[2] or ""), row[0] is None, row[0] or 0)
        key = (row[2] or "").translate(space)
        if key not in best or rank < best[key][0]:
            best[key] = rank, row
    return [row for _, row in best.values()]


def plain_near(rows):
    prints = {k: plain_fingerprint(text) for k, (_, _, text) in enumerate(rows)}
    classes = defaultdict(list)
    for k, root in plain_components(prints).items():
        classes[root].append(k)
    return [min((rows[k] for k in own), key=lambda r: (r[0] is None, r[0] or 0, plain_fingerprint(r[2]) - (1 << 64) * (plain_fingerprint(r[2]) >> 63), (r[2] or "").encode())) for own in classes.values()]


def test_stages_by_value(spark, docs, tmp_path):
    """The first three stages, each on what its predecessor kept, with repeated and null identifiers, against plain versions."""
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    line = "a line of the host that is on many pages"
    rows += [(None, "h", " ".join(f"n{k // 2}w{j}" for j in range(70 + k % 2))) for k in range(10)] + [(k % 3, "h", line + "\n" + " ".join(f"r{k}w{j}" for j in range(70))) for k in range(30)]
    rows += [(500 + k, "h", line + "\n" + " ".join(f"s{k}w{j}" for j in range(45))) for k in range(5)] + [(None, None, None), (None, "h", "")]
    now = spark.createDataFrame([(i, t, "en", h, len(t or "")) for i, h, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for (_, stage), plain in zip(corpus_pipeline.STAGES, (plain_quality, plain_exact, plain_near)):
        stage(spark, now, SF).write.parquet(f"{tmp_path}/{plain.__name__}")
        now = spark.read.parquet(f"{tmp_path}/{plain.__name__}")
        rows = plain(rows)
        got = Counter((r.doc_id, r.source, r.text) for r in now.collect())
        assert got == Counter(rows), plain.__name__
        assert all(r.n_chars == len(r.text or "") for r in now.collect())


def test_pipeline_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids"]


def test_pipeline(spark, docs):
    got = corpus_pipeline.run(spark, SF).collect()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    single = {(i, t) for i, _, t in plain_near(plain_exact(plain_quality([(r.doc_id, r.source, r.text) for r in docs.collect()])))}
    quality = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {(r.doc_id, r.text) for r in got}
    assert kept <= single and all(r.ids == library.encode_ordinary(r.text) for r in got)
    clean = {x for x in single if quality.get(x[0]) == (1, 0)}
    assert len(clean & kept) >= 0.95 * len(clean)


def test_lm_classes_come_from_all_training_documents(spark, monkeypatch):
    texts = [f"the w{k % 7} of the w{k % 5} and of w{k % 3}" for k in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got, arrange = [], maxent_lm.arrange
    monkeypatch.setattr(maxent_lm, "arrange", lambda v, shape, before: got.append((v, before)) or arrange(v, shape, before))
    _, _, shared, _, _ = maxent_lm.prepare(docs, "doc_id", "text", 1 << 10)
    (v, before), place = got[0], {w: k for k, w in enumerate(shared.value.listed)}
    want = np.zeros_like(before)
    for k, t in enumerate(texts):
        if zlib.crc32(str(k).encode()) % 7 != 2:
            words = [place[w] for w in maxent_lm.tokens(t.encode())]
            for far in (1, 2):
                for a, b in zip(words, words[far:]):
                    if b < len(want) and a < min(len(want), maxent_lm.ANCHORS):
                        want[b, a] += 1
    assert (before == want).all() and want.sum() > 0
