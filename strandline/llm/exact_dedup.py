"""Exact deduplication by a log-structured merge index.

Texts are equal when they are the same after every space and control of ``[\\x20\\x09-\\x0D]`` is deleted. Of equal texts the
row with the most code points, then the smallest identifier, stays.

1. *Memtables.* Each task keeps a table from digest (SHA-256 of the normalised bytes) to the best row and the number of rows.
   A full memtable is flushed as a run sorted by digest, so a text copied into a third of the corpus leaves one entry a run.
2. *Compaction.* Digests are uniform, so a shard is a range of them of known size. The sorted runs' pieces of a shard are
   merged in digest order by one streaming pass that folds equal digests into the best row and the total. The result is one
   sorted run a shard, the next level. ``extend`` merges a level with the runs of more documents.
3. *Filters.* Each run gets a Bloom filter of ``FILTER_BITS`` bits for each digest with two rows or more (about 0.3 % false
   positives at any size, since the filter grows with its entries). A row asks the filter of its digest's shard. A false
   positive only costs moved bytes; there are no false negatives. The filters are broadcast while they fit in
   ``FILTER_BYTES`` together (178 million repeated digests); beyond that no filter is used, and every row counts as a hit.
4. *Verification.* Hits move with their bytes to (digest, salt). Digests with more copies than a limit have several salts, dealt
   by the row's position, not by its identifier. The list of such digests is broadcast and has at most ``HOT_LIST`` entries, as
   their copies add up to all rows at most: at 3 x 10^10 rows a digest of 29 000 copies or less stays in one stream. Sorted
   there, each row's bytes are compared with those of the first row in a stream. The first rows of the salts are compared once
   more by an aggregate with partial results, and the best of them stays.
5. Rows that differ although their digests agree are grouped anew by their bytes (with SHA-256 there are none; the tests
   shorten the digest to reach this step).

Identifiers are of any type that has an order. Nulls: a null text counts as empty, and all empty texts are equal. A null
identifier sorts after all others. Of rows that agree in text and identifier exactly one stays. Very long texts are held one at
a time. Empty tables give empty results. Other columns are neither read nor changed, and their names don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, BooleanType, DataType, IntegerType, LongType, StructField, StructType

from .common import SPACE_BYTES, materialize, shuffle_partitions, slices, text_bytes

MEMTABLE_ROWS = 50_000
SALT_ROWS = 64
HOT_LIST = 1 << 20
FILTER_BITS, FILTER_HASHES = 12, 7
FILTER_BYTES = 256 << 20
MOST_SALTS = 1 << 20


def normalise(raw: bytes) -> bytes:
    return raw.translate(None, SPACE_BYTES)


def code_points(raw: bytes) -> int:
    """Code points of UTF-8 bytes: those that don't continue a character."""
    return len(raw) if raw.isascii() else len(raw.decode("utf-8", "replace"))


def _digest(body: bytes, size: int) -> bytes:
    return hashlib.sha256(body).digest()[:size]


def _fields(*named: tuple[str, DataType]) -> StructType:
    return StructType([StructField(n, t) for n, t in named])


def _run(kind: DataType) -> StructType:
    return _fields(("shard", IntegerType()), ("digest", BinaryType()), ("best_len", LongType()), ("best_id", kind), ("n", LongType()))


def _rank(points: int, doc) -> tuple:
    """Of equal texts the least of these stays."""
    return -points, doc is None, 0 if doc is None else doc


def _order(points: str = "n_points", doc: str = "doc_id") -> list[Column]:
    """The same for Spark: ascending."""
    return [-F.col(points), F.col(doc).isNull(), F.col(doc)]


def _words(digests: list[bytes]) -> np.ndarray:
    """Four numbers of 64 bits for each digest; short ones are repeated."""
    return np.frombuffer(b"".join([d if len(d) == 32 else (d * 32)[:32] for d in digests]), ">u8").reshape(-1, 4).astype(np.uint64)


def shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the digest's first 32 bits, in order."""
    return ((words[:, 0] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _flush(table: dict[bytes, list], kind: pa.DataType, shards: int) -> pa.RecordBatch:
    keys = sorted(table)
    length, doc, n = zip(*(table[k] for k in keys))
    shard = shard_of(_words(keys), shards).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(keys, pa.binary()), pa.array(length, pa.int64()), pa.array(doc, kind), pa.array(n, pa.int64())], ["shard", "digest", "best_len", "best_id", "n"])


def memtables(size: int, kind: pa.DataType, shards: int, limit: int = MEMTABLE_ROWS):
    """Sorted digest runs of a partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, list] = {}
        for batch in slices(batches):
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key, points = _digest(normalise(raw), size), code_points(raw)
                held = table.get(key)
                if held is None:
                    table[key] = [points, doc, 1]
                else:
                    held[2] += 1
                    if _rank(points, doc) < _rank(held[0], held[1]):
                        held[0], held[1] = points, doc
                if len(table) >= limit:
                    yield _flush(table, kind, shards)
                    table = {}
        if table:
            yield _flush(table, kind, shards)

    return work


def merged(kind: pa.DataType, shards: int):
    """One sorted run from entries in digest order: equal digests, which stand together, are folded."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[bytes, list] = {}
        last, held = None, None
        for batch in batches:
            for key, points, doc, n in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4))):
                if key == last:
                    held[2] += n
                    if _rank(points, doc) < _rank(held[0], held[1]):
                        held[0], held[1] = points, doc
                    continue
                if len(out) >= 10_000:  # the entry that is still open is the last one and isn't among them
                    yield _flush(out, kind, shards)
                    out = {}
                if last is not None:
                    out[last] = held
                last, held = key, [points, doc, n]
        if last is not None:
            out[last] = held
            yield _flush(out, kind, shards)

    return work


def flush_runs(rows: DataFrame, digest_bytes: int, shards: int, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """``rows``: doc_id, body. The first level: many sorted runs."""
    kind = rows.schema["doc_id"].dataType
    return rows.mapInArrow(memtables(digest_bytes, to_arrow_type(kind), shards, memtable_rows), _run(kind))


def compact(runs: DataFrame, shards: int) -> DataFrame:
    """The next level: one sorted run a shard."""
    kind = runs.schema["best_id"].dataType
    dealt = runs.repartitionById(shards, F.col("shard")).sortWithinPartitions("digest")
    return dealt.mapInArrow(merged(to_arrow_type(kind), shards), _run(kind))


def extend(level: DataFrame, docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", digest_bytes: int = 32) -> DataFrame:
    """``level`` merged with the runs of more documents."""
    return compact(level.unionByName(flush_runs(_keyed(docs, doc_id, text), digest_bytes, shards)), shards)


def positions(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Bits of each digest in a filter of so many bits, by double hashing; one column for each hash."""
    step = words[:, 2] | np.uint64(1)
    return (words[:, 1, None] + np.arange(FILTER_HASHES, dtype=np.uint64) * step[:, None]) % bits[:, None]


def run_filter(digests: list[bytes]) -> np.ndarray:
    """The filter of a run, as bytes."""
    bits = -(-max(64, FILTER_BITS * len(digests)) // 8) * 8
    words = np.zeros(bits // 8, np.uint8)
    if digests:
        at = positions(_words(digests), np.full(len(digests), bits, np.uint64)).ravel()
        np.bitwise_or.at(words, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7)).astype(np.int64)).astype(np.uint8))
    return words


def _run_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list[bytes]] = {}
    for batch in batches:
        for shard, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found.setdefault(shard, []).append(digest)
    for shard, digests in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([run_filter(digests).tobytes()], pa.binary())], ["shard", "filter"])


class Filters:
    """The filters of all runs in one array; a run without repeated digests has an empty one."""

    def __init__(self, shards: int, parts: dict[int, np.ndarray]):
        self.shards = shards
        sizes = np.array([len(parts[k]) if k in parts else 0 for k in range(shards)], np.int64)
        self.first, self.bits = np.cumsum(sizes) - sizes, (sizes * 8).astype(np.uint64)
        self.words = np.concatenate([parts[k] for k in sorted(parts)]) if parts else np.zeros(0, np.uint8)

    def may_have(self, digests: list[bytes]) -> np.ndarray:
        words = _words(digests)
        shard = shard_of(words, self.shards)
        out = np.zeros(len(digests), bool)
        rows = np.flatnonzero(self.bits[shard] > 0)
        if len(rows):
            at = positions(words[rows], self.bits[shard[rows]])
            byte = self.words[(at >> np.uint64(3)).astype(np.int64) + self.first[shard[rows]][:, None]]
            out[rows] = ((byte >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1)
        return out


class Hot:
    """Digests with many copies, as sorted arrays: the row that stays and the number of copies."""

    def __init__(self, rows: list[tuple[bytes, object, int]]):
        rows = sorted(rows, key=lambda r: _words([r[0]])[0].tolist())
        self.digests, self.keep = [r[0] for r in rows], [r[1] for r in rows]
        self.n = np.array([r[2] for r in rows], np.int64)
        self.heads = _words(self.digests)[:, 0] if rows else np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.digests)

    def places(self, digests: list[bytes]) -> list[int]:
        """Place of each digest in the list, or -1."""
        if not self.digests or not digests:
            return [-1] * len(digests)
        heads = _words(digests)[:, 0]
        low, high = np.searchsorted(self.heads, heads), np.searchsorted(self.heads, heads, "right")
        out = [-1] * len(digests)
        for k in np.flatnonzero(low < high):
            out[k] = next((j for j in range(low[k], high[k]) if self.digests[j] == digests[k]), -1)
        return out


@dataclass
class Index:
    """What is known before verification, broadcast: the filters (None: every row is a hit) and the hot digests."""

    shared: Broadcast
    n_hot: int
    level: DataFrame


def build_index(rows: DataFrame, digest_bytes: int, salt_rows: int, memtable_rows: int = MEMTABLE_ROWS, filter_bytes: int = FILTER_BYTES, hot_list: int = HOT_LIST) -> Index:
    """``rows``: doc_id, body."""
    spark, shards = rows.sparkSession, shuffle_partitions(rows.sparkSession)
    level = materialize(compact(flush_runs(rows, digest_bytes, shards, memtable_rows), shards).where("n > 1"))
    stats = level.agg(F.count("*").alias("k"), F.sum("n").alias("rows")).first()
    limit = max(2 * salt_rows, (stats["rows"] or 0) // hot_list)
    hot = Hot([(bytes(r["digest"]), r["best_id"], r["n"]) for r in level.where(F.col("n") > limit).select("digest", "best_id", "n").collect()])
    filters = None
    if stats["k"] * FILTER_BITS // 8 <= filter_bytes:
        got = level.select("shard", "digest").mapInArrow(_run_filters, "shard int, filter binary").toArrow()
        filters = Filters(shards, {s: np.frombuffer(f, np.uint8) for s, f in zip(got["shard"].to_pylist(), got["filter"].to_pylist())})
    return Index(spark.sparkContext.broadcast((filters, hot, salt_rows)), len(hot), level)


def probe(shared: Broadcast, digest_bytes: int):
    """Replaces the last column (the text's bytes) by code points, digest, position, salt and normalised bytes; the last two
    only for hits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, hot, salt_rows = shared.value
        at = TaskContext.get().partitionId() << 36
        for batch in slices(batches):
            raws = batch.column(batch.num_columns - 1).to_pylist()
            bodies = [normalise(raw) for raw in raws]
            digests = [_digest(body, digest_bytes) for body in bodies]
            hit = filters.may_have(digests) if filters and digests else np.full(len(digests), filters is None)
            place = np.array(hot.places(digests), np.int64)
            where = np.arange(at, at + len(raws))
            at += len(raws)
            salts = np.zeros(len(raws), np.int64)
            if len(hot):
                many = np.clip(-(-hot.n // salt_rows), 1, MOST_SALTS)
                salts = np.where(place >= 0, (where ^ where >> 30) % many[place], 0)
            new = [
                pa.array([code_points(raw) for raw in raws], pa.int64()), pa.array(digests, pa.binary()), pa.array(where),
                pa.array(salts.astype(np.int32), mask=~hit), pa.array([body if h else None for body, h in zip(bodies, hit)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*batch.schema.names[:-1], *(n for n, _ in _PROBED)])

    return work


_PROBED = (("n_points", LongType()), ("digest", BinaryType()), ("pos", LongType()), ("salt", IntegerType()), ("body", BinaryType()))


def _found(kind: DataType) -> StructType:
    return _fields(("doc_id", kind), ("digest", BinaryType()), ("n_points", LongType()), ("pos", LongType()), ("keep_id", kind), ("group_size", LongType()), ("kept", BooleanType()), ("body", BinaryType()), ("role", IntegerType()))


def verify(shared: Broadcast, kind: DataType):
    """Rows sorted by (digest, salt, rank). Role 0: settled, of a hot digest the first row of a salt has a null for kept; 1: the
    first row's bytes of a hot salt; 2: bytes differ."""
    schema = _found(kind)
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], schema.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, hot, _ = shared.value
        key, first, place, members, out = None, b"", -1, [], []

        def close() -> None:
            if place < 0:  # the best of the digest is the first row
                out.extend((doc, key[0], points, pos, members[0][0], len(members), k == 0, None, 0) for k, (doc, points, pos) in enumerate(members))

        for batch in slices(batches):
            for doc, points, digest, pos, salt, body in zip(*(c.to_pylist() for c in batch.columns)):
                if (digest, salt) != key:
                    if key:
                        close()
                    key, first, place, members = (digest, salt), body, hot.places([digest])[0], []
                    if place >= 0:
                        out.append((doc, digest, points, pos, hot.keep[place], int(hot.n[place]), None, None, 0))
                        out.append((None, digest, None, None, None, None, None, body, 1))
                        continue
                if body != first:
                    out.append((doc, digest, points, pos, None, None, None, None, 2))
                elif place >= 0:
                    out.append((doc, digest, points, pos, hot.keep[place], int(hot.n[place]), False, None, 0))
                else:
                    members.append((doc, points, pos))
                if len(out) >= 5_000:
                    yield batch_of(out)
                    out.clear()
        if key:
            close()
        for k in range(0, len(out), 5_000):
            yield batch_of(out[k:k + 5_000])

    return work


def first_rows(shared: Broadcast):
    """As ``verify``, for whole rows: emits the row to keep of each digest (role 0), the first rows of hot salts (1), and rows
    whose bytes differ (2)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, hot, _ = shared.value
        key, first = None, b""
        for batch in slices(batches):
            digests, salts, bodies = (batch.column(batch.num_columns - k).to_pylist() for k in (4, 2, 1))
            take, roles = [], []
            for k, (digest, salt, body) in enumerate(zip(digests, salts, bodies)):
                if (digest, salt) != key:
                    key, first = (digest, salt), body
                    take.append(k)
                    roles.append(int(hot.places([digest])[0] >= 0))
                elif body != first:
                    take.append(k)
                    roles.append(2)
            if take:
                got = batch.take(pa.array(take))
                yield pa.RecordBatch.from_arrays([*got.columns, pa.array(roles, pa.int32())], [*got.schema.names, "role"])

    return work


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), text_bytes(text).alias("body"))


def _hits(probed: DataFrame, doc: str) -> DataFrame:
    return probed.where("salt is not null").repartition("digest", "salt").sortWithinPartitions("digest", "salt", *_order(doc=doc), "pos")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest_bytes: int = 32, salt_rows: int = SALT_ROWS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (hex of the normalised text's digest)."""
    rows = _keyed(docs, doc_id, text)
    kind = rows.schema["doc_id"].dataType
    index = build_index(rows, digest_bytes, salt_rows, filter_bytes=filter_bytes)
    probed = rows.mapInArrow(probe(index.shared, digest_bytes), StructType([rows.schema["doc_id"], *_fields(*_PROBED)]))
    checked = materialize(_hits(probed, "doc_id").mapInArrow(verify(index.shared, kind), _found(kind)))
    settled = checked.where("role = 0").select("doc_id", "digest", "n_points", "pos", "keep_id", "group_size", "kept")
    if index.n_hot:
        best = settled.where("kept is null").groupBy("digest").agg(F.min(F.struct(*_order(), "pos")).alias("b")).select(F.col("digest").alias("d"), F.col("b.pos").alias("p"))
        met = settled.join(best, (F.col("digest") == F.col("d")) & (F.col("pos") == F.col("p")), "left")
        settled = met.withColumn("kept", F.coalesce("kept", F.col("p").isNotNull())).drop("d", "p")
    out = ["doc_id", "keep_id", "group_size", "kept", "digest"]
    settled = settled.select(*out)
    if (bad := _mismatches(checked)) is not None:
        again = rows.mapInArrow(probe(index.shared, digest_bytes), StructType([rows.schema["doc_id"], *_fields(*_PROBED)])).join(bad, "digest", "left_semi")
        settled = settled.join(bad, "digest", "left_anti").select(*out).unionByName(_by_bytes(again))
    alone = probed.where("salt is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return alone.unionByName(settled).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _mismatches(checked: DataFrame) -> DataFrame | None:
    """Digests under which bytes differed, within a salt or between the first rows of a hot digest's salts; None if there are none."""
    firsts = checked.where("role = 1").groupBy("digest").agg(F.min("body").alias("a"), F.max("body").alias("b")).where("a <> b")
    bad = materialize(checked.where("role = 2").select("digest").union(firsts.select("digest")).distinct())
    return None if bad.isEmpty() else bad


def _by_bytes(rows: DataFrame) -> DataFrame:
    """Exact groups of rows whose digests collide."""
    best = rows.groupBy("digest", "body").agg(F.min(F.struct(*_order(), "pos")).alias("best"), F.min_by("doc_id", F.struct(*_order(), "pos")).alias("keep_id"), F.count("*").alias("group_size"))
    met = rows.select("digest", "body", "doc_id", "pos").join(best, ["digest", "body"])
    return met.select("doc_id", "keep_id", "group_size", (F.col("pos") == F.col("best.pos")).alias("kept"), "digest")


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest_bytes: int = 32, salt_rows: int = SALT_ROWS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns unchanged. Rows that miss the filter aren't moved."""
    index = build_index(_keyed(docs, doc_id, text), digest_bytes, salt_rows, filter_bytes=filter_bytes)
    own = [f"c{k}" for k in range(len(docs.columns))]  # by position: the caller's names may clash with ours
    key = own[docs.columns.index(doc_id)]
    rows = docs.toDF(*own).select(*own, text_bytes(own[docs.columns.index(text)]).alias("raw"))
    schema = StructType([*rows.schema.fields[:-1], *_fields(*_PROBED)])
    probed = rows.mapInArrow(probe(index.shared, digest_bytes), schema)
    hits = _hits(probed, key)
    checked = materialize(hits.mapInArrow(first_rows(index.shared), StructType([*schema.fields, StructField("role", IntegerType())])))
    kept = checked.where("role = 0")
    if index.n_hot:
        best = checked.where("role = 1").groupBy("digest").agg(F.min_by(F.struct(*own), F.struct(*_order(doc=key), "pos")).alias("b"))
        kept = kept.select("digest", *own).union(best.select("digest", "b.*"))
    if (bad := _mismatches(checked)) is not None:
        order = Window.partitionBy("digest", "body").orderBy(*_order(doc=key), "pos")
        again = hits.join(bad, "digest", "left_semi").withColumn("nth", F.row_number().over(order)).where("nth = 1")
        kept = kept.join(bad, "digest", "left_anti").select(*own).union(again.select(*own))
    return probed.where("salt is null").select(*own).union(kept.select(*own)).toDF(*docs.columns)
