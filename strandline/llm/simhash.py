"""Near-duplicates by SimHash fingerprints and vantage-point trees.

A text, A-Z lower-cased, is cut into words and 3-word shingles (repeats included; fewer words: the whole sequence). A bit of
the 64-bit fingerprint is set if more than half of the shingles' XXH64 hashes (seed 42) have it. A text without words has
fingerprint zero and is linked like any other. Fingerprints that differ in at most two bits are linked, and a class is a
connected component of links.

*The tree.* Distinct fingerprints are partitioned by Hamming distance: a node has a vantage point v and a radius m, and takes
x inside if d(x, v) <= m, else outside. Two linked points x, y have a midpoint z with d(x, z) <= 1 and d(z, y) <= 1, and z
falls into one leaf. By the triangle inequality, z inside implies d(x, v) <= m + 1, and z outside implies d(x, v) > m - 1. So
each point is sent to every branch that its ball of radius 1 overlaps, and to no other, and each linked pair meets in at
least one leaf: the search is exact. With half the radius a level copies about a fifth of the points; with the full radius
it would copy two fifths.

*Leaves.* The upper tree is built from a sample of at least ``LEAF_SAMPLE`` points a leaf (routing is exact for any tree; the
sample only shapes its balance). Then the points that reach each leaf are counted, and a leaf with more than twice the points of
a shard is split again by a tree over a sample of its own points, until none is left that a vantage point can split. Each leaf
is a shard, in which a deeper tree of the same kind is searched in numpy down to small blocks that are compared directly. A
shard emits a spanning forest of its links, never all pairs. Where points lie so close together that no vantage point separates
them, they meet on their common neighbours at distance 1 instead (65 keys a point, at most 65 points a key), which is exact as
well and has no large groups.

Fingerprints are distinct before the search, so copies of a text cost one point. Null text: no words. Identifiers are of any
type that has an order; a null one counts as larger than all others. Very long texts are hashed in parts. Repeated rows get the
same result each. Empty tables give empty results; other columns are not read, and keep their values and names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import free_name, materialize, shuffle_partitions, slices, text_bytes
from .components import components

SEED = 42
SHINGLE = 3
MAX_BITS = 2
HALF = 1
SAMPLE, LEAF_SAMPLE = 65_536, 16
SHARD_POINTS = (4_096, 1_000_000)
SPLITS = 8
BLOCK = 384
DENSE = 0.93
_PART = 1 << 15


def shingle_hashes(raw: bytes) -> list[int]:
    words = raw.lower().split()
    if len(words) <= SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - SHINGLE + 1].tolist()
    return [h(line[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1:] - 1).tolist())]


def fingerprint(raw: bytes) -> int:
    """The fingerprint as a signed 64-bit integer."""
    hashes = shingle_hashes(raw)
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _PART):
        part = np.array(hashes[k:k + _PART], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        prints = [fingerprint(raw) for raw in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def _each_fingerprint(body: pd.Series) -> pd.Series:
    return body.map(fingerprint)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (long)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_bytes(text).alias("body"))
    return rows.mapInArrow(_fingerprints, StructType([rows.schema["doc_id"], StructField("fp", LongType())]))


@dataclass
class Tree:
    """Vantage-point tree; children below zero are leaves: ~leaf."""

    vantage: list[int] = field(default_factory=list)
    radius: list[int] = field(default_factory=list)
    inside: list[int] = field(default_factory=list)
    outside: list[int] = field(default_factory=list)
    dense: list[bool] = field(default_factory=list)
    root: int = ~0

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of the points that go there), for every branch that a point's ball overlaps."""
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                if len(rows):
                    yield ~node, rows
                continue
            near, far = _sides(points[rows], self.vantage[node], self.radius[node])
            todo += [(self.inside[node], rows[near]), (self.outside[node], rows[far])]


    def graft(self, leaf: int, own: Tree) -> None:
        """Puts another tree in place of a leaf; its leaves get new numbers, but for one that keeps the old number."""
        nodes, leaves = len(self.vantage), len(self.dense)
        number = lambda c: nodes + c if c >= 0 else ~leaf if ~c == 0 else ~(leaves + ~c - 1)
        self.vantage += own.vantage
        self.radius += own.radius
        self.inside += map(number, own.inside)
        self.outside += map(number, own.outside)
        self.dense[leaf] = own.dense[0]
        self.dense += own.dense[1:]
        if own.root < 0:
            return
        if self.root == ~leaf:
            self.root = nodes
        for side in (self.inside, self.outside):
            for k in range(nodes):
                if side[k] == ~leaf:
                    side[k] = nodes


def _sides(points: np.ndarray, vantage: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.bitwise_count(points ^ np.uint64(vantage)).astype(np.int64)
    return d - HALF <= radius, d + HALF > radius


def _best_split(points: np.ndarray, tries: int = 6) -> tuple[int, int, int]:
    """Vantage point, radius and size of the larger side, of a few candidates spread over the points."""
    best = (0, 0, len(points))
    probe = points if len(points) <= 4096 else points[:: len(points) // 4096]
    for k in range(tries):
        v = points[(len(points) - 1) * k // max(1, tries - 1)]
        d = np.bincount(np.bitwise_count(probe ^ v), minlength=67)
        below = np.cumsum(d)
        # inside: d <= m + 1; outside: d >= m
        size = np.maximum(below[1:66], len(probe) - np.concatenate([[0], below[:64]]))
        m = int(size.argmin())
        if size[m] * len(points) / len(probe) < best[2]:
            best = (int(v), m, int(size[m] * len(points) / len(probe)))
    return best


def build(points: np.ndarray, leaf_points: int) -> Tree:
    tree = Tree()

    def grow(own: np.ndarray) -> int:
        if len(own) > leaf_points:
            v, m, largest = _best_split(own)
            if largest <= DENSE * len(own):
                near, far = _sides(own, v, m)
                if max(near.sum(), far.sum()) < len(own):
                    node = len(tree.vantage)
                    tree.vantage.append(v)
                    tree.radius.append(m)
                    tree.inside.append(0)
                    tree.outside.append(0)
                    tree.inside[node] = grow(own[near])
                    tree.outside[node] = grow(own[far])
                    return node
        tree.dense.append(len(own) > leaf_points)
        return ~(len(tree.dense) - 1)

    tree.root = grow(points)
    return tree


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked rows the same, least label."""
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        low = np.minimum(x, y)
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        while (up := labels[labels]).tobytes() != labels.tobytes():
            labels[:] = up


def _by_neighbours(points: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> None:
    keys = np.concatenate([points] + [points ^ np.uint64(1 << k) for k in range(64)])
    order = np.argsort(keys, kind="stable")
    owner, same = np.tile(rows, 65)[order], np.flatnonzero(keys[order][1:] == keys[order][:-1])
    _join(labels, owner[same], owner[same + 1])


def shard_links(points: np.ndarray) -> np.ndarray:
    """Labels (row numbers) of the components among distinct points, by a tree within the shard."""
    labels = np.arange(len(points))
    for leaf, rows in (tree := build(points, BLOCK)).route(points):
        own = points[rows]
        if tree.dense[leaf] and len(own) > 8 * BLOCK:
            _by_neighbours(own, rows, labels)
            continue
        for k in range(0, len(own), 256):
            near = np.bitwise_count(own[k:k + 256, None] ^ own[None, k:]) <= MAX_BITS
            a, b = np.nonzero(near)
            apart = a != b
            if apart.any():
                _join(labels, rows[k + a[apart]], rows[k + b[apart]])
    return labels


def _route(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = shared.value
        for batch in batches:
            points = np.asarray(batch.column(0)).view(np.uint64)
            for leaf, rows in tree.route(points):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), leaf, np.int32)), pa.array(points[rows].view(np.int64))], ["leaf", "fp"])

    return work


def _solve(table: pa.Table) -> pa.Table:
    points = np.unique(np.asarray(table["fp"]).view(np.uint64))
    labels = shard_links(points)
    rows = np.flatnonzero(labels != np.arange(len(points)))
    return pa.table({"u": points[rows].view(np.int64), "v": points[labels[rows]].view(np.int64)})


def _sampled(prints: DataFrame, n: int, wanted: int) -> DataFrame:
    return prints.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, n // max(1, wanted)))) == 0)


def _routed(prints: DataFrame, tree: Tree) -> DataFrame:
    return prints.select("fp").mapInArrow(_route(prints.sparkSession.sparkContext.broadcast(tree)), "leaf int, fp long")


def upper_tree(prints: DataFrame, n: int, shard_points: int, sample: int = SAMPLE) -> Tree:
    """A tree whose leaves get at most twice ``shard_points`` points, but for those that nothing splits, which are dense."""
    taken = np.unique(np.asarray(_sampled(prints, n, max(sample, LEAF_SAMPLE * (n // shard_points))).select("fp").toArrow()["fp"]).view(np.uint64))
    tree = build(taken, max(LEAF_SAMPLE, shard_points * len(taken) // max(1, n)))
    for _ in range(SPLITS):
        sizes = {r["leaf"]: r["count"] for r in _routed(prints, tree).groupBy("leaf").count().where(F.col("count") > 2 * shard_points).collect()}
        large = {leaf: size for leaf, size in sizes.items() if not tree.dense[leaf]}
        if not large:
            break
        every = F.create_map(*(F.lit(int(x)) for leaf, size in large.items() for x in (leaf, max(1, size // max(sample, LEAF_SAMPLE * (size // shard_points))))))
        got = _routed(prints, tree).where(F.col("leaf").isin(list(large))).where(F.pmod(F.xxhash64("fp"), F.element_at(every, F.col("leaf"))) == 0).toArrow()
        leaf_of, points = np.asarray(got["leaf"]), np.asarray(got["fp"]).view(np.uint64)
        for leaf, size in large.items():
            own = np.unique(points[leaf_of == leaf])
            grown = build(own, max(LEAF_SAMPLE, shard_points * len(own) // size))
            if grown.root < 0:
                grown.dense[0] = True
            tree.graft(leaf, grown)
    return tree


def links(prints: DataFrame, n: int, shard_points: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """``prints``: fp, distinct, ``n`` of them. Returns u, v: links whose components are those of all links.

    A point is sent to about (n / shard_points)^0.36 shards, so shards are as large as leaves two for each partition, up to a
    million points of eight bytes.
    """
    if shard_points is None:
        shard_points = min(SHARD_POINTS[1], max(SHARD_POINTS[0], n // (2 * shuffle_partitions(prints.sparkSession))))
    tree = upper_tree(prints, n, shard_points, sample)
    routed = _routed(prints, tree)
    close = [k for k, x in enumerate(tree.dense) if x]
    found = (routed.where(~F.col("leaf").isin(close)) if close else routed).groupBy("leaf").applyInArrow(_solve, "u long, v long")
    if close:
        keys = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(-(1 << 63) if k == 63 else 1 << k).cast("long")) for k in range(64)]
        near = routed.where(F.col("leaf").isin(close)).select("fp").distinct().select("fp", F.explode(F.array(*keys)).alias("key"))
        meet = near.groupBy("key").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
        found = found.union(meet.select(F.explode("all").alias("u"), F.array_min("all").alias("v")).where("u <> v"))
    return found


def classes(rows: DataFrame) -> DataFrame:
    """``rows``: doc_id, fp, materialized. Adds root, a fingerprint that names the class, and component_id, its smallest doc_id."""
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    stars = components(links(prints, prints.count()))
    rooted = prints.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, one row per row of ``docs``."""
    found = classes(materialize(fingerprints(docs, doc_id, text)))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the row of the smallest identifier of each class, all columns unchanged.

    Rows to drop are found by identifier. Identifiers that occur more than once (null counts as one) are told apart by their
    fingerprint: of each class whose smallest identifier that is, the rows with the class's smallest fingerprint under it are
    meant, and of rows that agree in both the one with the smallest text stays.
    """
    found = materialize(classes(materialize(fingerprints(docs, doc_id, text))))
    key, twin = free_name(docs.columns, "key"), free_name(docs.columns, "fp")
    same = F.col(doc_id).eqNullSafe(F.col(key))
    repeated = materialize(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(key)))
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(key)).union(repeated).distinct()
    kept = docs.join(gone, same, "left_anti")
    if repeated.isEmpty():
        return kept
    again = docs.join(repeated, same, "left_semi")
    own = [f"c{k}" for k in range(len(docs.columns))]
    ident, words = F.col(own[docs.columns.index(doc_id)]), text_bytes(own[docs.columns.index(text)])
    flat = again.toDF(*own).select(*own, F.pandas_udf(_each_fingerprint, LongType())(words).alias("own_fp"))
    meant = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("fp").alias(twin), F.first("component_id").alias(key))
    rows = flat.join(meant, ident.eqNullSafe(F.col(key)) & (F.col("own_fp") == F.col(twin)), "left_semi")
    first = rows.groupBy(ident.alias("i"), "own_fp").agg(F.min_by(F.struct(*own), words).alias("r")).select("r.*")
    return kept.union(first.toDF(*docs.columns))
