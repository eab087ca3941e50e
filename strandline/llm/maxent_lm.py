"""Language-model scoring by a hashed maximum-entropy model with class-factored softmax.

Tokens: words of the text, A-Z lower-cased, and one end. Training tokens are counted over the whole corpus (c of a token, N in
all, V distinct). A token is *listed* if its count is at least the least power of two that at most ``LISTED`` tokens reach; their
counts are broadcast, a few MB at most. The counts of the others meet their occurrences in a join on the token, whose groups
are below that power of two, and so below 2 N / LISTED.

*Classes.* Every token has a group and a block; the ``Shape.modelled`` most frequent ones also a place in their block.

    P(w | context) = P(group | context) * P(block | group, context) * P(w | block, context)

Groups hold words that follow the same frequent words: the counts of the ``ANCHORS`` most frequent words before each modelled
word are gathered over all training documents, and the words are halved again and again at the median of their first principal
component. Within a group, blocks are runs of words by frequency. All other tokens, unseen ones included, are in the last block
of the group that most modelled words with their last two bytes have; there P(w) is (c + 1) over the block's mass, in which
unseen tokens together count one. So the probabilities of the known tokens and of "unseen in this group" sum to one.

*Features.* Each factor is a softmax over log frequencies plus weights picked by hashed features: the token before (bigram) and
the one before that (skip) for groups; the bigram together with the node above for blocks and words. Words outside the modelled
ones are contexts by their last two bytes. Numbers of groups, blocks and rows follow the vocabulary (``Shape``) up to a size that
is broadcast: 400 000 weights, 1.6 MB.

*Training* is gradient ascent on the log-likelihood in ``STEPS`` updates. Documents fall into as many batches by the hash of
their text, so each is read in one update. A task sums the gradient of its documents and emits the rows it used; the sums of
the tasks meet part by part in two levels of streaming sums, so neither a group nor the driver holds one copy a task.
Contributions are rounded to multiples of 2^-16 and added as whole numbers, so the weights don't depend on how rows are split. The driver scales the gradient g of a weight by its expected count e and takes log(1 - g / (e + SMOOTH)) / features,
the step that iterative scaling bounds. What is gathered grows with the corpus: counts with its words, sums with its tasks.

*Scores* are base-10 logarithms. Null texts are empty (one token, the end). Repeated rows count each. A null identifier counts
as the empty text for the split. Without training documents the base is log10(1) for each token. Very long texts are scored in
blocks of ``BLOCK`` tokens. Empty tables give empty results. Other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_crc, materialize, text_bytes

LISTED = 1 << 17
WIDTH = 32
SUFFIXES = 1024
ANCHORS = 32
STEPS = 5
SMOOTH = 8.0
BLOCK = 16384
END = b""
FLUSH = 400_000
PART_ROWS = 512
FAN = 64
UNIT = 1 << 16


def tokens(raw: bytes) -> list[bytes]:
    words = raw.lower().split()
    words.append(END)
    return words


def suffixes(words: list[bytes]) -> np.ndarray:
    """A number below SUFFIXES from the last two bytes of each word; a blank stands before a word of one byte."""
    if not words:
        return np.zeros(0, np.int64)
    data = np.frombuffer(b"  " + b"  ".join(words), np.uint8)
    last = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2) - 1
    return (data[last - 1].astype(np.int64) << 8 | data[last]) * 40503 % 65521 % SUFFIXES


# Counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens and counts of a partition, flushed when the table is full."""
    seen: Counter[bytes] = Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        keys, values = list(seen.keys()), list(seen.values())
        for k in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k:k + 50_000], pa.binary()), pa.array(values[k:k + 50_000], pa.int64())], ["token", "n"])
        seen.clear()

    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            for raw in batch.column(0).slice(k, 512).to_pylist():
                seen.update(tokens(raw))
            if len(seen) >= FLUSH:
                yield from flush()
    yield from flush()


def count_tokens(rows: DataFrame) -> DataFrame:
    """``rows``: body (bytes). token, n."""
    return rows.select("body").mapInArrow(_count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mass = np.zeros(SUFFIXES)
    for batch in batches:
        if batch.num_rows:
            mass += np.bincount(suffixes(batch.column(0).to_pylist()), np.asarray(batch.column(1)) + 1.0, SUFFIXES)
    at = np.flatnonzero(mass)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(mass[at].astype(np.int64))], ["suffix", "mass"])


@dataclass
class Vocabulary:
    """Listed tokens, most frequent first, with their counts; the totals; and the mass of unlisted tokens by suffix."""

    listed: list[bytes]
    counts: np.ndarray
    n_all: int
    n_distinct: int
    unlisted: np.ndarray

    @property
    def mass(self) -> float:
        return float(self.n_all + self.n_distinct + 1)


def vocabulary(counts: DataFrame, listed: int = LISTED) -> tuple[Vocabulary, int]:
    """The vocabulary and the least count of a listed token."""
    reach = [F.count_if(F.col("n") >= 1 << k).alias(f"k{k}") for k in range(1, 62)]
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), *reach).first()
    n_all, n_distinct = total["n"] or 0, total["v"]
    least = next((1 << k for k in range(62) if (total[f"k{k}"] if k else n_distinct) <= listed), 1 << 62)
    got = counts.where(F.col("n") >= least).toArrow()
    words, n = got["token"].to_pylist(), np.asarray(got["n"]).astype(np.int64)
    order = sorted(range(len(words)), key=lambda k: (-n[k], words[k]))
    rest = counts.where(F.col("n") < least).mapInArrow(_tail, "suffix int, mass long").groupBy("suffix").agg(F.sum("mass").alias("mass")).toArrow()
    unlisted = np.zeros(SUFFIXES)
    unlisted[np.asarray(rest["suffix"])] = np.asarray(rest["mass"])
    return Vocabulary([words[k] for k in order], n[order], n_all, n_distinct, unlisted), least


# The model


@dataclass
class Shape:
    """Sizes that follow the number of listed tokens: groups of blocks of words, and rows of the hashed tables."""

    groups: int
    blocks: int
    rows: int

    @property
    def modelled(self) -> int:
        return self.groups * self.blocks * WIDTH

    @staticmethod
    def of(listed: int) -> Shape:
        """A quarter of the listed words are modelled, up to 16 groups of 32 blocks of 32 words; eight rows a block."""
        size = 1
        while size < 16 and size * size * 2 * WIDTH * 4 < listed:
            size *= 2
        return Shape(size, 2 * size, min(4096, max(64, 16 * size * size)))


@dataclass
class Model:
    """Places of tokens in the tree, log frequencies, and a table of weights for each factor: rows of hashed features, one
    column a branch."""

    shape: Shape
    group: np.ndarray  # of listed tokens, then of suffixes
    block: np.ndarray
    place: np.ndarray
    context: np.ndarray  # what a listed token, a suffix, or the start of a text is to the tokens after it
    biases: list[np.ndarray]  # by group; by block of a group; by word of a block (group * blocks + block)
    tail_mass: np.ndarray  # by group
    weights: list[np.ndarray]


#: Features of groups (bigram and skip), blocks (bigram, with the group) and words (bigram, with the block).
FEATURES = (2, 1, 1)


def _hash(x: np.ndarray, salt: int) -> np.ndarray:
    y = (x.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (y >> np.uint64(33)).astype(np.int64)


def halved(features: np.ndarray, groups: int) -> np.ndarray:
    """A group for each row: sets are halved at the median of their first principal component; ties by row."""
    out = np.zeros(len(features), np.int64)

    def cut(rows: np.ndarray, first: int, many: int) -> None:
        if many == 1 or len(rows) < 2:
            out[rows] = first
            return
        x = features[rows] - features[rows].mean(0)
        value, vector = np.linalg.eigh(x.T @ x)
        axis = vector[:, -1] * (1 if vector[np.abs(vector[:, -1]).argmax(), -1] > 0 else -1)
        order = rows[np.argsort(np.round(x @ axis, 9), kind="stable")]
        cut(np.sort(order[: len(order) // 2]), first, many // 2)
        cut(np.sort(order[len(order) // 2:]), first + many // 2, many - many // 2)

    cut(np.arange(len(features)), 0, groups)
    return out


def arrange(v: Vocabulary, shape: Shape, before: np.ndarray) -> Model:
    """The tree for a vocabulary. ``before``: for each modelled token, how often each anchor stands before it."""
    n, k = len(v.listed), min(shape.modelled, len(v.listed))
    share = np.sqrt(before / np.maximum(1, before.sum(1, keepdims=True)))
    own = halved(share, shape.groups)
    ends = suffixes(v.listed) if n else np.zeros(0, np.int64)
    votes = np.zeros((SUFFIXES, shape.groups))
    np.add.at(votes, (ends[:k], own), 1)
    by_suffix = votes.argmax(1)
    group = np.concatenate([own, by_suffix[ends[k:]], by_suffix])
    block, place = np.full(n + SUFFIXES, shape.blocks), np.full(n + SUFFIXES, -1)
    for g in range(shape.groups):
        mine = np.flatnonzero(own == g)
        fit = np.arange(len(mine)) < shape.blocks * WIDTH
        block[mine[fit]], place[mine[fit]] = np.arange(len(mine))[fit] // WIDTH, np.arange(len(mine))[fit] % WIDTH
    size = np.zeros((shape.groups, shape.blocks + 1, WIDTH))
    inside = np.flatnonzero(place[:n] >= 0)
    size[group[inside], block[inside], place[inside]] = v.counts[inside] + 1
    outside = np.flatnonzero(place[:n] < 0)
    tail = np.bincount(group[outside], v.counts[outside] + 1.0, shape.groups) + np.bincount(by_suffix, v.unlisted, shape.groups) + 1
    blocks = size.sum(2)
    blocks[:, shape.blocks] += tail
    log = lambda x: np.where(x > 0, np.log(np.maximum(x, 1e-300)), -1e9).astype(np.float32)
    context = np.concatenate([np.arange(k), k + ends[k:], k + np.arange(SUFFIXES), [k + SUFFIXES]])
    by_group, words = blocks.sum(1), size[:, : shape.blocks].reshape(-1, WIDTH)
    biases = [log(by_group / by_group.sum())[None], log(blocks / by_group[:, None]), log(words / np.maximum(1e-300, words.sum(1, keepdims=True)))]
    weights = [np.zeros((n * shape.rows, b.shape[1]), np.float32) for n, b in zip(FEATURES, biases)]
    return Model(shape, group, block, place, context, biases, tail, weights)


@dataclass
class Stream:
    """Tokens of some documents in a row. at: place in the list, or the number listed and the suffix; known: listed."""

    at: np.ndarray
    one: np.ndarray
    two: np.ndarray
    sizes: np.ndarray
    known: np.ndarray
    tail: list[Counter]


def encode(texts: list[bytes], place: dict[bytes, int], context: np.ndarray, want_tail: bool = False) -> Stream:
    words, sizes, tail = [], [], []
    for raw in texts:
        own = tokens(raw)
        words += own
        sizes.append(len(own))
    at, sizes = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words)), np.array(sizes, np.int64)
    known = at >= 0
    rare = np.flatnonzero(~known)
    missed = list(map(words.__getitem__, rare.tolist()))
    at[rare] = len(place) + suffixes(missed)
    if want_tail:
        ends = np.searchsorted(rare, np.cumsum(sizes)).tolist()
        tail = [Counter(missed[a:b]) for a, b in zip([0, *ends], ends)]
    seen, start = context[at], context[-1]
    first = np.cumsum(sizes) - sizes
    one, two = np.empty_like(at), np.empty_like(at)
    one[1:], one[first] = seen[:-1], start
    two[2:] = seen[:-2]
    two[first], two[np.minimum(first + 1, len(at) - 1)] = start, start
    return Stream(at, one, two, sizes, known, tail)


def factors(m: Model, at: np.ndarray, one: np.ndarray, two: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
    """For group, block and word: tokens that have the factor, rows of their features, the branch taken, and e to the power of
    its sum of weights for every branch. Weights are sums of few bounded steps, so no power overflows."""
    r, every, g = m.shape.rows, np.arange(len(at)), m.group[at]
    hot = np.flatnonzero(m.place[at] >= 0)
    node = g[hot] * m.shape.blocks + m.block[at[hot]]
    for k, own, rows, branch, bias in (
        (0, every, [_hash(one, 1) % r, _hash(two, 2) % r + r], g, np.zeros(len(at), np.int64)),
        (1, every, [_hash(one * 131_071 + g, 4) % r], m.block[at], g),
        (2, hot, [_hash(one[hot] * 131_071 + node, 6) % r], m.place[at[hot]], node),
    ):
        z = m.biases[k].take(bias, 0)
        for x in rows:
            z += m.weights[k].take(x, 0)
        yield own, rows, branch, z


def log_probability(m: Model, at: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Natural log of the factors of each token; a token without a place lacks its share of the last block."""
    out = np.zeros(len(at))
    for own, _, branch, z in factors(m, at, one, two):
        mine = z[np.arange(len(own)), branch].astype(np.float64)
        out[own] += mine - np.log(np.exp(z, out=z).sum(1, dtype=np.float64))
    return out


def gradient(m: Model, at: np.ndarray, one: np.ndarray, two: np.ndarray, into: list[np.ndarray]) -> None:
    """Adds expected minus observed counts to ``into``: for each factor an array with a row for each row of weights, and one
    more column for its uses."""
    for total, (own, rows, branch, z) in zip(into, factors(m, at, one, two)):
        if not len(own):
            continue
        p = np.exp(z, out=z)
        p *= np.float32(UNIT) / p.sum(1, keepdims=True)
        whole = np.empty((len(own), z.shape[1] + 1), np.int32)
        np.rint(p, out=whole[:, :-1], casting="unsafe")
        whole[np.arange(len(own)), branch] -= UNIT
        whole[:, -1] = UNIT
        for x in rows:
            order = np.argsort(x.astype(np.uint16), kind="stable")  # tables have less than 2^16 rows
            sorted_rows = x.take(order)
            first = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
            total[sorted_rows[first]] += np.add.reduceat(whole.take(order, 0), first)


# Sums over tasks

_PART = "part int, slot int, rows binary, data binary"


def _emit(totals: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A task's rows that aren't zero, in parts of PART_ROWS rows of a table, each with the slot in which it is first added."""
    slot, part = TaskContext.get().partitionId() % FAN, 0
    for total in totals:
        for k in range(0, len(total), PART_ROWS):
            own = total[k:k + PART_ROWS]
            rows = np.flatnonzero(own.any(1))
            if len(rows):
                data = own[rows]
                if np.abs(data).max() < 1 << 31:
                    data = data.astype(np.int32)
                yield _record(part, slot, rows, data)
            part += 1


def _record(part: int, slot: int, rows: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([slot], pa.int32()), pa.array([rows.astype(np.int16).tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], ["part", "slot", "rows", "data"])


def _read(rows: bytes, data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(rows, np.int16).astype(np.int64)
    return at, np.frombuffer(data, np.int32 if len(data) == 4 * width * len(at) else np.int64).reshape(len(at), width)


def _adder(widths: list[int]):
    """Sums by (part, slot) as rows come: memory for the keys of a partition, not for the tasks. ``widths``: of each part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for part, slot, rows, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (part, slot) not in held:
                    held[part, slot] = np.zeros((PART_ROWS, widths[part]), np.int64)
                at, own = _read(rows, data, widths[part])
                held[part, slot][at] += own
        for (part, slot), total in sorted(held.items()):
            rows = np.flatnonzero(total.any(1))
            yield _record(part, slot, rows, total[rows])

    return work


def summed(rows: DataFrame, work: Callable, shapes: list[tuple[int, int]]) -> list[np.ndarray]:
    """The sums over tasks of the arrays that ``work`` emits, whose shapes are given."""
    widths = [w for n, w in shapes for _ in range(-(-n // PART_ROWS))]
    tables = [np.zeros((-(-n // PART_ROWS) * PART_ROWS, w), np.int64) for n, w in shapes]
    starts = [(t, k) for t, (n, _) in enumerate(shapes) for k in range(0, n, PART_ROWS)]
    first = rows.mapInArrow(work, _PART).repartition("part", "slot").mapInArrow(_adder(widths), _PART)
    got = first.select("part", F.lit(0).alias("slot"), "rows", "data").repartition("part").mapInArrow(_adder(widths), _PART).toArrow()
    for part, at, data in zip(got["part"].to_pylist(), got["rows"].to_pylist(), got["data"].to_pylist()):
        t, k = starts[part]
        place, own = _read(at, data, widths[part])
        tables[t][k + place] = own
    return [t[:n] for t, (n, _) in zip(tables, shapes)]


_held: list = [None, None]


def _load(shared: Broadcast) -> tuple[Vocabulary, dict[bytes, int]]:
    """The vocabulary and the places of its tokens, made once a worker process."""
    v = shared.value
    if _held[0] is not v:
        _held[:] = v, {w: k for k, w in enumerate(v.listed)}
    return v, _held[1]


def _blocks(batches: Iterator[pa.RecordBatch], place: dict[bytes, int], context: np.ndarray) -> Iterator[tuple]:
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            s = encode(batch.column(0).slice(k, 512).to_pylist(), place, context)
            for a in range(0, len(s.at), BLOCK):
                cut = slice(a, a + BLOCK)
                yield s.at[cut], s.one[cut], s.two[cut]


def _anchors_before(shared: Broadcast, modelled: int):
    """How often each anchor is the token before, or the one before that, of each modelled token."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, place = _load(shared)
        k = min(modelled, len(place))
        context = np.concatenate([np.arange(len(place)), np.full(SUFFIXES + 1, len(place))])
        total = np.zeros(k * ANCHORS, np.int64)
        for at, one, two in _blocks(batches, place, context):
            for c in (one, two):
                hit = (at < k) & (c < min(k, ANCHORS))
                np.add.at(total, at[hit] * ANCHORS + c[hit], 1)
        yield from _emit([total.reshape(k, ANCHORS)])

    return work


def _learn(shared: Broadcast, model: Broadcast):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, place = _load(shared)
        m: Model = model.value
        total = [np.zeros((len(w), w.shape[1] + 1), np.int64) for w in m.weights]
        for at, one, two in _blocks(batches, place, m.context):
            gradient(m, at, one, two, total)
        yield from _emit(total)

    return work


def update(m: Model, sums: list[np.ndarray]) -> list[np.ndarray]:
    """Weights after a step, from the summed gradients (expected minus observed) and uses of rows."""
    out = []
    for w, total, features, bias in zip(m.weights, sums, FEATURES, m.biases):
        g, uses = total[:, :-1] / UNIT, total[:, -1:] / UNIT
        # What a row expects of a branch, as if it were alone; nodes that share the table by their mean.
        p = np.exp(w.astype(np.float64)) * np.exp(bias.astype(np.float64)).mean(0)
        e = np.maximum(uses * p / np.maximum(p.sum(1, keepdims=True), 1e-300), g)
        step = np.log((e - g + SMOOTH) / (e + SMOOTH)) / features
        out.append((w + np.where(g != 0, np.clip(step, -2, 2), 0)).astype(np.float32))
    return out


def fit(rows: DataFrame, shared: Broadcast, steps: int = STEPS) -> Model:
    """``rows``: body and turn (0 to ``steps`` - 1) of the training documents."""
    spark, v = rows.sparkSession, shared.value
    shape = Shape.of(len(v.listed))
    k = min(shape.modelled, len(v.listed))
    m = arrange(v, shape, summed(rows.select("body"), _anchors_before(shared, shape.modelled), [(k, ANCHORS)])[0])
    for turn in range(steps):
        model = spark.sparkContext.broadcast(m)
        m.weights = update(m, summed(rows.where(F.col("turn") == turn).select("body"), _learn(shared, model), [(len(w), w.shape[1] + 1) for w in m.weights]))
        model.destroy()
    return m


# Scores


def _score(shared: Broadcast, model: Broadcast):
    """Per document: figures of listed tokens, and the other tokens with their number in the document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, place = _load(shared)
        m: Model = model.value
        log_count = np.concatenate([np.log10(v.counts + 1.0), np.zeros(SUFFIXES)])
        log_tail = np.log10(m.tail_mass)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                own = batch.slice(k, 512)
                s = encode(own.column(1).to_pylist(), place, m.context, True)
                score = np.empty(len(s.at))
                for a in range(0, len(s.at), BLOCK):
                    cut = slice(a, a + BLOCK)
                    score[cut] = log_probability(m, s.at[cut], s.one[cut], s.two[cut])
                score /= np.log(10)
                logs = log_count[s.at]
                score += np.where(m.place[s.at] < 0, logs - log_tail[m.group[s.at]], 0.0)
                first = np.cumsum(s.sizes) - s.sizes
                tails = [pa.array([w for c in s.tail for w in c], pa.binary()), pa.array([n for c in s.tail for n in c.values()], pa.int32())]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in s.tail])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + own.num_rows)), own.column(0), pa.array(s.sizes), pa.array(np.add.reduceat(s.known.astype(np.int64), first)),
                    pa.array(np.add.reduceat(logs, first)), pa.array(np.add.reduceat(score, first)),
                    pa.ListArray.from_arrays(ends, tails[0]), pa.ListArray.from_arrays(ends, tails[1]),
                ], ["row", "doc_id", "n_tokens", "n_listed", "logs", "score", "tail", "times"])
                row += own.num_rows

    return work


def is_held_out(doc_id: str = "doc_id", parts: int = 7, part: int = 2) -> Column:
    return F.pmod(id_crc(doc_id), F.lit(parts)) == part


def prepare(docs: DataFrame, doc_id: str, text: str, listed: int) -> tuple[DataFrame, DataFrame, Broadcast, int, Model]:
    """Rows, token counts, the vocabulary, the least count of a listed token, and the model."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_bytes(text).alias("body"))
    training = rows.where(~is_held_out()).withColumn("turn", F.pmod(F.xxhash64("body"), F.lit(STEPS)))
    counts = materialize(count_tokens(training))
    v, least = vocabulary(counts, listed)
    shared = docs.sparkSession.sparkContext.broadcast(v)
    return rows, counts, shared, least, fit(training, shared)


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", listed: int = LISTED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per row of ``docs``."""
    rows, counts, shared, least, m = prepare(docs, doc_id, text, listed)
    v = shared.value
    schema = f"row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_listed long, logs double, score double, tail array<binary>, times array<int>"
    scored = materialize(rows.mapInArrow(_score(shared, docs.sparkSession.sparkContext.broadcast(m)), schema))
    rare = scored.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("row", F.col("x.tail").alias("token"), F.col("x.times").alias("times"))
    met = rare.join(counts.where(F.col("n") < least).hint("shuffle_hash"), "token")  # tokens that don't meet are unseen: log10(0 + 1) is 0
    tail = met.groupBy("row").agg(F.sum("times").alias("n_tail"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("tail_logs"))
    logs = F.coalesce("tail_logs", F.lit(0.0))
    return scored.join(tail, "row", "left").select(
        "doc_id", is_held_out().alias("held_out"), "n_tokens", (F.col("n_listed") + F.coalesce("n_tail", F.lit(0))).alias("n_known"), F.lit(v.n_all).cast("long").alias("train_tokens"),
        (F.col("logs") + logs - F.col("n_tokens") * F.lit(float(np.log10(v.mass)))).alias("base_score"), (F.col("score") + logs).alias("score"),
    )
