"""Byte-level BPE by a monoid tree reduction.

A text is cut into pieces by the vocabulary's pattern and each piece is encoded on its own. A piece that is a token stands for
itself. Otherwise its bytes are halved until a part is short, short parts are merged directly (lowest rank first, leftmost of
equal ranks), and neighbouring results are joined upwards:

    join(L, R) = L + R                                        if (last of L, first of R) is a stable pair
               = L minus k tokens + encode(window) + R minus k   else, for k = 1, 2, 4, ...

until the seams on both sides of the window are stable pairs. A pair of tokens (a, b) is stable when encoding bytes(a) +
bytes(b) gives (a, b) again.

*Why that is exact.* If all neighbours in a token sequence are stable pairs, the sequence is the encoding of its bytes. Assume
not, and take the first merge of the full run that crosses a token boundary, between a and b say. Until then all merges lie
inside tokens, so the part of the state that covers a and b went through the states of the run over bytes(a) + bytes(b) alone,
as the lowest rank of all, whenever it lies there, is the lowest rank there. So that run takes the crossing merge too, and its
result isn't (a, b). L, R and the window's encoding have stable neighbours inside; only the seams need the test.

Decoding is the homomorphism back: the bytes of both halves are concatenated up the tree.

Between words: a piece never goes on from a character that isn't white space into a space, so the text may be cut there
before the pattern is matched, and units such as " word" are looked up in a bounded table of units seen before.

Null text: no tokens. An identifier out of range raises ``ValueError``. Repeated rows are encoded each, long texts piece by
piece, empty tables give empty results, null identifiers of rows stay, since only the text is read. Columns that clash with the
output names are kept; the output takes a free name, see ``encode``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .common import free_name, slices

LEAF = 6
SHORT = 24
UNITS, LEAVES, PAIRS = 200_000, 200_000, 300_000
JOIN_IDS = 4096
ROWS = 512
_SPACE_BEFORE = re.compile(r"\s ").search


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pieces = ranks, regex.compile(pattern).findall
        self.bytes_of: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for b, r in ranks.items():
            self.bytes_of[r] = b
        self.stable: dict[tuple[int, int], bool] = {}
        self.leaves: dict[bytes, list[int]] = {}
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.marks = {m: tuple(self.piece(m.encode())) for m in ".,;:!?"}

    def merge(self, part: bytes) -> list[int]:
        """Direct merging: a heap of (rank, place) over a linked list; a plain scan where the part is short."""
        ranks = self.ranks
        if len(part) <= SHORT:
            parts = [part[k:k + 1] for k in range(len(part))]
            while len(parts) > 1:
                found = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
                low = min(found)
                if low == 1 << 60:
                    break
                k = found.index(low)
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
            return [ranks[x] for x in parts]
        n = len(part)
        ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive, heap = [True] * n, []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < n and (r := ranks.get(part[k:ends[after[k]]])) is not None:
                heapq.heappush(heap, (r, k, ends[after[k]]))

        for k in range(n):
            offer(k)
        while heap:
            _, k, end = heapq.heappop(heap)
            if not alive[k] or after[k] >= n or ends[after[k]] != end:
                continue
            gone = after[k]
            alive[gone], ends[k], after[k] = False, end, after[gone]
            if after[k] < n:
                before[after[k]] = k
            offer(k)
            offer(before[k])
        return [ranks[part[k:ends[k]]] for k in range(n) if alive[k]]

    def is_stable(self, a: int, b: int) -> bool:
        held = self.stable.get((a, b))
        if held is None:
            if len(self.stable) >= PAIRS:
                self.stable.clear()
            held = self.stable[a, b] = (self.leaves.get(part := self.bytes_of[a] + self.bytes_of[b]) or self.leaf(part)) == [a, b]
        return held

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.is_stable(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            a, b = left[-k:], right[:k]
            part = b"".join([self.bytes_of[i] for i in a + b])
            window = self.leaves.get(part) or self.leaf(part)
            if (len(left) <= k or self.is_stable(left[-k - 1], window[0])) and (len(right) <= k or self.is_stable(window[-1], right[k])):
                return left[:-k] + window + right[k:]
            k *= 2

    def reduce(self, part: bytes) -> list[int]:
        if len(part) > LEAF:
            half = len(part) // 2
            return self.join(self.reduce(part[:half]), self.reduce(part[half:]))
        return self.leaves.get(part) or self.leaf(part)

    def leaf(self, part: bytes) -> list[int]:
        """The encoding of bytes merged directly, held if short: leaves, pairs and windows come back often."""
        if len(part) > SHORT:
            return self.merge(part)
        if len(self.leaves) >= LEAVES:
            self.leaves.clear()
        held = self.leaves[part] = self.merge(part)
        return held

    def piece(self, part: bytes) -> list[int]:
        whole = self.ranks.get(part)
        return self.reduce(part) if whole is None else [whole]

    def unit(self, unit: str) -> tuple[int, ...]:
        """Ids of a unit that ends where a piece ends."""
        if (unit[1:] if unit[0] == " " else unit).isalpha():  # letters: the pattern takes them as one piece
            return tuple(self.piece(unit.encode()))
        return tuple(i for p in self.pieces(unit) for i in self.piece(p.encode()))

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of a space and ``word``, which isn't in the young table."""
        ids = self.old.get(word)
        if ids is None:
            last = word[-1:]
            if last in self.marks and (stem := word[:-1]).isalpha():  # letters and a mark: two pieces
                ids = (self.young.get(stem) or self.word(stem)) + self.marks[last]
            else:
                ids = self.unit(" " + word)
        if len(word) <= 64:
            if len(self.young) >= UNITS:
                self.old, self.young = self.young, {}
            self.young[word] = ids
        return ids

    def encode(self, text: str, into: array) -> None:
        """Append the text's ids to ``into``."""
        if not text:
            return
        words = text.split(" ")
        if "" in words or _SPACE_BEFORE(text):  # white space before a space: no cut there
            glued = words[:1]
            for word in words[1:]:
                if glued[-1] and not glued[-1][-1].isspace():
                    glued.append(word)
                else:
                    glued[-1] += " " + word
            words = glued
        if words[0]:
            into.extend(self.unit(words[0]))
        get, miss = self.young.get, self.word
        into.extend(chain.from_iterable([get(w) or miss(w) for w in words[1:]]))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) > JOIN_IDS:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        try:
            if ids and min(ids) >= 0:
                return b"".join([self.bytes_of[i] for i in ids])
            if not ids:
                return b""
        except (IndexError, TypeError):
            pass
        raise ValueError("an id has no token")


_codecs: dict[str, Codec] = {}


def _codec(shared: Broadcast) -> Codec:
    """One codec a worker process, so that units seen in one task help the next. It is told by the vocabulary's content."""
    key, ranks, pattern = shared.value
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def share(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    """The vocabulary of at most a few MB, read on the driver; executors need not see ``path``."""
    ranks = read_ranks(path)
    content = hashlib.sha256(pattern.encode())
    for token, rank in sorted(ranks.items()):
        content.update(b"%d %d %b" % (rank, len(token), token))
    return spark.sparkContext.broadcast((content.hexdigest(), ranks, pattern))


def encode(docs: DataFrame, vocabulary: Broadcast, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` and a column of token ids, named ``ids`` or, if that is taken, ``ids_1`` and so on."""
    name, at = free_name(docs.columns, ids), docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for part in slices(batches, ROWS):
            flat, ends = array("i"), [0]
            for body in part.column(at).to_pylist():
                if body:
                    codec.encode(body, flat)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*part.columns, ids], [*own, name])

    own = [f"c{k}" for k in range(len(docs.columns))]
    flat = docs.toDF(*own).withColumn(own[at], F.col(own[at]).cast("string"))
    return flat.mapInArrow(work, StructType([*flat.schema.fields, StructField(name, ArrayType(IntegerType()))])).toDF(*docs.columns, name)


def decode(rows: DataFrame, vocabulary: Broadcast, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` and a binary column with the bytes of their ids; null ids give no bytes."""
    name, at = free_name(rows.columns, out), rows.columns.index(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for part in slices(batches, ROWS):
            flat = part.column(at).flatten().to_pylist() if part.column(at).flatten().null_count else part.column(at).flatten().to_numpy().tolist()
            ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(part.column(at)), 0))).tolist()
            texts = [codec.decode(flat[a:b]) for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*own, name])

    own = [f"c{k}" for k in range(len(rows.columns))]
    flat = rows.toDF(*own)
    return flat.mapInArrow(work, StructType([*flat.schema.fields, StructField(name, BinaryType())])).toDF(*rows.columns, name)
