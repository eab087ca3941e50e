"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into chunks of ``CHUNK`` bytes that overlap by ``CHUNK - STEP``, up to the last byte (the rest of the
last chunk is byte 0; an empty text is one chunk of zeros). In a chunk, learned filters over ``WIDTH`` bytes at every second
byte act on learned byte vectors; each filter is max-pooled over the chunk. A hidden layer reads the pooled filters, so it can
see what occurs in a chunk as well as what is missing, as in a chunk of one word over and over. Over the whole document the
hidden units are pooled by maximum and by mean, and a logistic unit gives the probability of label 1.

Training: gradient descent (Adam) on the driver, on a sample of at most about ``TRAIN_DOCS`` labelled rows by hash of the
identifier, in ``UPDATES`` updates of ``BATCH`` texts whatever the sample's size. Every chunk of a sampled text is read, as in
scoring; long texts go through the network in blocks, so memory is that of the texts plus one block. Inputs are bytes of the
text only. The sample is ordered and the start seeded, so equal tables give equal models.

Null text: empty. Labels without a document, null labels and labels under a null identifier are ignored; of repeated labels the
larger counts, and repeated rows of a labelled document each count. Identifiers may be of any type; labels meet them as text.
Null identifiers stay in the result. Without training rows every score is 0.5. Scores of equal texts are equal. Empty tables
give empty results; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_crc, id_text, text_bytes

CHUNK, STEP, WIDTH, STRIDE = 256, 224, 8, 2
VECTOR, FILTERS, HIDDEN = 4, 32, 16
TRAIN_DOCS = 1600
UPDATES, BATCH, RATE = 700, 32, 6e-3
SEED = 42
THRESHOLD = 0.3
_BLOCK = 64
_SITES = (CHUNK - WIDTH) // STRIDE + 1


def chunk_starts(size: int) -> range:
    """Starts of overlapping chunks that cover ``size`` bytes."""
    return range(0, max(1, size - CHUNK + STEP), STEP)


def chunks(raw: bytes) -> np.ndarray:
    """The chunks of a text as rows."""
    starts = chunk_starts(len(raw))
    data = np.zeros(max(starts[-1] + CHUNK, len(raw)), np.uint8)
    data[: len(raw)] = np.frombuffer(raw, np.uint8)
    return data[np.asarray(starts)[:, None] + np.arange(CHUNK)]


class Network:
    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        scale = lambda *shape: rng.standard_normal(shape, np.float32)
        self.p = {
            "vectors": scale(256, VECTOR) * 0.5, "filters": scale(WIDTH * VECTOR, FILTERS) / np.float32(np.sqrt(WIDTH * VECTOR)) * 2, "filter_bias": np.zeros(FILTERS, np.float32),
            "hidden": scale(FILTERS, HIDDEN) / np.float32(np.sqrt(FILTERS)), "hidden_bias": np.zeros(HIDDEN, np.float32),
            "out": scale(2 * HIDDEN) * 0.1, "out_bias": np.zeros(1, np.float32),
        }

    def windows(self, rows: np.ndarray) -> np.ndarray:
        """(chunks, sites, WIDTH * VECTOR), the bytes' vectors below each site of a filter."""
        v = self.p["vectors"][rows].reshape(len(rows), CHUNK * VECTOR)
        view = np.lib.stride_tricks.sliding_window_view(v, WIDTH * VECTOR, axis=1)[:, :: STRIDE * VECTOR]
        return np.ascontiguousarray(view)

    def peaks(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each chunk and filter the site with the largest value, and that value with its bias."""
        best, peak = np.empty((len(rows), FILTERS), np.int64), np.empty((len(rows), FILTERS), self.p["filters"].dtype)
        for k in range(0, len(rows), _BLOCK):
            w = self.windows(rows[k:k + _BLOCK])
            sites = (w.reshape(-1, WIDTH * VECTOR) @ self.p["filters"]).reshape(len(w), _SITES, FILTERS)
            best[k:k + _BLOCK] = sites.argmax(1)
            peak[k:k + _BLOCK] = np.take_along_axis(sites, best[k:k + _BLOCK, None], 1)[:, 0]
        return best, peak + self.p["filter_bias"]

    def units(self, rows: np.ndarray) -> np.ndarray:
        """Hidden units of chunks."""
        p, out = self.p, np.empty((len(rows), HIDDEN), np.float32)
        for k in range(0, len(rows), _BLOCK):
            w = self.windows(rows[k:k + _BLOCK])
            sites = (w.reshape(-1, WIDTH * VECTOR) @ p["filters"]).reshape(len(w), _SITES, FILTERS)
            pooled = np.maximum(sites.max(1) + p["filter_bias"], 0)
            out[k:k + _BLOCK] = np.maximum(pooled @ p["hidden"] + p["hidden_bias"], 0)
        return out

    def scores(self, texts: list[bytes]) -> list[float]:
        out = []
        for raw in texts:
            rows = chunks(raw)
            h = self.units(rows)
            z = np.concatenate([h.max(0), h.mean(0)]) @ self.p["out"] + self.p["out_bias"][0]
            out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return out

    def gradients(self, texts: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        p, rows = self.p, np.concatenate(texts)
        sizes = np.array([len(t) for t in texts])
        first = np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(len(texts)), sizes)
        best, peak = self.peaks(rows)
        pooled = np.maximum(peak, 0)
        h = np.maximum(pooled @ p["hidden"] + p["hidden_bias"], 0)
        top, mean = np.maximum.reduceat(h, first), np.add.reduceat(h, first) / sizes[:, None]
        z = np.concatenate([top, mean], 1) @ p["out"] + p["out_bias"][0]
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(texts)).astype(np.float32)
        g = {"out": np.concatenate([top, mean], 1).T @ dz, "out_bias": dz.sum(keepdims=True)}
        d_top, d_mean = dz[:, None] * p["out"][:HIDDEN], dz[:, None] * p["out"][HIDDEN:] / sizes[:, None]
        ties = h == top[doc]
        dh = (d_mean[doc] + np.where(ties, d_top[doc] / np.add.reduceat(ties.astype(np.float32), first)[doc], 0)) * (h > 0)
        g["hidden"], g["hidden_bias"] = pooled.T @ dh, dh.sum(0)
        da = (dh @ p["hidden"].T) * (peak > 0)
        g["filters"], g["filter_bias"], g["vectors"] = np.zeros_like(p["filters"]), da.sum(0), np.zeros_like(p["vectors"])
        for k in range(0, len(rows), _BLOCK):
            own, d = rows[k:k + _BLOCK], da[k:k + _BLOCK]
            where = own[np.arange(len(own))[:, None, None], best[k:k + _BLOCK, :, None] * STRIDE + np.arange(WIDTH)]
            at = p["vectors"][where].reshape(len(own), FILTERS, WIDTH * VECTOR)
            g["filters"] += np.einsum("mfk,mf->kf", at, d)
            dv = (d[:, :, None] * p["filters"].T[None]).reshape(-1, VECTOR)
            g["vectors"] += np.stack([np.bincount(where.ravel(), dv[:, j], 256) for j in range(VECTOR)], 1)
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, updates: int = UPDATES) -> None:
        rng, order = np.random.default_rng(SEED), np.empty(0, int)
        share = np.clip(labels.mean(), 0.01, 0.99)
        self.p["out_bias"][0] = np.log(share / (1 - share))
        m, s = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for t in range(1, updates + 1):
            while len(order) < BATCH:
                order = np.concatenate([order, rng.permutation(len(texts))])
            pick, order = order[:BATCH], order[BATCH:]
            rate = RATE * (1 - 0.9 * t / updates)
            for name, grad in self.gradients([chunks(texts[i]) for i in pick], labels[pick]).items():
                m[name] = 0.9 * m[name] + 0.1 * grad
                s[name] = 0.99 * s[name] + 0.01 * grad * grad
                self.p[name] -= np.float32(rate) * ((m[name] / (1 - 0.9**t)) / (np.sqrt(s[name] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Network | None:
    """``labels``: doc_id, label (0 or 1). The network, or None without rows."""
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(id_text("doc_id").alias("id")).agg(F.max("label").cast("int").alias("label"))
    every = max(1, -(-known.count() // TRAIN_DOCS))
    picked = known.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(every)) == 0)
    rows = docs.select(id_text(doc_id).alias("id"), text_bytes(text).alias("body")).join(F.broadcast(picked), "id")  # about TRAIN_DOCS rows
    got = rows.select("id", "label", "body").orderBy("id", "body").toArrow()
    if not got.num_rows:
        return None
    network = Network()
    network.fit(got["body"].to_pylist(), np.asarray(got["label"]).astype(np.float32))
    return network


def held_out(doc_id: str = "doc_id", parts: int = 5) -> Column:
    return F.pmod(id_crc(doc_id), F.lit(parts)) == 0


def score(docs: DataFrame, network: Network | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(network.p if network else None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        if shared.value:
            own = Network()
            own.p = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.scores(texts) if own else [0.5] * len(texts), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_bytes(text).alias("body"))
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out rows are never read."""
    network = train(docs, labels.where(~held_out()))
    scored = score(docs, network)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
