"""Mixing sources to target weights with soft membership.

1. *Domains.* A classifier is fitted on a bounded sample of the labelled table (``SAMPLE_ROWS`` rows by hash of the identifier).
   Its features are the square roots of the byte frequencies and the presence of words that tell the domains apart. It
   predicts for every document the posterior p over the domains.
2. *Rates.* Document d has t tokens (words). Rates r >= 0 are sought for which the expected totals sum(r t p_k) equal the
   targets: projected gradient on the squared residual, started at 1. The gradient with respect to r_d is t_d (p_d . e), e
   being the residual; measured in token mass, the step of document d is p_d . s with s = H^-1 e and H = sum(t p p') over the
   documents with r > 0, and then r is cut off at 0. All documents share the K numbers of s, so a step is one aggregate
   of K residuals and K x K curvatures, and the rate of a document is a fold over the steps so far: nothing is kept per
   document, and the driver sees K-sized rows only. If the residual doesn't shrink, the step is halved.
3. *Totals.* The total is by default the largest at which no wanted domain has to be repeated: min over the wanted k of
   natural_k / weight_k. Unwanted domains don't size it: they are cut to weight_k x total where they have more, and stay as
   they are where they have less, so a scarce unwanted domain costs no clean document. A total that is given holds for all.

The texts are classified once: the rows with tokens, posterior and a draw are written as a table, which the steps and the
result read. ``fit_rates`` returns what the targets were and what was reached; more than ``MISSED`` off is a warning with the
figures, as where posteriors are too diffuse for the weights.

``copies`` turns a rate into floor(rate + u), with u in [0, 1) a seeded hash of identifier and text, which keeps the expected
total. Rows that agree in both have draws of their own after the first of a partition. A rate above one repeats a row; nothing
bounds it but the targets.

Labels: doc_id, domain; repeated labels of a document: the largest name counts; unknown domains and null are ignored, as are
labels under a null identifier. Identifiers may be of any type; labels meet them as text. Null and empty texts have no tokens;
their rate follows their posterior. Null identifiers stay. A domain without a row in the labelled sample can't be told apart or
reached: it keeps the mass that posteriors give it (a softmax is never 0) and is left out of the default total. Without any
labelled document the posterior is uniform and all rates are 1. Very long texts are classified one at a time. Empty tables give
empty results. Other columns keep their values and names, whatever they are called.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import WORD, id_text, materialize, slices, text_bytes, written

SAMPLE_ROWS = 4000
VOCABULARY = 1000
MIN_TEXTS = 8
ROUNDS = 40
TOLERANCE, MISSED = 1e-9, 0.01
SEED = 42
#: Target weights of the label table's domains.
DOMAINS = ("good", "poor", "toxic")
TARGETS = (0.95, 0.04, 0.01)
#: Domains whose weight is a ceiling.
UNWANTED = ("poor", "toxic")


def label_domains(labels: DataFrame) -> DataFrame:
    """The domain of a row of ``labels``: toxic before poor (quality 0) before good (quality 1)."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain"))


@dataclass
class Classifier:
    """Multinomial logistic regression; ``words`` gives the columns after the 256 byte frequencies."""

    words: dict[bytes, int]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    seen: np.ndarray | None = None  # labelled rows of each domain in the sample

    def features(self, raw: bytes) -> tuple[np.ndarray, int]:
        row = np.zeros(256 + len(self.words), np.float32)
        if raw:
            row[:256] = np.sqrt(np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw))
        words = raw.lower().split()
        for w in self.words.keys() & set(words):
            row[256 + self.words[w]] = 1
        return row, len(words)

    def posterior(self, rows: np.ndarray) -> np.ndarray:
        z = ((rows - self.mean) / self.scale) @ self.weights + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _fit(x: np.ndarray, y: np.ndarray, k: int, words: dict[bytes, int], steps: int = 250, rate: float = 0.03, decay: float = 1e-3) -> Classifier:
    n = x.shape[1]
    mean = np.concatenate([x[:, :256].mean(0), np.zeros(n - 256)]) if len(x) else np.zeros(n)
    scale = np.concatenate([x[:, :256].std(0) + 1e-2, np.ones(n - 256)]) if len(x) else np.ones(n)
    model = Classifier(words, mean, scale, np.zeros((n, k)), np.zeros(k))
    if not len(x):
        return model
    hot, z = np.eye(k)[y], (x - mean) / scale
    model.bias = np.log((hot.sum(0) + 0.5) / (len(x) + 0.5 * k))
    state = [np.zeros((n, k)), np.zeros((n, k)), np.zeros(k), np.zeros(k)]
    for t in range(1, steps + 1):
        q = z @ model.weights + model.bias
        p = np.exp(q - q.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - hot) / len(x)
        for at, grad, value in ((0, z.T @ g + decay * model.weights, model.weights), (2, g.sum(0), model.bias)):
            state[at] = 0.9 * state[at] + 0.1 * grad
            state[at + 1] = 0.999 * state[at + 1] + 0.001 * grad * grad
            value -= rate * (state[at] / (1 - 0.9**t)) / (np.sqrt(state[at + 1] / (1 - 0.999**t)) + 1e-8)
    return model


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: tuple[str, ...], doc_id: str = "doc_id", text: str = "text") -> Classifier:
    named = labels.where(F.col("domain").isin(*domains) & F.col("doc_id").isNotNull()).groupBy(id_text("doc_id").alias("id")).agg(F.max("domain").alias("domain"))
    every = max(1, -(-named.count() // SAMPLE_ROWS))
    picked = named.where(F.pmod(F.xxhash64(F.col("id"), F.lit(SEED)), F.lit(every)) == 0)  # about SAMPLE_ROWS rows
    rows = docs.select(id_text(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sample = materialize(rows.join(F.broadcast(picked), "id").select("domain", "text"))
    size = {r[0]: r[1] for r in sample.groupBy("domain").count().collect()}
    total = sum(size.values())
    # Words by the largest excess of their share in a domain over that in the rest, in standard errors.
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = sample.select("domain", F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(f"({WORD})"), F.lit(1)))).alias("word"))
    seen = each.groupBy("word").agg(F.count("*").alias("n"), *(F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains))).where(F.col("n") >= MIN_TEXTS)
    excess = [F.abs(F.col(f"n{k}") - F.col("n") * size.get(d, 0) / total) / F.sqrt(F.col("n") * size.get(d, 0) / total + 1) for k, d in enumerate(domains)] if total else [F.lit(0.0)] * 2
    chosen = seen.orderBy(F.greatest(*excess).desc(), "word").limit(VOCABULARY).select("word").collect() if total else []
    words = {r[0].encode(): k for k, r in enumerate(chosen)}
    plain = Classifier(words, np.zeros(1), np.ones(1), np.zeros((1, 1)), np.zeros(1))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [plain.features(raw)[0].tobytes() for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["domain", "row"])

    got = sample.select("domain", text_bytes().alias("body")).mapInArrow(extract, "domain string, row binary").orderBy("domain", "row").toArrow()
    x = np.array([np.frombuffer(r, np.float32) for r in got["row"].to_pylist()]).reshape(got.num_rows, 256 + len(words))
    y = np.array([domains.index(d) for d in got["domain"].to_pylist()], int)
    model = _fit(x, y, len(domains), words)
    model.seen = np.bincount(y, minlength=len(domains))
    return model


def _annotate(model: Classifier, names: list[str]):
    """Replaces the last two columns (identifier and text as bytes) by the number of tokens, the posterior and the draw."""
    k = len(model.bias)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in slices(batches):
            ids, texts = (batch.column(batch.num_columns - j).to_pylist() for j in (2, 1))
            got = [model.features(raw) for raw in texts]
            p = model.posterior(np.array([g[0] for g in got])) if got else np.zeros((0, k))
            draws = []
            for doc, raw in zip(ids, texts):
                key = xxhash.xxh64_intdigest((doc or b"") + b"\0" + raw, SEED)
                times = seen[key] = seen.get(key, -1) + 1
                own = key if not times else xxhash.xxh64_intdigest(b"%d %d %d" % (key, part, times), SEED)
                draws.append((own >> 11) / (1 << 53))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(got) + 1) * k, k, np.int32)), pa.array(p.astype(float).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array([g[1] for g in got], pa.int64()), lists, pa.array(draws, pa.float64())], names)

    return work


def _rate(p: str, steps: list[np.ndarray]) -> Column:
    """The rate after all steps: a fold of max(0, r - p . s) from 1."""
    if not steps:
        return F.lit(1.0)
    all_steps = F.array(*(F.array(*(F.lit(float(v)) for v in s)) for s in steps))
    dot = lambda s: F.aggregate(F.zip_with(F.col(p), s, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    return F.aggregate(all_steps, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - dot(s)))


def _totals(known: DataFrame, steps: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens of each domain, and the curvature over documents with a rate above 0; one row of sums."""
    rows = known.withColumn("r", _rate("p", steps))
    live = F.when(F.col("r") > 0, F.col("t")).otherwise(0)
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    row = rows.agg(*(F.sum(F.col("r") * F.col("t") * F.col("p")[a]) for a in range(k)), *(F.sum(live * F.col("p")[a] * F.col("p")[b]) for a, b in pairs)).first()
    values = [x or 0.0 for x in row]
    h = np.zeros((k, k))
    for (a, b), v in zip(pairs, values[k:]):
        h[a, b] = h[b, a] = v
    return np.array(values[:k]), h


def goals(now: np.ndarray, weights: np.ndarray, total: float | None = None, wanted: np.ndarray | None = None, labelled: np.ndarray | None = None) -> np.ndarray:
    """Tokens that each domain is to have, of ``now`` expected ones; by default all domains are wanted and labelled."""
    wanted = np.ones(len(now), bool) if wanted is None else wanted
    labelled = np.ones(len(now), bool) if labelled is None else labelled
    sizing = wanted & labelled & (weights > 0) & (now > 0)
    if total is None:
        goal = weights * (float((now[sizing] / weights[sizing]).min()) if sizing.any() else float(now.sum()))
        goal = np.where(wanted, goal, np.minimum(goal, now))
    else:
        goal = weights * total
    return np.where(labelled, goal, now)


@dataclass
class Fit:
    """The steps whose fold is each document's rate, with the expected tokens of each domain that were sought and reached."""

    steps: list[np.ndarray]
    goal: np.ndarray
    reached: np.ndarray

    @property
    def missed(self) -> float:
        """Sum of the differences, as a share of the total."""
        return float(np.abs(self.reached - self.goal).sum() / max(1e-300, self.goal.sum()))


def fit_rates(known: DataFrame, weights: np.ndarray, total: float | None = None, wanted: np.ndarray | None = None, labelled: np.ndarray | None = None) -> Fit:
    """``known``: t, p, materialized."""
    k = len(weights)
    now, h = _totals(known, [], k)
    if not now.sum():
        return Fit([], now, now)
    goal, steps, length = goals(now, weights, total, wanted, labelled), [], 1.0
    for _ in range(ROUNDS):
        error = now - goal
        if np.abs(error).sum() <= TOLERANCE * goal.sum():
            break
        step = length * np.linalg.solve(h + 1e-9 * max(np.trace(h), 1e-300) * np.eye(k), error)
        then, curve = _totals(known, [*steps, step], k)
        if (then - goal) @ (then - goal) < error @ error:
            steps, now, h, length = [*steps, step], then, curve, min(1.0, 2 * length)
        elif length < 1e-3:
            break
        else:
            length /= 2
    fit = Fit(steps, goal, now)
    if fit.missed > MISSED:
        warnings.warn(f"target weights missed by {fit.missed:.1%}: sought {goal.round().tolist()} tokens, reached {now.round().tolist()}", stacklevel=2)
    return fit


def _mixed(docs: DataFrame, labels: DataFrame, domains: tuple[str, ...], weights: tuple[float, ...], total: float | None, doc_id: str, text: str, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """The columns ``keep`` of ``docs`` by position, with t, p, u and rate, and the names by position."""
    model = fit_classifier(docs, labels, domains, doc_id, text)
    flat = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    of = lambda name: f"c{docs.columns.index(name)}"
    own = [of(name) for name in keep]
    rows = flat.select(*own, id_text(of(doc_id)).cast("binary").alias("id"), text_bytes(of(text)).alias("body"))
    extra = [StructField("t", LongType()), StructField("p", ArrayType(DoubleType())), StructField("u", DoubleType())]
    known = written(rows.mapInArrow(_annotate(model, [*own, "t", "p", "u"]), StructType([*rows.schema.fields[:-2], *extra])))
    fit = fit_rates(known.select("t", "p"), np.array(weights, float) / sum(weights), total, np.array([d not in UNWANTED for d in domains]), model.seen > 0)
    return known.withColumn("rate", _rate("p", fit.steps)), own


def copies(rate: str, draw: str) -> Column:
    return F.floor(F.col(rate) + F.col(draw)).cast("int")


def mixing_rates(docs: DataFrame, labels: DataFrame, domains: tuple[str, ...] = DOMAINS, weights: tuple[float, ...] = TARGETS, total: float | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, p_<domain>..., rate, copies."""
    rows, own = _mixed(docs, labels, domains, weights, total, doc_id, text, [doc_id])
    posteriors = [F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(domains)]
    return rows.select(F.col(own[0]).alias("doc_id"), F.col("t").alias("n_tokens"), *posteriors, "rate", copies("rate", "u").alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, domains: tuple[str, ...] = DOMAINS, weights: tuple[float, ...] = TARGETS, total: float | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row of ``docs`` as often as its rate says, columns unchanged."""
    rows, own = _mixed(docs, labels, domains, weights, total, doc_id, text, docs.columns)
    kept = rows.withColumn("times", copies("rate", "u")).where("times > 0")
    return kept.select(*own, F.explode(F.sequence(F.lit(1), "times")).alias("k")).select(*own).toDF(*docs.columns)
