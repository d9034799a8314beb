"""Quality classifier by positive-unlabelled learning.

Trusted positives are the rows that ``labels.quality`` marks with 1; no row is ever taken as a known negative. The texts of
all documents, positives included, are the unlabelled web text. With class prior ``p``, a linear score ``g`` and the logistic
loss, the risk that is minimised is the non-negative unbiased one,

    p * E_pos[loss(g)] + max(0, E_all[loss(-g)] - p * E_pos[loss(-g)]).

While the second part is positive the risk is convex (loss(g) - loss(-g) = -g) and Newton steps are taken; where it turns
negative, the step goes back along its gradient, and the weights of the least risk met are kept.

The prior is estimated first: a classifier of positives against all texts orders the texts, and the prior is the least
ratio of the share of all texts to the share of positives above a threshold, chosen by the bound on its error
(``DELTA``). Counts are taken in ``BINS`` bins of the score over all documents.

Measurements are shares of characters, words and lines; doc_id, lang, source and labels are never among them. A distinct
vector of measurements counts once, however many copies of a text there are. Nothing is sampled: every step
is one pass over the table of measurements, which is written once, and sends a sum of fixed size to the driver.

Null and empty texts have the measurements of no words and are scored like others. Texts of any length are read whole.
Repeated rows are scored each. A doc_id with several labels counts as positive if one says 1; null ids and null labels are left
out. Without a positive every score is 0, and an empty table gives no rows. Other columns of ``docs`` are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateworks.llm.storage import stage

THRESHOLD = 0.5
RIDGE = 1.0  # divided by the number of positives
STEPS = 30
CLOSE = 1e-6
BINS = 2000
MERGERS = 8
DELTA = 0.1

_CLASSES = ("space", "newline", "lower", "upper", "digit", "beyond", "stop", "exclaim", "quote", "bracket", "sign", "bar", "other")
_KIND = np.full(256, _CLASSES.index("other"), np.uint8)
for _name, _chars in (("space", b" \t\v\f\r"), ("newline", b"\n"), ("lower", bytes(range(97, 123))), ("upper", bytes(range(65, 91))), ("digit", bytes(range(48, 58))),
                      ("beyond", bytes(range(128, 256))), ("stop", b".,;:"), ("exclaim", b"!?"), ("quote", b"'\"`-"), ("bracket", b"()[]{}<>"), ("sign", b"#*$%&@+=~^_/\\"), ("bar", b"|")):
    _KIND[list(_chars)] = _CLASSES.index(_name)
_BARE = re.compile(rb"(?<!\S)[^\sA-Za-z0-9\x80-\xff]+(?!\S)")
_TAIL = re.compile(rb"[A-Za-z0-9\x80-\xff][^\sA-Za-z0-9\x80-\xff]{2,}(?!\S)")
MEASURES = (*(c for c in _CLASSES if c != "space"), "shouted_words", "bare_words", "tailed_words", "echoed_words", "repeated_words", "repeated_lines", "words_in_line", "word_length", "words")


def measured(text: bytes | None) -> np.ndarray:
    """The measurements of one text, each on a logarithmic scale."""
    text = text or b""
    words = text.split()
    n, chars = max(len(words), 1), max(len(text), 1)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=len(_CLASSES))
    lines = [x for x in text.split(b"\n") if x.strip()]
    shares = [*(kinds[1:] / chars), sum(map(bytes.isupper, words)) / n, len(_BARE.findall(text)) / n, len(_TAIL.findall(text)) / n, sum(map(eq, words, words[1:])) / n,
              (len(words) - len(set(words))) / n, (len(lines) - len(set(lines))) / max(len(lines), 1)]
    plain = [len(words) / max(len(lines), 1), (len(text) - kinds[0] - kinds[1]) / n, len(words)]
    return np.r_[np.log1p(200 * np.array(shares)), np.log1p(plain)].astype(np.float32)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def measurements(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for every row; x: float32 bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([measured(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, x binary")


def positives(labels: DataFrame) -> DataFrame:
    """The doc_ids of the trusted positives that may be learned from."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    return known.where("doc_id IS NOT NULL AND quality = 1").where(~held_out()).select("doc_id").distinct()


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float32).reshape(-1, len(MEASURES)).astype(float)
    return np.c_[np.ones(len(x)), x], batch.column(1).to_numpy(zero_copy_only=False).astype(bool)


def _summed(table: DataFrame, part, size: int) -> np.ndarray:
    """Sum over all rows of the vector of ``size`` numbers that ``part(x, positive)`` gives for a batch: one row per task, then per one of ``MERGERS``."""
    def totals(vectors: Iterator[np.ndarray]) -> pa.RecordBatch:
        total = np.zeros(size)
        for v in vectors:
            total += v
        return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield totals(part(*_rows(batch)) for batch in batches if batch.num_rows)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield totals(np.frombuffer(v, float) for batch in batches for v in batch.column(0).to_pylist())

    sums = table.mapInArrow(run, "v binary").repartition(MERGERS).mapInArrow(merge, "v binary").collect()
    return np.sum([np.frombuffer(r.v, float) for r in sums], axis=0)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Scale:
    """Brings measurements to mean 0 and deviation 1 over all distinct texts; a measurement that never varies becomes 0."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        self.mean, self.by = mean, np.where(deviation > 1e-9, 1 / np.maximum(deviation, 1e-9), 0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x[:, :1], (x[:, 1:] - self.mean) * self.by]


def _pass(table: DataFrame, scale: Scale, w: np.ndarray) -> dict:
    """Losses, gradients and second derivatives at ``w``, means over positives and over all."""
    d = len(w)

    def part(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        x = scale(x)
        g = x @ w
        p, s = x[positive], g[positive]
        out = [[len(s), len(g)]]
        for rows, z in ((p, s), (x, g)):
            q = _sigmoid(z)
            out += [[_softplus(-z).sum(), _softplus(z).sum()], rows.sum(0), rows.T @ q, (rows.T @ (rows * (q * (1 - q))[:, None])).ravel()]
        return np.concatenate([np.ravel(v) for v in out])

    v = _summed(table, part, 2 + 2 * (2 + 2 * d + d * d))
    n, at, sides = v[:2], 2, []
    for k in range(2):
        size = 2 + 2 * d + d * d
        u = v[at:at + size] / max(n[k], 1)
        sides.append({"as_pos": u[0], "as_neg": u[1], "x": u[2:2 + d], "xq": u[2 + d:2 + 2 * d], "h": u[2 + 2 * d:].reshape(d, d)})
        at += size
    return {"n": n, "pos": sides[0], "all": sides[1]}


def _descend(table: DataFrame, scale: Scale, ridge_each: float, terms) -> np.ndarray:
    """Damped Newton. ``terms(sums)`` gives risk, gradient, second derivatives, and whether to compare the risk with the step before."""
    w = np.zeros(len(MEASURES) + 1)
    ridge = np.r_[1e-9, np.full(len(MEASURES), ridge_each)]
    best, least, move = w, np.inf, None
    for _ in range(STEPS):
        risk, slope, bend, plain = terms(_pass(table, scale, w))
        risk += 0.5 * float(ridge @ (w * w))
        if risk < least - CLOSE * 1e-3:
            gain, best, least = least - risk, w, risk
            move = np.linalg.solve(bend + np.diag(ridge + 1e-9), slope + ridge * w)
            if plain and gain < CLOSE:
                break
        elif np.abs(move).max() < 1e-4:
            break
        else:
            move = move / 2
        w = best - move
    return best


def _against_all(sums: dict):
    pos, every = sums["pos"], sums["all"]
    return pos["as_pos"] + every["as_neg"], pos["xq"] - pos["x"] + every["xq"], pos["h"] + every["h"], True


def _non_negative(prior: float):
    def terms(sums: dict):
        pos, every = sums["pos"], sums["all"]
        rest = every["as_neg"] - prior * pos["as_neg"]
        risk = prior * pos["as_pos"] + max(0.0, rest)
        if rest >= 0:
            return risk, every["xq"] - prior * pos["x"], every["h"], True
        back = every["xq"] - prior * pos["xq"]  # gradient of the part that has become negative: it is raised again
        return risk, -back, every["h"], False

    return terms


def prior_of(pos: np.ndarray, every: np.ndarray) -> float:
    """Share of positives among all texts from the counts by bin of a score that rises with the class."""
    n, m = max(pos.sum(), 1), max(every.sum(), 1)
    p, q = np.cumsum(pos[::-1]) / n, np.cumsum(every[::-1]) / m
    slack = np.sqrt(np.log(4 / DELTA) / (2 * m)) + np.sqrt(np.log(4 / DELTA) / (2 * n))
    seen = p > 0
    if not seen.any():
        return 0.0
    at = np.argmin((q[seen] + 2 * slack) / p[seen])
    return float(np.clip(q[seen][at] / p[seen][at], 1e-3, 1 - 1e-3))


class Model:
    def __init__(self, scale: Scale | None, w: np.ndarray | None, prior: float = 0.0):
        self.scale, self.w, self.prior = scale, w, prior

    def scores(self, x: np.ndarray) -> np.ndarray:
        """``x``: rows of measurements with a leading one."""
        return np.zeros(len(x)) if self.w is None else _sigmoid(self.scale(x) @ self.w)


def fit(found: DataFrame, labels: DataFrame) -> Model:
    """``found``: what ``measurements`` gives."""
    marked = found.join(positives(labels).withColumn("positive", F.lit(True)), "doc_id", "left")
    table = stage(marked.groupBy("x").agg(F.max(F.coalesce("positive", F.lit(False))).alias("positive")), "pu-texts")
    d = len(MEASURES)
    sums = _summed(table, lambda x, y: np.r_[len(y), y.sum(), x[:, 1:].sum(0), (x[:, 1:] ** 2).sum(0)], 2 + 2 * d)
    if not sums[1]:
        return Model(None, None)
    mean = sums[2:2 + d] / sums[0]
    scale = Scale(mean, np.sqrt(np.maximum(sums[2 + d:] / sums[0] - mean ** 2, 0)))
    ridge = RIDGE / sums[1]
    first = _descend(table, scale, ridge, _against_all)

    def bins(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        k = np.minimum((_sigmoid(scale(x) @ first) * BINS).astype(int), BINS - 1)
        return np.r_[np.bincount(k[y], minlength=BINS), np.bincount(k, minlength=BINS)]

    counts = _summed(table, bins, 2 * BINS)
    prior = prior_of(counts[:BINS], counts[BINS:])
    return Model(scale, _descend(table, scale, ridge, _non_negative(prior)), prior)


def scored(found: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``found``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, len(MEASURES)).astype(float)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(np.c_[np.ones(len(x)), x]), pa.float64())], ["doc_id", "score"])

    return found.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Measures every text once, learns, and scores every row of ``docs``."""
    found = stage(measurements(docs), "pu-measurements")
    return scored(found, fit(found, labels))
