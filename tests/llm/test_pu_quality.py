import zlib

import numpy as np
import pytest

from plateworks.llm import pu_quality as Q
from tests.llm.fixtures import rows, table

LABELS = "doc_id long, quality int"


@pytest.mark.parametrize("text, measure, share", [
    (b"AB cd EF", "shouted_words", 2 / 3), (b"a | b || c", "bare_words", 2 / 5), (b"one### two. three!!", "tailed_words", 2 / 3), (b"a a b b b c", "echoed_words", 3 / 6), (b"a b a b", "repeated_words", 2 / 4),
    (b"x y\nx y\n\nz", "repeated_lines", 1 / 3), (b"ab12", "digit", 2 / 4), ("é".encode(), "beyond", 1), (b"#*a|", "sign", 2 / 4), (b"#*a|", "bar", 1 / 4)])
def test_measurements(text, measure, share):
    assert Q.measured(text)[Q.MEASURES.index(measure)] == np.float32(np.log1p(200 * share))


def test_null_and_empty_texts_measure_nothing():
    assert not Q.measured(None).any() and not Q.measured(b"").any()
    assert Q.measured(b"word " * 400_000)[-1] == np.float32(np.log1p(400_000))


def test_every_row_is_scored_as_the_model_says(spark):
    data = rows()
    d = len(Q.MEASURES)
    model = Q.Model(Q.Scale(np.linspace(0, 1, d), np.linspace(0, 2, d)), np.linspace(-1, 1, d + 1), 0.5)
    got = sorted(map(repr, map(tuple, Q.scored(Q.measurements(table(spark, data, score="x", x=1)), model).collect())))
    want = []
    for i, t, *_ in data:
        x = Q.measured(None if t is None else t.encode()).astype(float)
        g = -1.0 + sum(((x[j] - j / (d - 1)) / (2 * j / (d - 1)) if j else 0.0) * (-1 + 2 * (j + 1) / d) for j in range(d))
        score = 1 / (1 + np.exp(-min(max(g, -40), 40)))
        want.append((i, i is not None and zlib.crc32(str(i).encode()) % 3 == 1, round(float(score), 9), int(score >= 0.5)))
    rounded = sorted(repr((r.doc_id, r.held_out, round(r.score, 9), r.predicted)) for r in Q.scored(Q.measurements(table(spark, data)), model).collect())
    assert rounded == sorted(map(repr, want)) and len(got) == len(rounded)
    assert Q.scored(Q.measurements(table(spark, [])), model).count() == 0


def test_only_positives_of_rows_that_may_be_learned(spark):
    labels = spark.createDataFrame([(i, q) for i in range(40) for q in (0, 1)] + [(None, 1), (50, None), (51, 0)], LABELS)
    assert {r.doc_id for r in Q.positives(labels).collect()} == {i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1}


def test_without_positives_scores_are_zero(spark):
    out = Q.classified(table(spark, quality=1), spark.createDataFrame([(None, 1), (3, None), (3, 0)], LABELS)).collect()
    assert len(out) == len(rows()) and {(r.score, r.predicted) for r in out} == {(0.0, 0)}


def test_prior_of_mixed_classes():
    rnd = np.random.default_rng(3)
    pos, neg = rnd.normal(0.7, 0.1, 20_000), rnd.normal(0.3, 0.1, 20_000)
    for prior in (0.2, 0.5, 0.9):
        n = int(20_000 * prior)
        counts = [np.histogram(x.clip(0, 1), 200, (0, 1))[0] for x in (pos, np.r_[pos[:n], neg[:20_000 - n]])]
        assert abs(Q.prior_of(*counts) - prior) < 0.04


def _plain(x, y, prior, ridge, steps=4000):
    """The non-negative risk by plain gradient descent over all rows at once; the weights of the least risk."""
    w, best = np.zeros(x.shape[1]), (np.inf, None)
    softplus = lambda z: np.logaddexp(0, z)
    for _ in range(steps):
        g = x @ w
        q = 1 / (1 + np.exp(-g))
        p = y > 0
        rest = softplus(g).mean() - prior * softplus(g[p]).mean()
        risk = prior * softplus(-g[p]).mean() + max(0, rest) + 0.5 * ridge @ (w * w)
        if risk < best[0]:
            best = (risk, w.copy())
        every, pos = x.T @ q / len(x), x[p].T @ q[p] / p.sum()
        slope = every - prior * x[p].mean(0) + ridge * w if rest >= 0 else prior * pos - every
        w = w - 0.5 * slope
    return best


def test_fit_finds_the_least_non_negative_risk(spark):
    rnd = np.random.default_rng(8)
    n, d = 600, len(Q.MEASURES)
    good = rnd.random(n) < 0.6
    x = rnd.normal(0, 1, (n, d)).astype(np.float32)
    x[:, 0] += np.where(good, 1.5, -1.5)
    y = good & (rnd.random(n) < 0.5)
    df = spark.createDataFrame([(bytearray(r.tobytes()), bool(v)) for r, v in zip(x, y)], "x binary, positive boolean").repartition(3)
    scale = Q.Scale(np.zeros(d), np.ones(d))
    w = Q._descend(df, scale, 0.01, Q._non_negative(0.6))
    ridge = np.r_[1e-9, np.full(d, 0.01)]
    full = np.c_[np.ones(n), x.astype(float)]
    sums = Q._pass(df, scale, w)
    risk = Q._non_negative(0.6)(sums)[0] + 0.5 * ridge @ (w * w)
    assert risk <= _plain(full, y, 0.6, ridge)[0] + 2e-3
    assert ((full @ w > 0) == good).mean() > 0.85


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = Q.classified(docs, labels).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.predicted for r in found if r.quality == q] for q in (1, 0))
    assert len(bad) > 150 and sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)
