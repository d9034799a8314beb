import hashlib
import math
import random

import numpy as np
import pytest

from plateworks.llm import heap_clusters as H

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k=40, rounds=5, size=64):
    def whole(x):
        return 256 * int(x) if abs(x) > 1e15 else math.floor(256 * x)

    vs = [(i, [whole(x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    vs.sort(key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cs = [v for _, v in vs[:k]]

    def assign():
        ds = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in cs] for _, v in vs]
        return [(d.index(min(d)), min(d)) for d in ds]

    for _ in range(rounds):
        own = assign()
        for c in range(len(cs)):
            mine = [v for (a, _), (_, v) in zip(own, vs) if a == c]
            if mine:
                cs[c] = [sum(col) // len(mine) for col in zip(*mine)]
    own = assign()
    inertia = {c: sum(d for a, d in own if a == c) for c in range(len(cs))}
    fit = lambda n: n if n < 2 ** 63 else None
    return sorted(((i, a, fit(d), fit(inertia[a]), fit(sum(inertia.values())), hashlib.sha256(",".join(map(str, cs[a])).encode()).hexdigest()) for (a, d), (i, _) in zip(own, vs)), key=repr)


def cloud(seed, n, size, spread=0.3):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(0, 1, (5, size))
    return [(i, (centres[rnd.integers(5)] + rnd.normal(0, spread, size)).tolist(), 0) for i in range(n)]


def check(spark, rows, k, size, rounds=5):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS block", "'x' AS cluster", "0 AS distance").repartition(3)
    got = H.clustered(df, k, rounds, size)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, k, rounds, size)


@pytest.mark.parametrize("seed, n, k, size, spread", [(1, 300, 7, 4, 0.3), (2, 200, 40, 3, 2.0), (3, 60, 5, 64, 0.1)])
def test_against_brute_force(spark, seed, n, k, size, spread):
    check(spark, cloud(seed, n, size, spread), k, size)


def test_awkward_rows_ties_and_copies(spark):
    rnd = random.Random(5)
    rows = [(i, [float(rnd.randrange(-2, 3)) / 256, 0.0], None) for i in range(80)] + [(500 + i, [0.5, -0.25], 1) for i in range(60)]
    rows += [(7, [1.0, 1.0], 0), (7, [1.0, 1.0], 0), (None, [0.0, 3.0], 0), (None, None, None), (1, None, 0), (2, [], 0), (3, [1.0], 0), (4, [1.0, None], 0), (5, [float("nan"), 1.0], 0), (6, [float("inf"), 1.0], 0), (8, [-0.001, 0.001], 0)]
    check(spark, rows, 6, 2)


def test_large_components_stay_exact(spark):
    rows = [(i, [x, -x / 3], 0) for i, x in enumerate([1e4, 1.1e4, 3e5, 5e5, -5e5, 6e5, 1e9, 1.5e9, 2 ** 60 + 0.0, 1e30, -1e30, 3e38, 1e300, 1.7e308, 5e-324, 0.0])]
    check(spark, rows, 4, 2)


def test_few_vectors_and_none(spark):
    check(spark, cloud(4, 3, 64), 40, 64)
    check(spark, cloud(4, 1, 64), 40, 64)
    assert H.clustered(spark.createDataFrame([(1, [1.0], 0)], SCHEMA)).count() == 0


def test_bounds_spare_rescans_and_heaps_are_ordered(spark):
    rows = cloud(9, 500, 8, 0.05)
    work = H.Clustering(spark.createDataFrame(rows, SCHEMA), 5, 8)
    work.run()
    assert work.rescanned[0] == 500 and sum(work.rescanned[2:]) < 500
    heaps = H.Heaps(2)
    heaps.push(np.arange(6), np.array([0, 0, 0, 1, 1, 1]), np.array([5.0, 1, 3, 2, 9, 4]), np.array([0.0, 10.0]))
    again = H.Heaps(2, *(np.frombuffer(b, t) for b, t in zip(heaps.packed(), (float, np.int32, np.int32))))
    gone, was = again.expired(np.array([3.0, 12.5]), 0.0)
    assert gone.tolist() == [1, 2, 3] and was.tolist() == [0, 0, 1] and again.clusters(6).tolist()[4:] == [1, 1]
