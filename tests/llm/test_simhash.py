import random

import xxhash

from plateworks.llm import simhash
from plateworks.llm.components import components
from tests.llm.fixtures import rows, table


def brute(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def linked(values):
    root = {v: v for v in values}
    while True:
        new = {v: min(root[u] for u in values if (u ^ v).bit_count() <= 2) for v in values}
        if new == root:
            return root
        root = new


def test_fingerprints_and_components_equal_brute_force(spark):
    data = rows()
    got = simhash.digest(simhash.near_duplicates(table(spark, data, fp=3, first="x"))).collect()
    fps = [(d, brute(t)) for d, t, *_ in data]
    root = linked({f for _, f in fps})
    smallest = {}
    for d, f in fps:
        if d is not None:
            smallest[root[f]] = min(d, smallest.get(root[f], d))
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((d, f"{f:016x}", smallest.get(root[f]))) for d, f in fps)
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_crowded_blocks_lose_no_component(spark):
    rnd = random.Random(5)
    centre = rnd.getrandbits(64)
    values = {centre ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(150)} | {rnd.getrandbits(64) for _ in range(50)}
    values |= {v ^ (3 << 7) for v in list(values)[:40]}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = linked(values)
    for crowd in (4, 1000):
        found = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in components(simhash.links(df, crowd=crowd)).collect()}
        groups = lambda root: sorted(sorted(v for v in values if root.get(v, v) == g) for g in set(root.values()) | {v for v in values if v not in root})
        assert groups(found) == groups(want)


def test_components_of_a_chain_a_star_and_nothing(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_keeps_rows_without_an_id(spark):
    df = table(spark)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert kept.where("doc_id is null").count() == df.where("doc_id is null").count()
