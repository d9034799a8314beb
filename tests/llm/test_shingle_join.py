import random

import numpy as np
import pytest

import corpus_pipeline
from plateworks.llm import shingle_join as S
from plateworks.llm import simhash
from tests.llm.fixtures import rows, table


def brute(data, words=5):
    """The rows that stay, as (doc_id, text), by comparing all pairs of rows."""
    rows = sorted({(d, t or "") for d, t, *_ in data if d is not None})
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode().split()
        sets.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or 100 * len(a & b) >= 80 * len(a | b)]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            least = min(root[i], root[j])
            changed |= root[i] != root[j]
            root[i] = root[j] = least
    return {row for row, r in zip(rows, root) if row[0] == rows[r][0]}


def got(df):
    return {(r.doc_id, r.text or "") for r in df.collect() if r.doc_id is not None}


def edited(seed, n, low, high, size=120):
    rnd = random.Random(seed)
    word = lambda: "w%d" % rnd.randrange(5000)
    out = []
    for _ in range(n):
        base = [word() for _ in range(rnd.randint(size // 2, size * 2))]
        copy = list(base)
        for i in rnd.sample(range(len(base)), round(len(base) * rnd.uniform(low, high))):
            copy[i] = word()
        out += [" ".join(base), " ".join(copy)]
    return out


@pytest.mark.parametrize("crowd", [1, 3, 64])
def test_equals_brute_force(spark, crowd):
    rnd = random.Random(3)
    base = edited(8, 1, 0, 0, 200)[0].split()
    texts = edited(7, 60, 0.0, 0.07)
    for _ in range(40):  # a crowd of which some reach each other only by way of others
        texts.append(" ".join("x%d" % rnd.randrange(999) if rnd.random() < 0.012 else w for w in base))
    data = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    rnd.shuffle(data)
    kept = got(S.one_of_each(table(spark, data), crowd=crowd))
    assert kept == brute(data)
    assert 0 < len(kept) < len(data) - 40


def _classes(spark, texts):
    named = S._named(table(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]))
    return S._signatures(named, S.WORDS, S.SIMILARITY).localCheckpoint(), named


def test_simhash_blocks_propose_the_closest_pairs(spark):
    texts = edited(2, 12, 0, 0.004, 800) + edited(4, 1, 0, 0)
    classes, _ = _classes(spark, texts)
    prints = {r.node.id: r.fp & (1 << 64) - 1 for r in classes.collect()}
    near = {(i, j) for i in prints for j in prints if i < j and bin(prints[i] ^ prints[j]).count("1") <= 2}
    found = {tuple(sorted((r.a.id, r.b.id))) for r in S._by_fingerprint(classes).collect()}
    assert len(near) >= 5 and found == near


def test_the_hamming_check_passes_pairs_at_the_similarity():
    rnd, beyond = np.random.default_rng(2), 0
    for _ in range(2000):
        n = int(rnd.integers(S.FEW, 300))
        common = -(-8 * n // 9)
        both = rnd.integers(-(1 << 63), (1 << 63) - 1, 2 * n - common)
        a, b = simhash.fingerprint_of(both[:n]), simhash.fingerprint_of(np.r_[both[:common], both[n:]])
        beyond += bin(a ^ b).count("1") > S.distance()
    assert beyond <= 2 and simhash.fingerprint_of(np.zeros(0, np.int64)) == 0


@pytest.mark.parametrize("block", [16, 256])
def test_a_crowd_that_does_not_hold_together_makes_no_pairs(spark, block):
    """120 texts at 0.5 to 0.8 from each other share bands, but few are linked: what is left is compared in blocks, not pair by pair."""
    rnd = random.Random(6)
    base = edited(9, 1, 0, 0, 150)[0].split()
    texts = [" ".join("y%d" % rnd.randrange(99999) if rnd.random() < 0.035 else w for w in base) for _ in range(120)]
    classes, named = _classes(spark, texts)
    found = S.links(classes, named, crowd=4, block=block)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    root = {r.node.id: r.root.id for r in S.components(found).collect()}
    want = brute([(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    assert {i for i in range(120) if root.get(i, i) == i} == {i for i, _ in want}
    assert 20 < len(want) < 120


def test_stage_drops_near_copies_that_simhash_at_two_bits_keeps(spark):
    data = [(i, t, "en", "s", 0) for i, t in enumerate(edited(1, 40, 0.015, 0.02))]
    df = table(spark, data)
    want = brute(data)
    assert len(want) <= 45
    assert got(corpus_pipeline.near_dedup(spark, df, "")) == want
    assert simhash.one_of_each(df).count() > len(want) + 10


def test_awkward_rows(spark):
    df = table(spark)
    kept = S.one_of_each(df)
    assert kept.columns == df.columns
    assert kept.where("doc_id is null").count() == df.where("doc_id is null").count()
    assert got(kept) == brute(rows())
    assert S.one_of_each(table(spark, [])).count() == 0


def test_rows_of_one_doc_id_are_judged_by_their_own_text(spark):
    a, near, other = edited(5, 1, 0.005, 0.005)[0], None, edited(6, 1, 0, 0)[0]
    near = " ".join(["changed", *a.split()[1:]])
    data = [(3, a, "en", "s", 0), (5, near, "en", "s", 0), (5, other, "en", "s", 0), (5, other, "en", "s", 0), (8, None, "en", "s", 0), (9, "", "en", "s", 0)]
    kept = S.one_of_each(table(spark, data, node=1, gone="x", keys=2, least=3))
    assert sorted((r.doc_id, r.text, r.node, r.gone, r["keys"], r.least) for r in kept.collect()) == sorted(
        [(3, a, 1, "x", 2, 3), (5, other, 1, "x", 2, 3), (5, other, 1, "x", 2, 3), (8, None, 1, "x", 2, 3)], key=str)


def test_bands_miss_no_more_than_stated():
    """Pairs of similarity 0.8 and more that share no band: about ``MISS`` of them."""
    rnd = np.random.default_rng(1)
    missed = 0
    for _ in range(2000):
        n = int(rnd.integers(20, 400))
        common = -(-8 * n // 9)  # least number of common hashes for 0.8
        both = rnd.integers(-(1 << 63), (1 << 63) - 1, 2 * n - common)
        a, b = np.sort(both[:n]), np.sort(np.r_[both[:common], both[n:]])
        missed += not set(S.band_keys(a, S.bands())) & set(S.band_keys(b, S.bands()))
    assert missed == 0


def test_a_very_long_text_is_read_in_pieces():
    found = np.arange(3 * S.PIECE + 17, dtype=np.int64) * 0x9E3779B97F4A7C1 % (1 << 61)
    whole, piece = S.band_keys(found, 4), S.PIECE
    try:
        S.PIECE = 100
        assert (S.band_keys(found, 4) == whole).all()
    finally:
        S.PIECE = piece
