import random
from collections import defaultdict

from plateworks.llm import patience_lines as P
from tests.llm.fixtures import rows, table


def brute(data):
    """The documented rules, one document and one pair at a time."""
    order, last = {}, (1 << 63) - 1
    for d, t in data:
        if t is not None:
            order[t] = min(order.get(t, last), last if d is None else d)
    texts = sorted(order, key=lambda t: order[t])
    assert len(set(order.values())) == len(order)  # ties are broken by digest, which this does not copy
    holders = defaultdict(list)
    for t in texts:
        for line in dict.fromkeys(x for x in t.split("\n") if len(x) >= P.MIN_LINE):
            holders[line].append(t)
    out = {}
    for t in texts:
        partners = {holders[x][0] for x in t.split("\n") if len(x) >= P.MIN_LINE and 1 < len(holders[x]) <= P.RARE} - {t}
        mine, gone = t.split("\n"), set()
        for p in partners:
            gone |= set(P.aligned_blocks(p.split("\n"), mine, list(map(len, mine)), P.MIN_BLOCK))
        out[t] = gone
    return order, out


def expected(data):
    order, gone = brute(data)
    want = []
    for d, t in data:
        lines = t.split("\n") if t is not None else []
        lost = set() if t is None else gone[t]
        if t is not None and (d if d is not None else 1 << 62) > order[t] and sum(map(len, lines)) >= P.MIN_BLOCK:
            lost = set(range(len(lines)))
        want.append((d, None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in lost), len(lines), len(lost), sorted(lost)))
    return sorted(map(repr, want))


def made(seed, n=60):
    rnd = random.Random(seed)
    pool = ["line %d %s" % (i, "word " * rnd.randint(1, 12)) for i in range(40)]
    texts = []
    for _ in range(n):
        start = rnd.randrange(30)
        texts.append("\n".join(pool[start:start + rnd.randint(1, 9)] + rnd.choices(pool, k=rnd.randint(0, 3)) + ["own %f and more words" % rnd.random()]))
    return [(i, t) for i, t in enumerate(texts + rnd.sample(texts, 9))]


def test_equals_brute_force(spark):
    for data in (made(1), made(2)):
        df = table(spark, [(d, t, "en", "s", 0) for d, t in data], first="x", n_lines=1)
        got = P.deduplicated(df)
        assert sorted(map(repr, (tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_removed", "removed_lines").collect()))) == expected(data)


def test_awkward_rows(spark):
    df = table(spark)
    got = P.deduplicated(df).collect()
    assert len(got) == len(rows())
    assert all(r.text is None and r.n_lines == 0 for r in got if r.n_chars == 0 and r.text is None)
    assert P.deduplicated(table(spark, [])).count() == 0
    assert P.filtered(df).columns == df.columns


def test_big_group_of_near_copies_finds_its_first(spark):
    shared = [f"shared line number {k} of the common body with some words" for k in range(6)]
    data = [(i, "\n".join([f"head {i} is different in every document", *shared]), "en", "s", 0) for i in range(120)]
    got = {r.doc_id: r.n_removed for r in P.deduplicated(table(spark, data)).collect()}
    assert got[0] == 0 and all(got[i] == 6 for i in range(1, 120))


def test_patience_aligns_moved_and_repeated_lines():
    assert P.patience([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert P.patience([5, 1, 2, 5], [7, 1, 2, 8]) == [(1, 1), (2, 2)]
    assert P.patience([], [1]) == []
    assert P.patience([1, 1, 2], [2, 1, 1]) == [(2, 0)]


def line(k):
    return f"shared line number {k} of the common body with some words"


def removed(spark, texts, runs=True):
    return {r.doc_id: r.n_removed for r in P.deduplicated(table(spark, [(i, "\n".join(t), "en", "s", 0) for i, t in enumerate(texts)]), runs=runs).collect()}


def test_frequent_passage_goes_beside_rarer_shared_lines(spark):
    passage = [f"frequent passage, line {k}: " + "words " * 21 for k in range(3)]
    texts = [[*passage, "the first"]]
    for i in range(80):
        texts.append([*[f"line {k} that only the pair number {i // 2} shares" for k in range(4)][::1 - i % 2 * 2], *passage, f"own {i}"])
    for runs in (False, True):
        got = removed(spark, texts, runs)
        assert got[0] == 0 and all(got[i] >= 3 for i in range(1, 81))


def test_block_goes_whose_single_lines_stand_elsewhere_first(spark):
    texts = [[f"before {k}", line(k), f"after {k}"] for k in range(5)]
    block = [line(k) for k in range(5)]
    got = removed(spark, [*texts, ["head of b", *block, "tail of b"], ["head of c", *block, "tail of c"]])
    assert got == {i: 0 for i in range(6)} | {6: 5}


def test_passage_that_stands_twice_in_the_later_text_goes(spark):
    passage = [line(k) for k in range(6)]
    got = removed(spark, [["a", *passage, "b"], ["c", *passage, "d", *passage, "e"]])
    assert got == {0: 0, 1: 12}


def test_ordinary_alignment_is_longest(monkeypatch):
    rnd = random.Random(2)
    for held in (1 << 28, 1):
        monkeypatch.setattr(P, "HELD", held)
        for _ in range(300):
            a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(14))] for _ in range(2))
            t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
            got = P.common(a, b)
            assert len(got) == t[-1][-1] and all(a[i] == b[j] for i, j in got)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
