"""Both index-based substring operators against brute force, whichever way their windows go."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from plateworks.llm import fm_substring, suffix_induced, windows
from tests.llm.fixtures import rows, table

LAST = (1 << 63) - 1


def brute(data, split, join, L, within):
    """Rows (doc_id, n, n_removed, n_spans, kept_sha256)."""
    texts = [(LAST if d is None else d, split((t or "").encode())) for d, t, *_ in data]
    least = {}
    for d, s in texts:
        for i in range(len(s) - L + 1):
            w = s[i:i + L] if isinstance(s, bytes) else tuple(s[i:i + L])
            least[w] = min(d, least.get(w, d))
    out = []
    for (d, s), (doc, *_) in zip(texts, data):
        seen, gone = set(), set()
        for i in range(len(s) - L + 1):
            w = s[i:i + L] if isinstance(s, bytes) else tuple(s[i:i + L])
            if least[w] < d or within and w in seen:
                gone.update(range(i, i + L))
            seen.add(w)
        spans = sum(i - 1 not in gone for i in gone)
        kept = [s[i:i + 1] if isinstance(s, bytes) else s[i] for i in range(len(s)) if i not in gone]
        out.append((doc, len(s), len(gone), spans, hashlib.sha256(join.join(kept)).hexdigest()))
    return out


def made(seed):
    rnd = random.Random(seed)
    words = ["w%d" % i for i in range(30)]
    pool = [" ".join(rnd.choices(words, k=rnd.randint(5, 60))) for _ in range(12)]
    texts = [" ".join(rnd.choice(pool) if rnd.random() < 0.6 else " ".join(rnd.choices(words, k=rnd.randint(1, 30))) for _ in range(rnd.randint(1, 6))) for _ in range(50)]
    texts += ["to " * 200, "to be " * 90, "=" * 700, texts[0], texts[1]]
    return [(rnd.randrange(70), t, "en", "s", 0) for t in texts]


CASES = [rows(), made(1), made(2)]


def sorted_rows(got):
    return sorted(map(repr, map(tuple, got)))


@pytest.mark.parametrize("way", ["shards", "hot", "small shards"])
def test_bytes_equal_brute_force(spark, monkeypatch, way):
    monkeypatch.setattr(windows, "HOT", 3 if way == "hot" else windows.HOT)
    monkeypatch.setattr(windows, "SHARD_BYTES", 4000 if way == "small shards" else windows.SHARD_BYTES)
    for data in CASES if way == "shards" else CASES[1:2]:
        found = suffix_induced.digest(suffix_induced.deduplicated(table(spark, data, tag=1, packed="x", start=2))).collect()
        assert sorted_rows(found) == sorted_rows(brute(data, lambda b: b, b"", 100, True))


@pytest.mark.parametrize("way", ["shards", "hot", "small shards"])
def test_words_equal_brute_force(spark, monkeypatch, way):
    monkeypatch.setattr(windows, "HOT", 3 if way == "hot" else windows.HOT)
    monkeypatch.setattr(windows, "SHARD_BYTES", 4000 if way == "small shards" else windows.SHARD_BYTES)
    for data in CASES if way == "shards" else CASES[1:2]:
        found = fm_substring.digest(fm_substring.deduplicated(table(spark, data, tag=1, packed="x", start=2))).collect()
        assert sorted_rows(found) == sorted_rows([(d, n, r, k) for d, n, r, _, k in brute(data, bytes.split, b" ", 13, False)])


def test_empty_table(spark):
    assert suffix_induced.deduplicated(table(spark, [])).count() == 0
    assert fm_substring.deduplicated(table(spark, [])).count() == 0


def test_anchors_depend_on_the_window_alone():
    rnd = random.Random(4)
    for symbols, text in ((suffix_induced.BYTES, bytes(rnd.randrange(97, 100) for _ in range(windows.PIECE + 5000))), (fm_substring.WORDS, b" ".join(b"%d" % rnd.randrange(9) for _ in range(3000)))):
        s = symbols.of(text)
        hashes, starts, counts = symbols.runs(s)
        assert counts.sum() == len(s) - symbols.L + 1
        each = np.repeat(hashes, counts)
        order = np.repeat(starts, counts) + np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
        assert (order == np.arange(len(each))).all()
        for i in [0, 1, 77, len(each) - 1, *rnd.sample(range(len(each)), 50), *range(max(0, windows.PIECE - 105), min(len(each), windows.PIECE + 5))]:
            assert symbols.runs(s[i:i + symbols.L])[0][0] == each[i]


def test_suffix_arrays(monkeypatch):
    rnd = random.Random(3)
    for waves in (1024, 0):
        monkeypatch.setattr(suffix_induced, "WAVES", waves)
        for n in [*range(30), 500]:
            for k in (1, 2, 5, 200):
                b = bytes(rnd.randrange(k) + 50 for _ in range(n))
                x = np.frombuffer(b, np.uint8)
                sa = suffix_induced.suffix_array(x)
                assert sa.tolist() == sorted(range(n), key=lambda i: b[i:])
                if n > 1:
                    shared = suffix_induced.permuted_prefixes(x, sa, 20)
                    for i, j in zip(sa.tolist(), sa.tolist()[1:]):
                        want = next((m for m in range(20) if b[i + m:i + m + 1] != b[j + m:j + m + 1] or m + max(i, j) >= n), 20)
                        assert shared[j] == want


def test_suffix_arrays_over_large_alphabets():
    """What the names of the recursion look like: many symbols, and passages of one or two symbols that repeat for long."""
    rnd = random.Random(11)
    for n in (1, 40, 1500):
        x = [rnd.randrange(1, 3000) for _ in range(n)]
        x = [*x, *[7] * n, *x[::-1], *[2999, 5] * (n // 2), *x[:n // 2], *range(1, n), *range(n, 1, -1), *[7] * n, 0]
        assert suffix_induced._sorted_suffixes(np.array(x), 3001).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def test_large_alphabets_are_not_gone_through_entry_by_entry():
    """A suffix array costs as much as two or three plain loops twice over the entries; entry by entry it cost as much as eighteen."""
    n = 400_000
    s = np.r_[np.random.default_rng(5).integers(1, n // 3, n), 0]
    small = suffix_induced._smaller(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1

    def induced():
        suffix_induced._sorted_suffixes(s, n // 3)

    def loop():
        text, places, out = s.tolist(), [0] * (n // 3), [0] * len(s)
        for _ in range(2):
            for p in range(len(s)):
                c = text[p]
                places[c] += 1
                out[p] = places[c]

    def spent(f):
        best = []
        for _ in range(3):
            start = time.process_time()
            f()
            best.append(time.process_time() - start)
        return min(best)

    assert len(lms) > n // 4
    assert spent(induced) < 7 * spent(loop)


@pytest.mark.parametrize("symbols", [suffix_induced.BYTES, fm_substring.WORDS])
def test_joined_texts_have_the_runs_of_each(monkeypatch, symbols):
    """Texts are hashed many at once; none, short and long ones keep their own runs and hashes."""
    rnd = random.Random(9)
    texts = [b"", b" ".join(b"%d" % rnd.randrange(50) for _ in range(700)), b"x", b"", b"a" * 99, b"b" * 100, *[t.encode() for _, t, *_ in made(3)], b""]
    for piece in (windows.PIECE, 500):
        monkeypatch.setattr(windows, "PIECE", piece)
        for lo, hi in [(0, len(texts)), (1, 2), (0, 1), (2, 9), (5, len(texts))]:
            flat, ends = symbols.joined(pa.array([b"before", *texts], pa.binary()).slice(lo + 1, hi - lo))
            each = [symbols.of(t) for t in texts[lo:hi]]
            assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [s.tolist() for s in each]
            want = [(k, *run) for k, s in enumerate(each) for run in zip(*(x.tolist() for x in symbols.runs(s)))]
            assert list(zip(*(x.tolist() for x in symbols.runs_of(flat, ends)))) == want
            at = np.array([ends[k] + start for k, _, start, _ in want], np.int64)
            assert symbols.hashes_at(flat, at).tolist() == [int(symbols.windows(each[k], start, 1)[0][0]) for k, _, start, _ in want]


def test_matching_statistics():
    rnd = random.Random(8)
    text, query = ([rnd.randrange(4) for _ in range(n)] for n in (300, 200))
    index = fm_substring.FMIndex(np.array(text, np.uint64), 16)
    ends = np.arange(1, len(query) + 1)
    length, low, high = index.statistics(index.numbers(np.array([*query[:-1], 9], np.uint64)), ends, 16)
    query[-1] = 9
    for e, n, a, b in zip(ends.tolist(), length.tolist(), low.tolist(), high.tolist()):
        def holds(k):
            return k <= e and any(text[i:i + k] == query[e - k:e] for i in range(len(text) - k + 1))
        assert holds(n) and (n == 16 or not holds(n + 1))
        if n:
            assert sorted(index.order[a:b].tolist()) == [i for i in range(len(text)) if text[i:i + n] == query[e - n:e]]
