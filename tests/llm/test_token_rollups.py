import public_tokenizers
import pytest

from plateworks.llm import bpe, token_rollups as R
from tests.llm.fixtures import rows, table

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def events(spark, data):
    return spark.createDataFrame(data, R.EVENT)


def totals(df):
    return sorted((r.source or "", r.lang or "", r.version, r.docs, r.tokens) for r in df.collect())


BATCHES = [
    [("insert", 1, "a", "en", "v1", 10), ("insert", 2, "a", "en", "v1", 5), ("insert", 2, "a", "en", "v2", 7), ("insert", 3, None, "de", "v1", None), ("insert", None, "b", None, "v1", 4), ("insert", 2, "a", "en", "v1", 5)],
    [("revise", 1, "a", "en", "v1", 12), ("revise", 2, "b", "fr", "v1", 6), ("revise", 9, "c", "es", "v1", 3), ("delete", 77, "a", "en", "v1", 0)],
    [("delete", 1, None, None, "v1", None), ("delete", 2, None, None, "v2", 0), ("insert", 3, "d", "de", "v1", 8), ("delete", None, None, None, "v1", 0)],
]
WANT = [
    [("", "de", "v1", 1, 0), ("a", "en", "v1", 2, 15), ("a", "en", "v2", 1, 7), ("b", "", "v1", 1, 4)],
    [("", "de", "v1", 1, 0), ("a", "en", "v1", 1, 12), ("a", "en", "v2", 1, 7), ("b", "", "v1", 1, 4), ("b", "fr", "v1", 1, 6), ("c", "es", "v1", 1, 3)],
    [("b", "fr", "v1", 1, 6), ("c", "es", "v1", 1, 3), ("d", "de", "v1", 1, 8)],
]


def test_signed_batches_and_repeated_commits(spark, tmp_path):
    rollup = R.Rollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0
    for number, (batch, want) in enumerate(zip(BATCHES, WANT), 1):
        assert totals(rollup.commit(number, events(spark, batch))) == want
        assert totals(rollup.commit(number, events(spark, batch))) == want
    again = R.Rollup(spark, str(tmp_path / "r"))  # a new process finds what is committed
    assert again.batches() == [1, 2, 3] and totals(again.commit(2, events(spark, BATCHES[0]))) == WANT[-1]
    standing = sorted((r.doc_id, r.tokens) for r in again.standing().collect())
    assert standing == [(2, 6), (3, 8), (9, 3)]
    assert totals(again.commit(4, events(spark, []))) == WANT[-1]


def test_a_failed_attempt_is_replaced(spark, tmp_path, monkeypatch):
    rollup = R.Rollup(spark, str(tmp_path / "r"))
    rollup.commit(1, events(spark, BATCHES[0]))
    monkeypatch.setattr(R.Rollup, "_roll", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        rollup.commit(2, events(spark, BATCHES[2]))
    monkeypatch.undo()
    assert totals(rollup.totals()) == WANT[0]
    assert totals(rollup.commit(2, events(spark, BATCHES[1]))) == WANT[1]


def test_earlier_numbers_are_refused(spark, tmp_path):
    rollup = R.Rollup(spark, str(tmp_path / "r"))
    rollup.commit(5, events(spark, BATCHES[0]))
    with pytest.raises(ValueError):
        rollup.commit(4, events(spark, BATCHES[1]))


def test_counts_equal_brute_force(spark):
    data = rows()
    df = table(spark, data, tokens="clash", version=1)
    enc = bpe.encoding(RANKS, PATTERN)
    got = sorted(map(repr, (tuple(r) for r in R.bpe_counts(df, "b", RANKS, PATTERN).select("doc_id", "tokens").collect())))
    assert got == sorted(repr((d, len(enc.encode_ordinary(t or "")))) for d, t, *_ in data)
    got = sorted(map(repr, (tuple(r) for r in R.word_counts(df, "w").select("doc_id", "tokens").collect())))
    assert got == sorted(repr((d, len((t or "").encode().split()))) for d, t, *_ in data)
    assert R.bpe_counts(table(spark, []), "b", RANKS, PATTERN).count() == 0
