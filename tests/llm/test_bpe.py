import hashlib

import public_tokenizers
import pytest

from plateworks.llm import bpe
from tests.llm.fixtures import rows, table

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.mark.parametrize("text", ["it's  a   test\n\n\nof  spaces   and 12 3!! x" * 50, "x" * 700, " " * 500 + "a", "é ñ 日本 \U0001f600 " * 60, "a\n b \n\nc\t d" * 80])
def test_pieces_encode_as_the_whole(text):
    whole = bpe.encoding(RANKS, PATTERN).encode_ordinary(text)
    for size in (1, 7, 64):
        assert "".join(bpe.pieces(text, size)) == text
        assert bpe.encode_text(text, RANKS, PATTERN, size).tolist() == whole


def test_round_trip_of_every_row(spark):
    data = rows()
    enc = bpe.encoding(RANKS, PATTERN)
    out = bpe.digests(bpe.decode(bpe.encode(table(spark, data, ids="clash", decoded=1), RANKS, PATTERN), RANKS, PATTERN))
    got = sorted(map(repr, map(tuple, out.collect())))
    want = []
    for d, t, *_ in data:
        ids = enc.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(map(repr, want))


def test_empty_table(spark):
    assert bpe.decode(bpe.encode(table(spark, []), RANKS, PATTERN), RANKS, PATTERN).count() == 0
