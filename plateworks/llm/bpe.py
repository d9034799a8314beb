"""Byte-level BPE encoding and decoding with the tiktoken library.

The rank file is a parameter and is read once per Python worker. Long texts are cut before white space that follows
something else than white space: every match of the pre-splitting pattern ends there, so the pieces encode to
exactly the ids of the whole. Ids are decoded to raw bytes, never through replacement characters.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a text that are handed to the library at once.
PIECE = 50_000
#: Characters (encoding) or ids (decoding) per Arrow batch sent back.
BATCH = 1_000_000


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("from_file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cuts at the first blank or line feed after ``size`` characters that follows a character other than white space."""
    start = 0
    while len(text) - start > size:
        at = start + size
        while at < len(text) and not (text[at] in " \n" and not text[at - 1].isspace()):
            at += 1
        yield text[start:at]
        start = at
    yield text[start:]


def encode_text(text: str | None, rank_file: str, pattern: str, size: int = PIECE) -> np.ndarray:
    enc = encoding(rank_file, pattern)
    if not text:
        return np.empty(0, np.int32)
    if len(text) <= size:
        return np.asarray(enc.encode_ordinary(text), np.int32)
    return np.concatenate([np.asarray(enc.encode_ordinary(p), np.int32) for p in pieces(text, size)])


def _slices(weights: list[int], most: int) -> Iterator[slice]:
    start = total = 0
    for i, w in enumerate(weights):
        if i > start and total + w > most:
            yield slice(start, i)
            start, total = i, 0
        total += w
    if start < len(weights):
        yield slice(start, len(weights))


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column ``ids`` (array of int): the ranks of each text's tokens, without special tokens.

    A null or empty text gets an empty array; repeated rows are encoded each. A column named like ``ids`` is replaced.
    """
    docs = docs.drop(ids)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            for part in _slices([1 + (v or 0) for v in pa.compute.binary_length(texts).to_pylist()], BATCH):
                got = [encode_text(t.as_py(), rank_file, pattern) for t in texts[part.start:part.stop]]
                offsets = np.cumsum([0, *map(len, got)]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(got)))
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*rows.columns, column], [*batch.schema.names, ids])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False))]))


def decode(encoded: DataFrame, rank_file: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with a binary column ``decoded``: the bytes of the ids. Null or empty ids give empty bytes."""
    encoded = encoded.drop(decoded)
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            lists = batch.column(at)
            for part in _slices([1 + (v or 0) for v in pa.compute.list_value_length(lists).to_pylist()], BATCH):
                got = [enc.decode_bytes(x.values.to_pylist()) if x.is_valid else b"" for x in lists[part.start:part.stop]]
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(got, pa.binary())], [*batch.schema.names, decoded])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(decoded, T.BinaryType())]))


def digests(decoded: DataFrame) -> DataFrame:
    """Per row doc_id, number of ids, SHA-256 of the decimal ids joined by one space, SHA-256 of the decoded bytes."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
