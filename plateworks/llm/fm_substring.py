"""Word-level substring deduplication with an FM-index per shard.

``windows`` routes the runs that may repeat to shards. A shard's distinct runs, as word numbers, are indexed: their BWT
is a wavelet matrix of packed bits with block counts. The runs are then streamed against the index: backward search
gives the matching statistics (how far to the left a match reaches from each end) with the interval of the suffix array,
and each position that reaches the threshold reports its interval, hence the documents that hold the same words.

A null text has no words. See ``windows`` for order, ties, repeated rows and null ids. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plateworks.llm.windows import Symbols, merged, unpack, with_removals

WORDS = Symbols(words=True, L=13, m=4, within=False)

#: Positions searched at once.
STREAM = 1 << 15


class Bits:
    """A packed bit vector with ranks."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.r_[packed, np.zeros(16 - len(packed) % 8, np.uint8)].view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int32)].astype(np.int32)
        self.ones = int(np.count_nonzero(bits))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


def _suffix_order(numbers: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first ``depth`` symbols or more, by doubling; the end counts as smallest."""
    rank, k = numbers.astype(np.int64), 1
    while True:
        key = rank * (len(numbers) + 2)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key)
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        k *= 2
        if k >= depth or k >= len(numbers) or rank[order[-1]] == len(numbers) - 1:
            return order


class FMIndex:
    """Backward search over integers; patterns of up to ``depth`` symbols."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        self.values, numbers = np.unique(text, return_inverse=True)
        numbers = np.r_[numbers + 1, 0]  # the end is the smallest symbol
        self.order = _suffix_order(numbers, depth)
        bwt = numbers[self.order - 1]
        self.first = np.r_[0, np.cumsum(np.bincount(numbers, minlength=len(self.values) + 1))]
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(int(len(self.values)).bit_length() - 1, -1, -1):
            bit = (bwt >> shift) & 1 == 1
            self.levels.append((shift, Bits(bit), len(bwt) - int(np.count_nonzero(bit))))
            bwt = np.r_[bwt[~bit], bwt[bit]]
        symbols = np.arange(len(self.values) + 1)
        self.base = self.first[:-1] - self._down(symbols, np.zeros(len(symbols), np.int64))

    def _down(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((symbols >> shift) & 1 == 1, zeros + ones, i - ones)
        return i

    def numbers(self, symbols: np.ndarray) -> np.ndarray:
        """The index's numbers of symbols; 0 for one that it doesn't hold."""
        at = np.minimum(np.searchsorted(self.values, symbols), len(self.values) - 1)
        return np.where(self.values[at] == symbols, at + 1, 0)

    def extend(self, low: np.ndarray, high: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns that begin with one more symbol; empty ones for symbols that don't occur."""
        both = self._down(np.r_[symbols, symbols], np.r_[low, high])
        low, high = both[:len(low)] + self.base[symbols], both[len(low):] + self.base[symbols]
        return low, np.where(symbols > 0, high, low)

    def statistics(self, numbers: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per end (exclusive): the length up to ``most`` of the longest match that ends there, and its interval."""
        length = np.zeros(len(ends), np.int64)
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.order), np.int64)
        active = np.arange(len(ends))
        for k in range(1, most + 1):
            active = active[ends[active] >= k]
            a, b = self.extend(low[active], high[active], numbers[ends[active] - k])
            found = b > a
            active = active[found]
            low[active], high[active] = a[found], b[found]
            length[active] = k
        return length, low, high


def equal_windows(text: np.ndarray, heads: np.ndarray, at: np.ndarray, symbols: Symbols) -> np.ndarray:
    """A number for each window start in ``at``: the beginning of its interval. Equal numbers are equal windows."""
    index = FMIndex(text, symbols.L)
    numbers = index.numbers(text)
    out = np.empty(len(at), np.int64)
    for k in range(0, len(at), STREAM):
        length, low, _ = index.statistics(numbers, at[k:k + STREAM] + symbols.L, symbols.L)
        # a window is part of the index, so every end reaches the threshold
        assert length.min() == symbols.L
        out[k:k + STREAM] = low
    return out


def deduplicated(docs: DataFrame, symbols: Symbols = WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, starts and ends of the removed word spans, and kept (the words left, joined by one space)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, out = batch.slice(at, 500), []
                for doc, blob, a, b in zip(*part.columns):
                    words = unpack(blob.as_py()).split()
                    spans = merged(a.as_py() or [], b.as_py() or [], len(words), symbols.L)
                    kept = [w for x, y in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(words)]) for w in words[x:y]]
                    out.append((doc.as_py(), len(words), [s for s, _ in spans], [e for _, e in spans], b" ".join(kept)))
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], ["doc_id", "n_words", "starts", "ends", "kept"])

    return with_removals(docs, symbols, equal_windows).mapInArrow(run, "doc_id long, n_words long, starts array<long>, ends array<long>, kept binary")


def digest(found: DataFrame) -> DataFrame:
    return found.selectExpr("doc_id", "n_words", "aggregate(zip_with(ends, starts, (e, s) -> e - s), 0L, (x, y) -> x + y) AS n_removed", "sha2(kept, 256) AS kept_sha256")
