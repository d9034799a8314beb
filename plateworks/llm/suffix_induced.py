"""Byte-level substring deduplication with suffix arrays built by induced sorting, one per shard.

``windows`` routes the runs that may repeat to shards. A shard's strings are concatenated; suffixes are classified, the
leftmost-smaller (LMS) substrings are sorted by induction and named, their order is found by recursion on the names, and
the whole array is induced from it, the large suffixes first, then the small ones. Common prefixes of neighbouring windows, stored by text
position, tell which windows are equal.

A null text is empty. See ``windows`` for order, ties, repeated rows and null ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plateworks.llm.windows import Symbols, merged, unpack, with_removals

BYTES = Symbols(words=False, L=100, m=20, within=True)

#: Alphabets up to which suffixes are induced bucket by bucket, in waves of array operations; larger ones by ranks.
WAVES = 1024


def _smaller(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it (type S); the last is a unique smallest symbol."""
    n = len(s)
    equal = s[:-1] == s[1:]
    decides = np.minimum.accumulate(np.where(equal, n, np.arange(n - 1))[::-1])[::-1]
    return np.r_[(s[:-1] < s[1:])[decides], True]


def _induce_waves(s: np.ndarray, small: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Suffix array from the LMS suffixes in ``order``: buckets in turn, each in waves of the entries known so far."""
    n = len(s)
    sa = np.full(n, -1, np.int64)
    count = np.bincount(s, minlength=k)
    end = np.cumsum(count)
    head = end - count
    symbol = s.astype(np.uint16)  # radix sorted below

    def grouped(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        by = np.argsort(symbol[q], kind="stable")
        c = symbol[q][by].astype(np.int64)
        each = np.bincount(c, minlength=k)
        return q[by], c, each, np.arange(len(c)) - (np.cumsum(each) - each)[c]

    q, c, lms, within = grouped(order)
    sa[end[c] - lms[c] + within] = q
    front = head.copy()

    def push_large(batch: np.ndarray) -> None:
        q = batch[batch > 0] - 1
        q = q[~small[q]]
        if len(q):
            q, c, each, within = grouped(q)
            sa[front[c] + within] = q
            front[:] += each

    for b in np.flatnonzero(count).tolist():
        done = head[b]
        while done < front[b]:
            done, batch = front[b], sa[done:front[b]]
            push_large(batch)
        push_large(sa[end[b] - lms[b]:end[b]])

    back = end.copy()
    back[0], sa[0] = 0, n - 1

    def push_small(batch: np.ndarray) -> None:
        q = batch[batch > 0] - 1
        q = q[small[q]]
        if len(q):
            q, c, each, within = grouped(q)
            sa[back[c] - 1 - within] = q
            back[:] -= each

    for b in np.flatnonzero(count)[::-1].tolist():
        done = end[b]
        while done > back[b]:
            done, batch = back[b], sa[back[b]:done][::-1]
            push_small(batch)
        push_small(sa[head[b]:front[b]][::-1])
    return sa


def _refined(rank: np.ndarray, q: np.ndarray) -> None:
    """Sets ``rank`` of the suffixes ``q`` to their places. It holds the first place of those that are equal so far, and the place of
    every suffix that one of ``q`` leads to. Prefixes double: a pass compares what twice as many symbols tell, of those still equal."""
    step = 1
    while len(q):
        key = rank[q] * len(rank) + rank[q + step]
        by = np.argsort(key)
        q, key = q[by], key[by]
        old = rank[q]
        new = np.r_[True, key[1:] != key[:-1]]
        at = np.arange(len(q))
        block = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], at, 0))
        rank[q] = old + np.maximum.accumulate(np.where(new, at, 0)) - block
        q = q[~(new & np.r_[new[1:], True])]
        step *= 2


def _induce_chains(s: np.ndarray, small: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """The same for large alphabets: all large suffixes are induced from the LMS suffixes that they lead to, then all small ones from the large ones.

    A large suffix falls symbol by symbol to an LMS suffix. Places are distinct for these, so equal beginnings end there at the latest."""
    n = len(s)
    count = np.bincount(s, minlength=k)
    large = np.flatnonzero(~small)
    n_large, n_lms = (np.bincount(s[q], minlength=k) for q in (large, order))
    # places among the large and the LMS suffixes: in a bucket the large come first
    both = n_large + n_lms
    head = np.cumsum(both) - both
    rank = head[s]
    by = order[np.argsort(s[order], kind="stable")]
    rank[by] = np.arange(len(by)) - np.repeat(np.cumsum(n_lms) - n_lms, n_lms) + (head + n_large)[s[by]]
    _refined(rank, large)
    # places among all
    head = np.cumsum(count) - count
    by = large[np.argsort(rank[large])]
    rank = (head + n_large)[s]
    rank[by] = np.arange(len(by)) - np.repeat(np.cumsum(n_large) - n_large, n_large) + head[s[by]]
    _refined(rank, np.flatnonzero(small[:-1]))  # the last suffix is alone in its bucket
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa


def _same_substrings(s: np.ndarray, a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Whether s[a:a+la] == s[b:b+lb], for arrays of starts and lengths."""
    same = la == lb
    active = np.flatnonzero(same)
    k = 0
    while len(active):
        equal = s[a[active] + k] == s[b[active] + k]
        same[active[~equal]] = False
        k += 1
        active = active[equal]
        active = active[la[active] > k]
    return same


def _sorted_suffixes(s: np.ndarray, k: int) -> np.ndarray:
    """Suffix array of s, whose last symbol 0 occurs nowhere else; symbols are below k."""
    small = _smaller(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induce = _induce_waves if k <= WAVES else _induce_chains
    if len(s) == 1:
        return np.zeros(1, np.int64)
    sa = induce(s, small, lms, k)
    place = np.full(len(s), -1, np.int64)
    place[lms] = np.arange(len(lms))
    rank = place[sa]
    rank = rank[rank >= 0]  # numbers of the LMS substrings in sorted order
    length = np.r_[np.diff(lms) + 1, 1]
    new = np.r_[False, ~_same_substrings(s, lms[rank[:-1]], lms[rank[1:]], length[rank[:-1]], length[rank[1:]])]
    names = np.cumsum(new)
    if names[-1] + 1 < len(lms):
        reduced = np.empty(len(lms), np.int64)
        reduced[rank] = names
        rank = _sorted_suffixes(reduced, int(names[-1]) + 1)
        return induce(s, small, lms[rank], k)
    return induce(s, small, lms[rank], k)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` (unsigned bytes) in order; a suffix that is another's prefix comes first."""
    return _sorted_suffixes(np.r_[text.astype(np.int64) + 1, 0], 257)[1:]


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For the suffixes ``sa`` in order: at each one's text position, the length up to ``most`` of the prefix it shares with
    the one before it (0 for the first). Positions not in ``sa`` hold 0. Eight bytes are compared at a time."""
    padded = np.r_[text, np.zeros(most + 16, np.uint8)]
    eight = np.zeros(len(padded) - 8, np.uint64)
    for k in range(8):
        eight |= padded[k:k + len(eight)].astype(np.uint64) << np.uint64(8 * k)
    a, b = sa[:-1], sa[1:]
    shared = np.zeros(len(a), np.int64)
    active = np.arange(len(a))
    for k in range(0, most, 8):
        x = eight[a[active] + k] ^ eight[b[active] + k]
        differs = x != 0
        low = x[differs] & (~x[differs] + np.uint64(1))
        shared[active] += 8
        shared[active[differs]] += np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8 - 8
        active = active[~differs]
    out = np.zeros(len(text), np.int64)
    # nothing is shared beyond the end of the text
    out[b] = np.minimum(np.minimum(shared, most), len(text) - np.maximum(a, b))
    return out


def equal_windows(text: np.ndarray, heads: np.ndarray, at: np.ndarray, symbols: Symbols) -> np.ndarray:
    """A number for each window start in ``at``; equal numbers are equal windows."""
    sa = suffix_array(text)
    is_window = np.zeros(len(text), bool)
    is_window[at] = True
    sa = sa[is_window[sa]]
    shared = permuted_prefixes(text, sa, symbols.L)
    group = np.empty(len(text), np.int64)
    group[sa] = np.cumsum(shared[sa] < symbols.L)
    return group[at]


def deduplicated(docs: DataFrame, symbols: Symbols = BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, starts and ends of the removed spans, and kept (the bytes left)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, out = batch.slice(at, 500), []
                for doc, blob, a, b in zip(*part.columns):
                    text = unpack(blob.as_py())
                    spans = merged(a.as_py() or [], b.as_py() or [], len(text), symbols.L)
                    kept = b"".join(text[x:y] for x, y in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(text)]))
                    out.append((doc.as_py(), len(text), [s for s, _ in spans], [e for _, e in spans], kept))
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], ["doc_id", "n_bytes", "starts", "ends", "kept"])

    return with_removals(docs, symbols, equal_windows).mapInArrow(run, "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")


def digest(found: DataFrame) -> DataFrame:
    return found.selectExpr("doc_id", "n_bytes", "n_bytes - octet_length(kept) AS n_removed", "CAST(size(starts) AS long) AS n_spans", "sha2(kept, 256) AS kept_sha256")


