"""Routing of repeated windows of symbols to shards, for the index-based substring operators.

A window is L consecutive symbols (bytes or words) of one text. Its anchor is the gram of m symbols in it with the
smallest hash, the leftmost of equals: a property of the window's content alone, so equal windows have equal
anchors. Consecutive windows with the same anchor occurrence form a run. Only runs whose anchor hash occurs in
another run can hold a repeated window; these are cut out with their symbols and sent to the shard of their
hash, where an index over the shard's distinct runs decides.

Skew. Anchor counts are combined before the shuffle; copies of a text are settled by digest and are never cut out; equal
runs are one string of a shard; shards hold a bounded number of bytes as their number follows the data. An anchor of more
than ``HOT`` texts doesn't fit that: its windows are settled one by one by 128-bit hashes in grouped joins.

Order. A window is removed if it also starts in a document with a smaller doc_id or, where ``within`` is set, earlier in
the same document. A null doc_id counts as the largest. Rows of equal doc_id but different text don't remove
anything from each other; repeated rows of equal doc_id and text have equal results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateworks.llm.storage import stage

U = np.uint64
LAST = (1 << 63) - 1
#: Symbols of a text that are hashed at once; longer texts go in pieces that overlap by L - 1.
PIECE = 1 << 20
#: Bytes of short texts that are hashed at once.
GROUP_BYTES = 1 << 16
#: Texts (twice, where repeats within one count) that hold an anchor, up to which its windows go to a shard.
HOT = 150_000
#: Bytes of cut-out runs per shard: small enough for an index's arrays and lists to stay in a core's cache.
SHARD_BYTES = 2 << 20

_BASE = int("9E3779B97F4A7C15", 16)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, one more than a piece has symbols."""
    if base not in _powers:
        with np.errstate(over="ignore"):
            out = np.full(PIECE + 1, base, U)
            out[0] = 1
            _powers[base] = np.multiply.accumulate(out)
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def grams(x: np.ndarray, m: int, base: int = _BASE) -> np.ndarray:
    """Hash of x[i:i+m] for every i."""
    n = len(x)
    sums = np.zeros(n + 1, U)
    np.cumsum(x * _power_table(base)[:n], out=sums[1:])
    return mix((sums[m:] - sums[:-m]) * _power_table(pow(base, -1, 1 << 64))[:n - m + 1])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        values, k = np.minimum(values[:-k], values[k:]), 2 * k
    rest = width - k
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


_BYTES = mix(np.arange(1, 257, dtype=U))


def _bounds(texts: pa.Array) -> np.ndarray:
    """Where each text of a binary array starts in its buffer, and the last ends."""
    if not len(texts):
        return np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)


@dataclass(frozen=True)
class Symbols:
    """What a text consists of: its bytes, or the hashes of its words."""

    words: bool
    L: int
    m: int
    within: bool

    def of(self, text: bytes) -> np.ndarray:
        """The symbols as bytes or as 64-bit hashes of words."""
        if not self.words:
            return np.frombuffer(text, np.uint8)
        import xxhash

        return np.array([xxhash.xxh3_64_intdigest(w) for w in text.split()], U)

    def hashed(self, symbols: np.ndarray) -> np.ndarray:
        return symbols if self.words else _BYTES[symbols]

    def joined(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of many texts one after another, and where each text starts (and the last ends)."""
        if not self.words:
            ends, data = _bounds(texts), texts.buffers()[2]
            return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data else np.empty(0, np.uint8), ends - ends[0]
        each = [self.of(t) for t in texts.to_pylist()]
        return np.concatenate([np.empty(0, U), *each]), np.r_[0, np.cumsum([len(x) for x in each], dtype=np.int64)]

    def runs_of(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of the text, anchor hash, first window within the text and number of windows of every run of ``joined`` texts."""
        counts = np.maximum(np.diff(ends) - self.L + 1, 0)
        if len(flat) > PIECE:
            each = [self.runs(flat[a:b]) for a, b in zip(ends, ends[1:])]
            text = np.repeat(np.arange(len(each)), [len(x[0]) for x in each])
            return text, *(np.concatenate(x) for x in zip(*each))
        if not counts.any():
            return np.empty(0, np.int64), np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
        h, least = self._least(flat)
        before = np.cumsum(counts) - counts
        window = np.arange(counts.sum()) + np.repeat(ends[:-1] - before, counts)  # those within one text
        anchor = least[window]
        first = np.flatnonzero(np.diff(anchor, prepend=-1))  # no two texts share an anchor's place
        text = np.searchsorted(before + counts, first, side="right")
        return text, h[anchor[first]], window[first] - ends[text], np.diff(first, append=len(anchor))

    def _least(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the grams, and the place of each window's anchor."""
        h = grams(self.hashed(symbols), self.m)
        # the upper half orders, the position breaks ties
        least = _sliding_min((h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U), self.L - self.m + 1)
        return h, (least & U(0xFFFFFFFF)).astype(np.int64)

    def runs(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor hash, first window and number of windows of every run."""
        hashes, starts, counts = [], [], []
        for at in range(0, len(symbols) - self.L + 1, PIECE - self.L + 1):
            h, anchor = self._least(symbols[at:at + PIECE])
            first = np.flatnonzero(np.diff(anchor, prepend=-1))
            hashes.append(h[anchor[first]])
            starts.append(first + at)
            counts.append(np.diff(first, append=len(anchor)))
        if not hashes:
            return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(hashes), np.concatenate(starts), np.concatenate(counts)

    def windows(self, symbols: np.ndarray, start: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each of ``count`` windows from ``start``."""
        x = self.hashed(symbols[start:start + count + self.L - 1])
        return grams(x, self.L), grams(x, self.L, _BASE ^ 0x5BD1E9950)

    def hashes_at(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The first hash of the windows at ``starts``."""
        if len(symbols) > PIECE:
            return np.array([self.windows(symbols, int(a), 1)[0][0] for a in starts], U)
        sums = np.zeros(len(symbols) + 1, U)
        np.cumsum(self.hashed(symbols) * _power_table(_BASE)[:len(symbols)], out=sums[1:])
        return mix((sums[starts + self.L] - sums[starts]) * _power_table(pow(_BASE, -1, 1 << 64))[starts])


def _ids(docs: DataFrame) -> DataFrame:
    """doc_id, tag (64 bits of the text) and text as bytes; null texts have none."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("tag"), F.col("text").cast("binary").alias("text"))


def _packed(docs: DataFrame) -> DataFrame:
    """The texts compressed, as they are shuffled twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([press.compress(t.as_py()) for t in batch.column(2)], pa.binary())], ["doc_id", "tag", "packed"])

    return _ids(docs).mapInArrow(run, "doc_id long, tag long, packed binary")


def unpack(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob)


def _copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tag) of the texts as they stand for themselves, and of their copies with larger doc_ids."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sigs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(text).alias("tag"), F.xxhash64(F.lit(7), text).alias("more"))
    sigs = stage(sigs.distinct(), "digests")
    first = sigs.groupBy("tag", "more").agg(F.min("doc_id").alias("first"))
    both = sigs.join(first, ["tag", "more"]).select("doc_id", "tag", (F.col("doc_id") > F.col("first")).alias("copy"))
    return both.where("not copy").select("doc_id", "tag"), both.where("copy").select("doc_id", "tag")


def _groups(sizes: Iterable[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are worked on at once: few enough bytes for a core's cache, or one long text."""
    lo = hi = total = 0
    for size in map(int, sizes):
        if hi > lo and total + size > GROUP_BYTES:
            yield lo, hi
            lo, total = hi, 0
        hi, total = hi + 1, total + size
    if hi > lo:
        yield lo, hi


def _anchored(docs: DataFrame, symbols: Symbols) -> DataFrame:
    """(hash, doc_id, tag, start, count, n): every run of a text with its anchor hash; n adds up to 1 per text and anchor, or to 2 where
    repeats within the text count and it has several runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lo, hi in _groups(np.diff(_bounds(batch.column(2)))):
                text, h, start, count = symbols.runs_of(*symbols.joined(batch.column(2).slice(lo, hi - lo)))
                by = np.lexsort((h, text))
                new = np.flatnonzero(np.r_[True, (np.diff(h[by]) != 0) | (np.diff(text[by]) != 0)][:len(by)])
                n = np.zeros(len(h), np.int32)
                n[by[new]] = np.minimum(np.diff(new, append=len(by)), 2 if symbols.within else 1)
                found.append((text + lo, h.view(np.int64), start.astype(np.int32), count.astype(np.int32), n))
            if found:
                text, h, start, count, n = (pa.array(np.concatenate(x)) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([h, batch.column(0).take(text), batch.column(1).take(text), start, count, n], ["hash", "doc_id", "tag", "start", "count", "n"])

    return _ids(docs).mapInArrow(run, "hash long, doc_id long, tag long, start int, count int, n int")


def _cut(texts: DataFrame, symbols: Symbols) -> DataFrame:
    """The strings of the runs of ``texts`` (doc_id, tag, packed, runs), and the windows of those that are marked as hot."""
    schema = "hash long, doc_id long, tag long, starts array<long>, run binary, w1 long, w2 long"
    names = ["hash", "doc_id", "tag", "starts", "run", "w1", "w2"]

    def batch_of(part: list[tuple]) -> pa.RecordBatch:
        """From hashes, docs, tags, numbers of starts, all starts, sizes of the strings in bytes, and their bytes."""
        hashes, docs, tags, n, places, size, flat = (np.concatenate(x) for x in zip(*part))
        run = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(flat)])
        starts = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(places))
        none = pa.nulls(len(size), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(docs), pa.array(tags), starts, run, none, none], names)

    def distinct(s: np.ndarray, text: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Equal runs of a text as one: the first ones, the order that brings equals together, their numbers. The first and the last window hold all of a run."""
        first, last = symbols.hashes_at(s, starts), symbols.hashes_at(s, starts + counts - 1)
        key = mix(first) ^ mix(last + U(1)) * U(3) ^ counts.astype(U)
        by = np.lexsort((key, text))  # stable: equals in the order of their starts
        new = np.flatnonzero(np.r_[True, (np.diff(key[by]) != 0) | (np.diff(text[by]) != 0)])
        return by[new], by, np.diff(new, append=len(by))

    def cut(s: np.ndarray, ends: np.ndarray, docs: np.ndarray, tags: np.ndarray, text: np.ndarray, hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple:
        """The distinct runs of joined texts for ``batch_of``."""
        at, by, n = distinct(s, text, starts + ends[text], counts)
        size = counts[at] + symbols.L - 1
        flat = s[np.repeat((starts + ends[text])[at] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        return hashes[at], docs[text[at]], tags[text[at]], n, starts[by], size * s.itemsize, flat.view(np.uint8)

    def settled(s: np.ndarray, ends: np.ndarray, docs: np.ndarray, tags: np.ndarray, text: np.ndarray, hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        """The windows of hot runs of joined texts with their two hashes."""
        each = np.repeat(text, counts)
        first = starts + ends[text]
        at = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        both = [symbols.windows(s, int(a), int(c)) for a, c in zip(first, counts)] if len(s) > PIECE else None
        w1, w2 = (np.concatenate(w) for w in zip(*both)) if both else (w[at + ends[each]] for w in symbols.windows(s, 0, len(s) - symbols.L + 1))
        n = len(at)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(hashes, counts)), pa.array(docs[each]), pa.array(tags[each]), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(at)),
                                           pa.nulls(n, pa.binary()), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, size = [], 0
            lists = batch.column(3)
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            hashes, starts, counts, hot = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            ids, tags = (batch.column(c).to_numpy() for c in range(2))
            texts, lo, held = [], 0, 0
            for k, blob in enumerate(batch.column(2)):
                texts.append(unpack(blob.as_py()))
                held += len(texts[-1])
                if held <= GROUP_BYTES and k + 1 < batch.num_rows:
                    continue
                s, ends = symbols.joined(pa.array(texts, pa.binary()))
                mine = slice(bounds[lo], bounds[k + 1])
                text = np.repeat(np.arange(len(texts)), np.diff(bounds[lo:k + 2]))
                h, a, c, is_hot = hashes[mine], starts[mine].astype(np.int64), counts[mine].astype(np.int64), hot[mine]
                by = np.lexsort((a, text))
                by = by[np.r_[True, (np.diff(a[by]) != 0) | (np.diff(text[by]) != 0)]]  # a repeated row brings its runs twice
                for chosen in (by[~is_hot[by]], by[is_hot[by]]):
                    if not len(chosen):
                        continue
                    args = (s, ends, ids[lo:k + 1], tags[lo:k + 1], *(x[chosen] for x in (text, h, a, c)))
                    if is_hot[chosen[0]]:
                        yield settled(*args)
                    else:
                        part.append(cut(*args))
                        size += len(part[-1][-1])
                if size > 2 << 20:
                    yield batch_of(part)
                    part, size = [], 0
                texts, lo, held = [], k + 1, 0
            if part:
                yield batch_of(part)

    return texts.mapInArrow(run, schema)


#: Given the symbols of a shard's strings one after another, the start of each string and the windows' starts: for each window a group number; equal numbers are equal windows.
Index = Callable[[np.ndarray, np.ndarray, np.ndarray, Symbols], np.ndarray]


def _intervals(at: np.ndarray, owner: np.ndarray, L: int) -> Iterator[tuple[int, int, int]]:
    """(owner, start, end) of maximal runs of consecutive windows; sorted by owner, then start."""
    if len(at):
        breaks = np.flatnonzero(np.r_[True, (np.diff(owner) != 0) | (np.diff(at) != 1)])
        for a, b in zip(breaks, np.r_[breaks[1:], len(at)]):
            yield int(owner[a]), int(at[a]), int(at[b - 1]) + L


def _merged_rows(rows: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(doc_id, tag, start, end) with overlapping intervals of a text joined."""
    out: list[tuple[int, int, int, int]] = []
    for d, t, a, b in sorted(rows):
        if out and out[-1][:2] == (d, t) and a <= out[-1][3]:
            out[-1] = (d, t, out[-1][2], max(b, out[-1][3]))
        else:
            out.append((d, t, a, b))
    return out


def solve(anchor: np.ndarray, doc: np.ndarray, tag: np.ndarray, starts: list[list[int]], runs: list[bytes], symbols: Symbols, index: Index) -> list[tuple[int, int, int, int]]:
    """(doc_id, tag, start, end) of what a shard's runs lose. ``starts`` holds every place of a run in its text, the first first."""
    order = np.lexsort(([s[0] for s in starts], tag, doc))
    anchor, doc, tag = anchor.tolist(), doc.tolist(), tag.tolist()
    first: dict[bytes, tuple[int, int, int]] = {}
    strings, lost, before = [], [], None
    step = 8 if symbols.words else 1
    for k in order.tolist():
        places = starts[k]
        me = (doc[k], tag[k], places[0])
        if me == before:
            continue  # a repeated row
        before = me
        seen = first.setdefault(runs[k], me)
        size = len(runs[k]) // step
        if seen is me or (seen[0] == me[0] and (seen[1] != me[1] or not symbols.within)):
            strings.append((me, runs[k], anchor[k], places[:1] if symbols.within else places))
            places = places[1:] if symbols.within else []
        lost += [(*me[:2], a, a + size) for a in places]
    # a string alone under its anchor has no equal windows: within a run they would have the anchor at two places
    alone = Counter(h for _, _, h, _ in strings)
    strings = [s for s in strings if alone[s[2]] > 1]
    if not strings:
        return _merged_rows(lost)
    kind = U if symbols.words else np.uint8
    flat = np.frombuffer(b"".join(r for _, r, _, _ in strings), kind)
    lengths = np.array([len(r) // step for _, r, _, _ in strings], np.int64)
    heads = np.cumsum(lengths) - lengths
    counts = lengths - symbols.L + 1
    owner = np.repeat(np.arange(len(strings)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = heads[owner] + offset
    group = index(flat, heads, at, symbols)
    # windows stand in the order of doc, tag and place, so that a stable sort by group keeps it; one alone in its group stays
    by = np.flatnonzero(np.bincount(group)[group] > 1)
    by = by[np.argsort(group[by], kind="stable")]
    docs, tags = (np.array([s[0][i] for s in strings], np.int64) for i in range(2))
    g, d, t = group[by], docs[owner[by]], tags[owner[by]]
    new = np.r_[True, g[1:] != g[:-1]][:len(g)]
    least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
    gone = d > least
    if symbols.within:
        gone[1:] |= ~new[1:] & (d[1:] == d[:-1]) & (t[1:] == t[:-1])
    chosen = np.sort(by[gone])
    for o, a, b in _intervals(at[chosen] - heads[owner[chosen]], owner[chosen], symbols.L):
        (me_doc, me_tag, _), _, _, places = strings[o]
        lost += [(me_doc, me_tag, p + a, p + b) for p in places]
    return _merged_rows(lost)


def repeated(docs: DataFrame, symbols: Symbols, index: Index) -> DataFrame:
    """(doc_id, tag, starts, ends): per text what is covered by removed windows; copies have the interval from 0 to the end of time."""
    own, copies = _copies(docs)
    anchored = stage(_anchored(docs, symbols), "anchored")
    shared = stage(anchored.groupBy("hash").agg(F.sum("n").alias("total")).where("total > 1"), "anchors")
    hit = anchored.drop("n").join(shared, "hash").select("doc_id", "tag", F.struct("hash", "start", "count", (F.col("total") > HOT).alias("hot")).alias("run"))
    matched = hit.groupBy("doc_id", "tag").agg(F.collect_list("run").alias("runs"))
    texts = _packed(docs).join(matched.join(own, ["doc_id", "tag"]), ["doc_id", "tag"]).select("doc_id", "tag", "packed", "runs")
    runs = stage(_cut(texts, symbols), "runs")
    whole = runs.where("run is not null")
    total = whole.agg(F.sum(F.octet_length("run"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))

    def shard(rows: pa.Table) -> pa.Table:
        places = rows.column("starts").combine_chunks()
        bounds, places = (x.to_numpy().tolist() for x in (places.offsets, places.values))
        lost = solve(*(rows.column(c).to_numpy() for c in ("hash", "doc_id", "tag")), [places[a:b] for a, b in zip(bounds, bounds[1:])], rows.column("run").to_pylist(), symbols, index)
        columns = list(zip(*lost)) or [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["doc_id", "tag", "start", "end"])

    lost = (whole.select(F.pmod("hash", F.lit(shards)).alias("shard"), "hash", "doc_id", "tag", "starts", "run")
            .groupBy("shard").applyInArrow(shard, "doc_id long, tag long, start long, end long"))
    single = runs.where("run is null").select("w1", "w2", "doc_id", "tag", F.element_at("starts", 1).alias("start")).distinct()
    firsts = single.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"))
    inside = single.groupBy("w1", "w2", "doc_id", "tag").agg(F.min("start").alias("early"))
    late = F.col("start") > F.col("early") if symbols.within else F.lit(False)
    settled = (single.join(inside, ["w1", "w2", "doc_id", "tag"]).join(firsts, ["w1", "w2"]).where((F.col("doc_id") > F.col("least")) | late)
               .select("doc_id", "tag", "start", (F.col("start") + symbols.L).alias("end")))
    gone = lost.unionByName(settled).unionByName(copies.select("doc_id", "tag", F.lit(0).cast("long").alias("start"), F.lit(LAST).alias("end")))
    return gone.groupBy("doc_id", "tag").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))


def merged(starts: list[int], ends: list[int], n: int, least: int) -> list[tuple[int, int]]:
    """Disjoint intervals, in order, within a text of n symbols; a text shorter than ``least`` has none."""
    out: list[tuple[int, int]] = []
    if n >= least:
        for a, b in sorted(zip(starts, ends)):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], min(b, n)))
            else:
                out.append((a, min(b, n)))
    return out


def with_removals(docs: DataFrame, symbols: Symbols, index: Index) -> DataFrame:
    """(doc_id, packed, starts, ends) for every row of ``docs``; lists are null where nothing goes."""
    return _packed(docs).join(repeated(docs, symbols, index), ["doc_id", "tag"], "left").select(
        F.when(F.col("doc_id") < LAST, F.col("doc_id")).alias("doc_id"), "packed", "starts", "ends")
