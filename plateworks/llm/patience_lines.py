"""Line deduplication by pairwise alignment.

Documents meet through shared lines and through shared stretches: each line, and each shortest run of lines with
enough characters for a block, that several different texts hold points to the first of them. The later document is
aligned with that one by patience diff over line hashes, and aligned common blocks of enough characters are deleted from
it. A link per line and two stretches per line keep the candidates in proportion to the lines, however many documents
share them.

Definitions. Lines are split at line feeds; a line of ``min_line`` or more characters can link. Texts are ordered by
smallest doc_id, then by digest; equal texts are one text.
Every shared line links, whatever the number of texts that hold it, and with ``runs``, which query and pipeline set, every
stretch. The stretches of a text are, for each of its lines, the shortest run from it on and the shortest run up to it
that have ``min_block`` characters. Every line of a block that two texts share lies in a stretch that both hold, so each
brings the text to the first that holds it, whatever else they share. A block is a maximal run of lines that are aligned
and adjacent in both documents; it is deleted if its lines have ``min_block`` characters or more together, and what is
left is aligned again until no block is found. A copy with a larger doc_id than its text's smallest is its own first
aligned whole: all goes if its lines have ``min_block`` characters. Null texts stay null; a row with a null doc_id comes
after all others; repeated rows of one doc_id and text are one document.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateworks.llm.storage import stage

MIN_LINE = 20
#: Texts that hold a rare line in the tests' plain version; no line is left out here.
RARE = 50
MIN_BLOCK = 160
#: Bits of the rows that an ordinary alignment holds at a time; larger gaps are halved.
HELD = 1 << 28

_LAST = (1 << 63) - 1


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of ``pairs`` (sorted by the first) that rises in the second, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back.append(at[pile - 1] if pile else -1)
        tops[pile:pile + 1] = [j]
        at[pile:pile + 1] = [k]
    out = []
    k = at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each of ``b`` a bit per element of ``a``: unset where the longest common subsequence grows."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for x in b:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
        yield row


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence; runs are taken from their ends, so that they stay together."""
    in_a, in_b = set(a), set(b)
    at_a, at_b = [i for i, x in enumerate(a) if x in in_b], [j for j, x in enumerate(b) if x in in_a]
    found, todo = [], [(at_a, at_b)]
    while todo:
        at_a, at_b = todo.pop()
        if not at_a or not at_b:
            continue
        own_a, own_b = [a[i] for i in at_a], [b[j] for j in at_b]
        if len(at_b) > 1 and len(at_a) * len(at_b) > HELD:
            half = len(at_b) // 2
            for head in _rows(own_a, own_b[:half]):
                pass
            for tail in _rows(own_a[::-1], own_b[half:][::-1]):
                pass
            # lengths with the first half over the first k of a, and with the second over the rest
            most, cut, now = -1, 0, len(own_a) - tail.bit_count()
            for k in range(len(own_a) + 1):
                if now > most:
                    most, cut = now, k
                if k < len(own_a):
                    now += (1 - (head >> k & 1)) - (1 - (tail >> len(own_a) - 1 - k & 1))
            todo += [(at_a[:cut], at_b[:half]), (at_a[cut:], at_b[half:])]
            continue
        rows = [(1 << len(own_a)) - 1, *_rows(own_a, own_b)]
        i, j = len(own_a), len(own_b)
        while i and j:
            if own_a[i - 1] == own_b[j - 1]:
                i, j = i - 1, j - 1
                found.append((at_a[i], at_b[j]))
            elif rows[j] >> i - 1 & 1:  # the length doesn't grow with a's last
                i -= 1
            else:
                j -= 1
    return sorted(found)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) with a[i] == b[j], rising in both.

    Common heads and tails are matched, then the lines that occur once on either side, in the longest order both share;
    the gaps between these are aligned in the same way. A gap without such lines is aligned by a longest common subsequence.
    """
    found = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            found.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            found.append((i1, j1))
        if i0 >= i1 or j0 >= j1:
            continue
        in_a, in_b = Counter(a[i0:i1]), Counter(b[j0:j1])
        where = {b[j]: j for j in range(j0, j1) if in_b[b[j]] == 1}
        anchors = _rising([(i, where[a[i]]) for i in range(i0, i1) if in_a[a[i]] == 1 and a[i] in where])
        if not anchors:
            found += [(i0 + i, j0 + j) for i, j in common(a[i0:i1], b[j0:j1])]
            continue
        found += anchors
        for (i, j), (k, l) in zip([(i0 - 1, j0 - 1), *anchors], [*anchors, (i1, j1)]):
            todo.append((i + 1, k, j + 1, l))
    return sorted(found)


def aligned_blocks(earlier: list[int], later: list[int], sizes: list[int], min_block: int) -> list[int]:
    """Positions in ``later`` of the lines in aligned common blocks with ``min_block`` characters or more."""
    later, out = list(later), []
    while True:
        gone, block, last = [], [], None
        for i, j in [*patience(earlier, later), (-2, -2)]:
            if last is not None and (i, j) == (last[0] + 1, last[1] + 1):
                block.append(j)
            else:
                if block and sum(sizes[x] for x in block) >= min_block:
                    gone += block
                block = [j]
            last = (i, j)
        if not gone:
            return sorted(out)
        out += gone
        for j in gone:
            later[j] = None  # equal to no line


def stretches(lines: list[int], sizes: list[int], min_block: int) -> set[int]:
    """Hashes of the shortest runs with ``min_block`` characters from each line on and up to each line."""
    import xxhash

    packed, ends = array("q", lines).tobytes(), list(accumulate(sizes, initial=0))
    runs = set()
    for i in range(len(lines)):
        stop = bisect_left(ends, ends[i] + min_block, i + 1)
        if stop < len(ends):
            runs.add((i, stop))
        start = bisect_right(ends, ends[i + 1] - min_block, 0, i + 1) - 1
        if start >= 0:
            runs.add((start, i + 1))
    return {xxhash.xxh64_intdigest(packed[8 * i:8 * j]) - (1 << 63) for i, j in runs}


def _digest(text: Column) -> list[Column]:
    """128 bits of a text."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")]


def removals(docs: DataFrame, min_line: int = MIN_LINE, min_block: int = MIN_BLOCK, runs: bool = False) -> DataFrame:
    """(h1, h2, first, removed): per distinct text that loses lines or has copies: its digest, smallest doc_id and the
    positions of the lines that its first copy loses."""
    lines = F.split("text", "\n")
    texts = (docs.where(F.col("text").isNotNull())
             .select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), *_digest(F.col("text")),
                     F.transform(lines, lambda x: F.xxhash64(x)).alias("lines"), F.transform(lines, lambda x: F.char_length(x)).alias("sizes"))
             .groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("lines").alias("lines"), F.first("sizes").alias("sizes")))
    texts = stage(texts, "line-hashes")
    key = F.struct("first", "h1", "h2")
    # a text once for each of its stretches and lines that can link
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, kinds, found = [], [], []
            for k, (lines, sizes) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                single, several = {x for x, n in zip(lines, sizes) if n >= min_line}, stretches(lines, sizes, min_block) if runs else ()
                docs += [k] * (len(single) + len(several))
                kinds += [False] * len(single) + [True] * len(several)
                found += [*single, *several]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs, pa.int32())), pa.array(kinds, pa.bool_()), pa.array(found, pa.int64())], ["doc", "run", "key"])

    held = texts.select(key.alias("doc"), "lines", "sizes").mapInArrow(keys, "doc struct<first:long,h1:long,h2:long>, run boolean, key long")
    shared = held.groupBy("run", "key").agg(F.count(F.lit(1)).alias("df"), F.min("doc").alias("holder")).where("df > 1")
    pairs = held.join(shared, ["run", "key"]).where("doc <> holder").select("doc", "holder").distinct()
    texts = texts.withColumn("doc", key)
    sides = (pairs.join(texts.select("doc", "lines", "sizes"), "doc")
             .join(texts.select(F.col("doc").alias("holder"), F.col("lines").alias("earlier")), "holder")
             .select("doc", "earlier", "lines", "sizes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [aligned_blocks(*(batch.column(c)[k].as_py() for c in (1, 2, 3)), min_block) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int32()))], ["doc", "gone"])

    gone = (sides.mapInArrow(run, "doc struct<first:long,h1:long,h2:long>, gone array<int>").where(F.size("gone") > 0)
            .groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("removed")))
    # the lines' characters decide whether copies go
    return (texts.join(gone, "doc", "left").where(F.col("removed").isNotNull() | (F.col("copies") > 1))
            .select("h1", "h2", "first", F.coalesce("removed", F.array().cast("array<int>")).alias("removed")))


def deduplicated(docs: DataFrame, min_line: int = MIN_LINE, min_block: int = MIN_BLOCK, runs: bool = False) -> DataFrame:
    """``docs`` with the aligned lines taken out of ``text``, and n_lines, n_removed and removed_lines (positions).

    Columns of these names are replaced; all others stay.
    """
    docs = docs.drop("n_lines", "n_removed", "removed_lines")
    h1, h2 = _digest(F.col("text"))
    lost = removals(docs.select("doc_id", "text"), min_line, min_block, runs).select(
        F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.col("first").alias("__first"), F.col("removed").alias("__removed"))
    df = docs.withColumns({"__k1": h1, "__k2": h2})
    df = df.join(lost, (F.col("__k1") == F.col("__h1")) & (F.col("__k2") == F.col("__h2")) & F.col("text").isNotNull(), "left")
    lines = F.when(F.col("text").isNotNull(), F.split("text", "\n")).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("__lines", lines)
    every = F.when(F.size("__lines") > 0, F.sequence(F.lit(0), F.size("__lines") - 1)).otherwise(F.array().cast("array<int>"))
    copy = (F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)) > F.col("__first")) & (F.char_length("text") - F.size("__lines") + 1 >= min_block)
    none = F.array().cast("array<int>")
    df = df.withColumn("__gone", F.when(F.col("__first").isNull(), none).when(copy, every).otherwise(F.col("__removed")))
    left = F.array_join(F.transform(F.array_except(every, F.col("__gone")), lambda i: F.get(F.col("__lines"), i)), "\n")
    text = F.when(F.size("__gone") > 0, left).otherwise(F.col("text"))
    return df.select(*[text.alias(c) if c == "text" else c for c in docs.columns], F.size("__lines").cast("long").alias("n_lines"),
                     F.size("__gone").cast("long").alias("n_removed"), F.sort_array("__gone").alias("removed_lines"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_lines", "n_removed", "removed_lines", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def filtered(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` after deletion; a document that lost lines and has no word left goes.

    Columns named like a measurement stay as they are. Null texts lose nothing; an empty table gives none.
    """
    found = deduplicated(docs.select("doc_id", "text", F.struct("*").alias("row")), runs=True)
    left = found.where((F.col("n_removed") == 0) | F.col("text").rlike("[^ \\t-\\r]"))
    return left.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
