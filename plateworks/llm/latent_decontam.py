"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of words, weighted by TF-IDF. A distributed randomised SVD of all passages and the items gives a truncated latent basis.
A passage is a candidate for an item where their cosine over the terms reaches ``COSINE``, or where it reaches ``FLOOR`` only and the cosine
of both in the latent space reaches ``LATENT_COSINE``: words that keep company with the item's words make up for those that were changed. Candidates are
confirmed by the longest common subsequence of words and by an answer check (the item's rarest terms have to be there), so that an item
with words changed, dropped or added is found and a passage on the same subject is not.

The cosine over the terms comes from lists of items per term. The largest share that a term can add to any item bounds a passage's cosine from
above by one running sum, and only passages whose bound reaches the floor look into the lists.

Definitions. Words: ASCII letters are lowered, ASCII punctuation and control characters separate. Terms are hashed to
``TERMS`` numbers for weights only; the confirmation compares words. Passages are ``LENGTHS`` words long, from every ``STEP``-th word.
Items of more than
``WHOLE`` words are searched in parts of ``LENGTHS[-1]`` words at most, and confirmed whole: a passage can't come near an item much longer than itself.
A passage's norm is that of all its words. Null and empty texts hold
nothing; null items, and items of fewer than ``LEAST_WORDS`` words, are not searched. Repeated rows of documents get a row
each per item; repeated items with one item_id are searched each and give one row (the better; equal ones: that with the greater shares, then
cosine). Very long texts are searched whole, in overlapping pieces. Empty tables give no rows. Further columns of either table, whatever their names, are not read.

Bounds. Texts are split into terms once and the terms written to the shared folder. Document frequencies, the basis, search and confirmation cover all
documents; the basis has rows for the items' terms and the commonest others up to ``LATENT_TERMS``, and a task of its fit sends one matrix of that size. The driver holds
``TERMS`` weights, ``ITEMS`` items or parts and their basis at a time; larger benchmarks are searched in blocks of about ``ITEMS`` (an item's parts stay together).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateworks.llm.storage import stage

TERMS = 1 << 18
STEP = 8
LENGTHS = (24, 48)
LEAST_WORDS = 5
WHOLE = 72
ITEMS = 16_384
FIT_PARTS = 16
#: Words whose rows of the basis are held at once.
FIT_WORDS = 1 << 17
POWER = 2
LATENT = 32
COSINE = 0.4
FLOOR = 0.3
LATENT_COSINE = 0.8
LATENT_TERMS = 16_384
#: Scores of passages by items that are held at once.
SCORES = 1 << 19
COMMON = 0.6
ANSWER = 0.5
#: Words of a text that are compared at once; longer texts go in pieces that overlap by the longest item and passage.
PIECE = 200_000

_SEPARATORS = bytes(range(33)) + bytes(c for c in range(33, 128) if not chr(c).isalnum())
_TABLE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(_TABLE).split()


def terms_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.uint32, len(words)).astype(np.int64) & (TERMS - 1)


def parts_of(words: list[bytes]) -> list[list[bytes]]:
    """The item as it is searched: whole, or in parts of even length."""
    n = 1 if len(words) <= WHOLE else -(-len(words) // LENGTHS[-1])
    return [words[len(words) * k // n:len(words) * (k + 1) // n] for k in range(n)]


def common_subsequence(item: list[bytes], words: list[bytes]) -> int:
    """Length of the longest common subsequence, a bit per word of ``item``."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in words:
        hit = row & places.get(w, 0)
        if hit:
            row = (row + hit | row - hit) & full
    return len(item) - row.bit_count()


@dataclass
class Block:
    """Items with their basis, as the search tasks need them."""

    ids: list[int]
    words: list[list[bytes]]
    answers: list[set[bytes]]
    column: np.ndarray  # per term its list, or -1
    bounds: np.ndarray  # list k goes from bounds[k] to bounds[k + 1]
    parts: np.ndarray  # rows of latent, list by list
    shares: np.ndarray  # what the term adds to the cosine with each, before the passage's norm
    top: np.ndarray  # per term its largest share
    latent_column: np.ndarray  # per term its row in the basis, or -1
    basis: np.ndarray
    latent: np.ndarray  # items or their parts in the latent space, of unit length
    owner: np.ndarray  # per row of latent its item


def _termed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the terms of its words in order, as 32-bit numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [terms_of(words_of(t.as_py())).astype("<i4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(terms, pa.binary())], ["doc_id", "text", "terms"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, text binary, terms binary")


def _with_terms(docs: DataFrame) -> DataFrame:
    return docs if "terms" in docs.columns else _termed(docs)


def _read(terms: pa.Scalar) -> np.ndarray:
    return np.frombuffer(terms.as_buffer(), "<i4") if terms.is_valid else np.zeros(0, "<i4")


def _document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, place = np.zeros(TERMS, np.int64), 0, np.zeros(TERMS, np.int64)
        for batch in batches:
            for terms in batch.column(0):
                got = _read(terms)
                at = np.arange(len(got))
                place[got] = at
                total[got[place[got] == at]] += 1
                n += 1
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([np.r_[hit, -1], np.r_[total[hit], n]], ["term", "n"])

    counts = _with_terms(docs).select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(TERMS, np.int64)
    term, n = counts.column("term").to_numpy(), counts.column("n").to_numpy()
    df[term[term >= 0]] = n[term >= 0]
    return df, int(n[term < 0].sum())


def _projected_back(texts: list[list[bytes]], weight: np.ndarray, column: np.ndarray, z: np.ndarray) -> np.ndarray:
    """A'(A z) for the matrix A of the texts' longer passages, each of two half passages that it shares with its neighbours."""
    out = np.zeros((len(z) + 1, z.shape[1]), z.dtype)
    _add_products([terms_of(words) for words in texts], column, _weighted(weight, z), out)
    return out[:-1] * weight[:, None].astype(z.dtype)


def _weighted(weight: np.ndarray, z: np.ndarray) -> np.ndarray:
    """``z`` by the terms' weights, with a row of zeros for all other terms."""
    return np.concatenate([z * weight[:, None].astype(z.dtype), np.zeros((1, z.shape[1]), z.dtype)])


def _add_products(texts: list[np.ndarray], column: np.ndarray, z: np.ndarray, out: np.ndarray) -> None:
    """Adds A'(A z) of the texts' terms to ``out``, before the terms' weights; both have a last row for terms without a column."""
    half, none = LENGTHS[-1] // 2, len(z) - 1
    pieces = [terms[a:a + half * 4096] for terms in texts for a in range(0, len(terms), half * 4096)]
    while pieces:
        some, n = [], 0
        while pieces and n < FIT_WORDS:
            some.append(pieces.pop())
            n += len(some[-1])
        halves = np.array([-(-len(p) // half) for p in some])
        base = np.cumsum(halves) - halves
        rows = np.full(int(halves.sum()) * half, none, np.uint16 if none < 1 << 16 else np.int64)
        for b, p in zip((base * half).tolist(), some):
            got = column[p]
            rows[b:b + len(p)] = np.where(got >= 0, got, none)
        sums = _grouped(z, rows, half)
        passages = sums.copy()
        passages[:-1] += sums[1:]
        last = base + halves - 1
        passages[last] = np.where((halves == 1)[:, None], sums[last], 0)
        back = passages.copy()
        back[1:] += passages[:-1]
        back[base] = passages[base]
        order = np.argsort(rows, kind="stable")
        order = order[:np.searchsorted(rows[order], none)]
        if not len(order):
            continue
        # a term's passages are summed by eights first: a run is filled up with the row of zeros behind them
        mine = rows[order]
        edges = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        n = np.diff(np.r_[edges, len(mine)])
        eights = -(-n // 8)
        first = np.cumsum(eights) - eights
        at = np.full(int(eights.sum()) * 8, len(back))
        at[np.repeat(first * 8 - edges, n) + np.arange(len(mine))] = order // half
        by_eight = _grouped(np.concatenate([back, np.zeros_like(back[:1])]), at, 8)
        out[mine[edges]] += np.add.reduceat(by_eight, first, axis=0)


def _grouped(values: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``size`` rows of ``values`` each."""
    return np.einsum("ijk->ik", np.take(values, rows, axis=0, mode="clip").reshape(-1, size, values.shape[1]))


def _basis(docs: DataFrame, items: list[list[bytes]], weight: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The leading right singular vectors of all documents' passages and the items, by randomised subspace iteration.

    The items' rows are scaled to the documents' energy.
    """
    size = len(weight)
    rank = min(size, LATENT)
    rnd = np.random.default_rng(42)
    context = docs.sparkSession.sparkContext
    tasks = max(FIT_PARTS, context.defaultParallelism)
    terms = _with_terms(docs).select("terms").coalesce(tasks)
    sent = context.broadcast(column)

    def over_docs(z: np.ndarray) -> np.ndarray:
        weighted = context.broadcast(_weighted(weight, z))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(weighted.value)
            for batch in batches:
                _add_products([_read(t) for t in batch.column(0)], sent.value, weighted.value, total)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

        def total(parts) -> np.ndarray:
            return sum((np.frombuffer(p.as_buffer(), z.dtype).reshape(len(z) + 1, -1) for p in parts), np.zeros((len(z) + 1, z.shape[1]), z.dtype))

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = total(p for batch in batches for p in batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([got.tobytes()], pa.binary())], ["part"])

        parts = terms.mapInArrow(run, "part binary")
        if tasks > FIT_PARTS:  # the driver gets no more matrices on a larger cluster
            parts = parts.repartition(FIT_PARTS).mapInArrow(summed, "part binary")
        return total(parts.toArrow().column("part"))[:-1] * weight[:, None].astype(z.dtype)

    q = np.linalg.qr(rnd.standard_normal((size, rank)))[0].astype(np.float32)
    for _ in range(POWER):
        of_docs, of_items = over_docs(q), _projected_back(items, weight, column, q)
        energy, own = np.linalg.norm(of_docs), np.linalg.norm(of_items)
        q = np.linalg.qr(of_docs + of_items * (max(1.0, energy / own) if own else 1.0))[0].astype(np.float32)
    return q


def _block(items: list[tuple[int, bytes]], docs: DataFrame, df: np.ndarray, n_docs: int) -> Block | None:
    kept = [(i, w) for i, w in ((i, words_of(t)) for i, t in items) if len(w) >= LEAST_WORDS]
    if not kept:
        return None
    idf = np.log((1 + n_docs) / (1 + df)) + 0.05
    mine = [parts_of(w) for _, w in kept]
    parts = [p for some in mine for p in some]
    terms = np.unique(np.concatenate([terms_of(w) for w in parts]))
    column = np.full(TERMS, -1, np.int32)
    column[terms] = np.arange(len(terms))
    lists, shares = [], []
    for p in parts:
        rows, n = np.unique(terms_of(p), return_counts=True)
        x = n * idf[rows]
        lists.append(column[rows])
        shares.append(idf[rows] * x / np.linalg.norm(x))
    owners = np.repeat(np.arange(len(parts), dtype=np.int32), [len(x) for x in lists])
    rows, shares = np.concatenate(lists), np.concatenate(shares).astype(np.float32)
    order = np.argsort(rows, kind="stable")
    bounds = np.searchsorted(rows[order], np.arange(len(terms) + 1))
    top = np.zeros(TERMS, np.float32)
    top[terms] = np.maximum.reduceat(shares[order], bounds[:-1])

    common = np.argsort(-df, kind="stable")[:max(0, LATENT_TERMS - len(terms))]
    wide = np.union1d(terms, common[df[common] > 0])
    latent_column = np.full(TERMS, -1, np.int32)
    latent_column[wide] = np.arange(len(wide))
    basis = _basis(docs, parts, idf[wide], latent_column) * idf[wide, None]
    latent = np.array([basis[latent_column[terms_of(p)]].sum(axis=0) for p in parts])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    answers = []
    for _, w in kept:
        rarest = sorted(set(w), key=lambda v: (-idf[crc32(v) & (TERMS - 1)], v))
        answers.append(set(rarest[:max(1, math.ceil(len(rarest) / 4))]))
    return Block([i for i, _ in kept], [w for _, w in kept], answers, column, bounds, owners[order], shares[order], top, latent_column,
                 basis.astype(np.float32), latent.astype(np.float32), np.repeat(np.arange(len(kept)), [len(some) for some in mine]))


def _over_terms(own: np.ndarray, block: Block, first: np.ndarray, steps: int) -> np.ndarray:
    """Sums of the shares of every item in passages of ``steps`` steps; each step that they share is summed once."""
    used = np.unique(first[:, None] + np.arange(steps))
    where = np.full(used[-1] + 1, -1, np.int64)
    where[used] = np.arange(len(used))
    words = used[0] * STEP + np.flatnonzero(own[used[0] * STEP:(used[-1] + 1) * STEP] >= 0)
    at = where[words // STEP]
    lists, at = own[words[at >= 0]], at[at >= 0]
    low = block.bounds[lists]
    n = block.bounds[lists + 1] - low
    entry = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    items = len(block.latent)
    sums = np.bincount(np.repeat(at, n) * items + block.parts[entry], block.shares[entry], len(used) * items).reshape(len(used), items)
    out = sums[where[first]]
    for k in range(1, steps):
        out += sums[where[first + k]]
    return out


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1)
    np.cumsum(values, dtype=np.float64, out=out[1:])
    return out


def _passages(words: list[bytes], block: Block, idf2: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    return _near_passages(terms_of(words), block, idf2)


def _near_passages(terms: np.ndarray, block: Block, idf2: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """(item, start, end, cosine over the terms) of the passages that come near an item."""
    own = block.column[terms]
    weights = idf2[terms]
    energy, inside, most = _sums(weights), _sums(np.where(own >= 0, weights, 0)), _sums(block.top[terms])
    for length in LENGTHS:
        starts = np.arange(0, max(1, len(terms) - length + STEP), STEP)
        ends = np.minimum(starts + length, len(terms))
        norm2 = np.maximum(energy[ends] - energy[starts], 1e-9)
        # no passage is nearer than its share within the benchmark's terms, nor than the largest shares of its terms together
        near = np.flatnonzero((inside[ends] - inside[starts] >= FLOOR * FLOOR * norm2) & (most[ends] - most[starts] >= (FLOOR - 1e-6) * np.sqrt(norm2)))
        held = max(16, SCORES // len(block.latent))
        for at in range(0, len(near), held):
            some = near[at:at + held]
            cosine = _over_terms(own, block, starts[some] // STEP, length // STEP) / np.sqrt(norm2[some])[:, None]
            found, item = np.nonzero(cosine >= FLOOR)
            if not len(found):
                continue
            cosine = cosine[found, item]
            unsure = np.flatnonzero(cosine < COSINE)
            sure = np.ones(len(found), bool)
            sure[unsure] = _latent_cosines(terms, block, starts[some], length, found[unsure], item[unsure]) >= LATENT_COSINE
            for p, i, c in zip(some[found[sure]].tolist(), item[sure].tolist(), cosine[sure].tolist()):
                yield int(block.owner[i]), int(starts[p]), int(ends[p]), c


def _latent_cosines(terms: np.ndarray, block: Block, starts: np.ndarray, length: int, found: np.ndarray, items: np.ndarray) -> np.ndarray:
    """``_latent_cosine`` of the passages that begin at ``starts[found]`` with ``items``; each passage is projected once."""
    out = np.empty(len(found))
    passages, which = np.unique(found, return_inverse=True)
    vectors = np.empty((len(passages), block.latent.shape[1]), np.float32)
    for k in range(0, len(passages), 1024):
        at = starts[passages[k:k + 1024], None] + np.arange(length)
        rows = block.latent_column[terms[np.minimum(at, len(terms) - 1)]]
        there = (at < len(terms)) & (rows >= 0)
        vectors[k:k + 1024] = (block.basis[rows] * there[:, :, None]).sum(axis=1)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    for k in range(0, len(found), 1 << 16):
        out[k:k + (1 << 16)] = (vectors[which[k:k + (1 << 16)]] * block.latent[items[k:k + (1 << 16)]]).sum(axis=1)
    return out


def _latent_cosine(terms: np.ndarray, block: Block, item: int) -> float:
    rows = block.latent_column[terms]
    x = block.basis[rows[rows >= 0]].sum(axis=0)
    return float(x @ block.latent[item] / max(float(np.linalg.norm(x)), 1e-9))


def matches(words: list[bytes] | bytes, block: Block, idf2: np.ndarray, terms: np.ndarray | None = None) -> dict[int, tuple[float, float, float, int, int]]:
    """Per confirmed item: cosine, share of the item in the common subsequence, share of its answer terms, and the region's words.

    With ``terms`` given, ``words`` may be the text: it is split only where a passage comes near an item."""
    terms = terms_of(words) if terms is None else terms
    found: dict[int, tuple[float, float, float, int, int]] = {}
    overlap = LENGTHS[-1] + 2 * max(map(len, block.words))
    for base in range(0, max(1, len(terms) - overlap), PIECE):
        passages = sorted(_near_passages(terms[base:base + PIECE + overlap], block, idf2))
        if not passages:
            continue
        words = words_of(words) if isinstance(words, bytes) else words
        piece = words[base:base + PIECE + overlap]
        regions: dict[int, list[list]] = {}
        for i, a, b, cosine in passages:
            margin = len(block.words[i])
            a, b = max(0, a - margin), min(len(piece), b + margin)
            mine = regions.setdefault(i, [])
            # regions of one item are cut where they get much longer than it
            if mine and a <= mine[-1][1] and b - mine[-1][0] <= 6 * (LENGTHS[-1] + margin):
                mine[-1][1:] = max(b, mine[-1][1]), max(cosine, mine[-1][2])
            else:
                mine.append([a, b, cosine])
        for i, mine in regions.items():
            item = block.words[i]
            for a, b, cosine in mine:
                region = piece[a:b]
                answer = len(block.answers[i].intersection(region)) / len(block.answers[i])
                if answer < ANSWER:
                    continue
                common = _densest(item, region)
                if common >= COMMON:
                    found[i] = max(found.get(i, (0.0,) * 5), (cosine, common, answer, base + a, base + b), key=lambda x: (x[1], x[2], x[0]))
    return found


def _densest(item: list[bytes], region: list[bytes]) -> float:
    """Largest share of the item in common with a stretch of the region of one and a half times its length."""
    width = max(len(item) + 4, math.ceil(1.5 * len(item)))
    step = max(1, len(item) // 4)
    return max(common_subsequence(item, region[a:a + width]) for a in range(0, max(1, len(region) - width + step), step)) / len(item)


def _parts(items: DataFrame) -> int:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(parts_of(words_of(t.as_py()))) for t in batch.column(0)], pa.int64())], ["n"])

    return items.select("text").mapInArrow(run, "n long").agg(F.sum("n")).first()[0]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, common, answer, first_word, last_word: one row per row of ``docs`` and item that it holds."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, cosine double, common double, answer double, first_word long, last_word long"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    n_items = items.count()
    if n_items == 0:
        return spark.createDataFrame([], schema)
    docs = stage(_termed(docs), "terms", "zstd")
    df, n_docs = _document_frequencies(docs)
    blocks = -(-_parts(items) // ITEMS)
    out = None
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        block = _block([(r.item_id, bytes(r.text)) for r in mine], docs, df, n_docs)
        if block is not None:
            got = _search(docs, block, df, n_docs, schema)
            out = got if out is None else out.unionByName(got)
    return spark.createDataFrame([], schema) if out is None else out


def _search(docs: DataFrame, block: Block, df: np.ndarray, n_docs: int, schema: str) -> DataFrame:
    idf2 = ((np.log((1 + n_docs) / (1 + df)) + 0.05) ** 2).astype(np.float32)
    sent = docs.sparkSession.sparkContext.broadcast((block, idf2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, idf2 = sent.value
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
        names = ["doc_id", "item_id", "cosine", "common", "answer", "first_word", "last_word"]
        for batch in batches:
            rows = []
            for doc, text, terms in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                best: dict = {}
                for i, m in matches(text.as_py() or b"", block, idf2, _read(terms)).items():
                    best[block.ids[i]] = max(best.get(block.ids[i], m), m, key=lambda x: x[1])
                rows += [(doc, i, *m) for i, m in best.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.select("doc_id", "text", "terms").mapInArrow(run, schema)


def filtered(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item; rows without a doc_id stay."""
    named = docs.where(F.col("doc_id").isNotNull())
    clean = named.join(leaks(named, benchmark).select("doc_id").distinct(), "doc_id", "left_anti")
    return clean.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
