"""Near-duplicates by Jaccard similarity of word shingles: SimHash blocks and banded minima propose pairs, the Hamming check thins
them out, the whole sets decide.

A set has a SimHash fingerprint. Fingerprints within two bits meet in pigeonhole blocks (``simhash.links``), which brings the closest copies
together, those of one fingerprint too. Sets of similarity 0.8 differ in some ten bits, which no choice of blocks reaches, so the rest
meets by bands: a signature holds the minima of a set's hashes under many permutations; two sets of similarity s agree in one minimum
with probability s, in a band of ``ROWS`` minima with s**ROWS. A proposed pair has to lie within ``distance(similarity)`` bits, then the
whole sets are compared, so that no pair is linked that doesn't reach the similarity. A pair at exactly the similarity is missed by the bands
(fewer than two shared) with probability ``MISS`` at most, and by the Hamming check too; a closer one far more rarely. Passages that many
documents share don't bring these together: they fill a band only where they fill most of both sets.

Crowded bands. All members of a band with up to ``CROWD`` members are compared. In a larger one all are compared with
``HUBS`` of them, first with the one that shares most crowded bands, which lies in the middle of a group of near copies. Where members
still lie in different components then, the band is cut into blocks of ``BLOCK`` members, and each two blocks are compared within one
task, which gives one link for two components at most: exact, bounded in memory and spread over the cluster, though the comparisons of a
crowd that doesn't hold together still grow with its square.

Definitions. Words as in ``simhash``: A-Z lowered, split at ASCII white space. A text's set has the 64-bit hashes of its
runs of ``WORDS`` words; a shorter text is one run; texts without words (null ones too) are equal. Very long texts are read whole,
in pieces of ``PIECE`` hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import acos, comb, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateworks.llm import simhash
from plateworks.llm.components import components
from plateworks.llm.storage import stage

WORDS = 5
#: Least Jaccard similarity in per cent.
SIMILARITY = 80
SEED = 42
#: Minima in a band, and the share of pairs at the least similarity that may share no band or a single one (which a crowd would split).
ROWS = 4
MISS = 1e-4
#: Sets of fewer hashes meet without the Hamming check: the majorities of few hashes differ more often than the angle says.
FEW = 10
CROWD = 8
HUBS = 2
#: Members of a crowd that a task holds twice, and hashes whose occurrence in them it looks at at once.
BLOCK = 256
VOCABULARY = 1 << 12
#: Hashes whose permutations are computed at once.
PIECE = 1 << 12

NODE = "struct<id:bigint,t1:bigint,t2:bigint>"


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes."""
    import xxhash

    tokens = (text or b"").lower().split()
    if not tokens:
        return np.zeros(0, np.int64)
    line = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    starts, ends = (starts[:len(starts) - words + 1], ends[words - 1:]) if len(tokens) >= words else (starts[:1], ends[-1:])
    hashes = np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    return np.unique(hashes.view(np.int64))


def bands(similarity: int = SIMILARITY) -> int:
    """Bands of which a pair of this similarity shares fewer than two with probability ``MISS`` at most."""
    same = (similarity / 100) ** ROWS
    number = 2
    while (1 - same) ** number + number * same * (1 - same) ** (number - 1) > MISS:
        number += 1
    return number


@lru_cache
def distance(similarity: int = SIMILARITY) -> int:
    """Bits within which the fingerprints of a pair of this similarity lie but for probability ``MISS``: each bit differs with the
    angle between the sets, which is widest for sets of equal size."""
    differs = acos(2 * similarity / (100 + similarity)) / pi
    beyond, bits = 1.0, -1
    while beyond > MISS:
        bits += 1
        beyond -= comb(64, bits) * differs ** bits * (1 - differs) ** (64 - bits)
    return bits


@lru_cache
def _permutations(number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of 32 bits: what is flipped and what multiplies, per minimum; the factors that join a band's minima."""
    random = np.random.default_rng(SEED)
    flips, factors = random.integers(0, 1 << 32, (2, number * ROWS, 1), np.uint32)
    return flips, factors | np.uint32(1), random.integers(0, 1 << 63, (number, ROWS), np.uint64) | np.uint64(1)


def band_keys(found: np.ndarray, number: int) -> np.ndarray:
    """One 64-bit key per band; a set without hashes has none."""
    if not len(found):
        return np.zeros(0, np.int64)
    flips, factors, salts = _permutations(number)
    least = np.full(number * ROWS, np.iinfo(np.uint32).max, np.uint32)
    short = (found ^ (found >> 32)).astype(np.uint32)
    for k in range(0, len(short), PIECE):
        np.minimum(least, ((short[k:k + PIECE] ^ flips) * factors).min(axis=1), out=least)
    return (least.reshape(number, ROWS) * salts).sum(axis=1, dtype=np.uint64).view(np.int64)


def _digest(found: np.ndarray) -> tuple[int, int]:
    import xxhash

    both = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), "<i8")
    return int(both[0]), int(both[1])


def _node(doc_id: Column, text: Column) -> Column:
    """A row's identity: its doc_id and 128 bits of its text."""
    text = text.cast("string")
    return F.struct(doc_id.cast("long").alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"))


def _named(docs: DataFrame) -> DataFrame:
    node = _node(F.col("doc_id"), F.col("text"))
    return docs.where(F.col("doc_id").cast("long").isNotNull()).select(node.alias("node"), F.col("text").cast("binary").alias("text"))


def _sets(named: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shingles(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int64()))], ["node", "shingles"])

    return named.select("node", "text").mapInArrow(run, f"node {NODE}, shingles array<long>")


def _signatures(named: DataFrame, words: int, similarity: int) -> DataFrame:
    """(node, h1, h2, n, fp, keys): the set's digest and size, its fingerprint and its bands."""
    number = bands(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, sizes, prints, keys = [], [], [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), words)
                a, b = _digest(found)
                h1.append(a)
                h2.append(b)
                sizes.append(len(found))
                prints.append(simhash.fingerprint_of(found))
                keys.append(band_keys(found, number))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                                             ["node", "h1", "h2", "n", "fp", "keys"])

    return named.select("node", "text").mapInArrow(run, f"node {NODE}, h1 long, h2 long, n int, fp long, keys array<long>")


def _met(a: DataFrame, b: DataFrame, similarity: int, *more: Column) -> DataFrame:
    """Pairs of different nodes under one key whose sizes and fingerprints allow the similarity."""
    a, b = a.alias("a"), b.alias("b")
    sizes = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * similarity
    bits = (F.least("a.n", "b.n") < FEW) | (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance(similarity))
    met = a.join(b, [F.col("a.key") == F.col("b.key"), F.col("a.node") != F.col("b.node"), sizes, bits, *more])
    return met.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))


def _by_fingerprint(classes: DataFrame) -> DataFrame:
    """Pairs from SimHash blocks: each class with the first of its fingerprint, and the first ones of fingerprints within two bits."""
    first = stage(classes.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("same")), "prints")
    same = classes.join(first.where("same > 1"), "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    side = [first.select(F.col("fp").alias(x), F.col("first").alias(f"of_{x}")) for x in ("a", "b")]
    linked = simhash.links(first).join(side[0], "a").join(side[1], "b")
    return same.unionByName(linked.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")))


def _sets_of(nodes: DataFrame, named: DataFrame, words: int) -> DataFrame:
    """The whole sets of nodes; texts are read once for all comparisons."""
    wanted = stage(nodes.distinct(), "wanted")
    return stage(_sets(named.join(wanted, "node", "left_semi").dropDuplicates(["node"]), words), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs whose whole sets reach the similarity."""
    pairs = stage(pairs.distinct(), "met")
    sides = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return stage(sides.where(common * (100 + similarity) >= (F.size("of_a") + F.size("of_b")) * similarity).select("a", "b"), "near")


def _rooted(members: DataFrame, near: DataFrame) -> DataFrame:
    """The rows of keys whose members lie in different components, with their root."""
    rooted = members.join(components(near), "node", "left").select("node", "key", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members")).where("low <> high").select("key", "members")
    return rooted.join(mixed, "key")


def _common(sets: pa.ListArray) -> np.ndarray:
    """How many hashes each two of the sets share."""
    values, place = np.unique(sets.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sets.value_lengths().to_numpy(zero_copy_only=False))
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(values), VOCABULARY):
        low, high = np.searchsorted(place, (at, at + VOCABULARY))
        held = np.zeros((len(sets), VOCABULARY), np.float32)
        held[row[low:high], place[low:high] - at] = 1
        common += held @ held.T
    return common.astype(np.int64)


def _compared(apart: DataFrame, sets: DataFrame, similarity: int, block: int) -> DataFrame:
    """Links between members of one key that lie in different components, one for two components and blocks at most."""
    blocks = F.ceil(F.col("members") / block)
    dealt = apart.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("node", "root", "key", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        found = group["shingles"].combine_chunks()
        sizes = found.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        roots = np.stack([x.to_numpy(zero_copy_only=False) for x in group["root"].combine_chunks().flatten()], axis=1)
        root = np.unique(roots, axis=0, return_inverse=True)[1].reshape(-1)
        of = group["block"].to_numpy()
        a, b = np.nonzero((_common(found) * (100 + similarity) >= (sizes[:, None] + sizes) * similarity) & (root[:, None] < root))
        across = (of[a] != of[b]) | (group["low"][0].as_py() == group["high"][0].as_py())
        a, b = a[across], b[across]
        one = np.unique(np.stack([root[a], root[b]], axis=1), axis=0, return_index=True)[1]
        return pa.table({"a": group["node"].take(pa.array(a[one])), "b": group["node"].take(pa.array(b[one]))})

    return stage(dealt.join(sets, "node").groupBy("key", "low", "high").applyInArrow(run, f"a {NODE}, b {NODE}"), "near")


def links(classes: DataFrame, named: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between classes (node, n, fp, keys) of similar sets; their components are those of all such pairs."""
    keyed = classes.select("node", "n", "fp", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    member = stage(keyed.join(sizes, "key"), "members")
    prints = stage(_by_fingerprint(classes), "pairs")
    sets = _sets_of(member.select("node").unionByName(prints.select(F.col("a").alias("node"))).unionByName(prints.select(F.col("b").alias("node"))), named, words)
    small = member.where(F.col("members") <= crowd)
    parts = [prints, _met(small, small, similarity, F.col("a.node") < F.col("b.node"))]
    crowded = member.where(F.col("members") > crowd).drop("members")
    some = crowded.head() is not None
    if some:
        crowded = crowded.join(crowded.groupBy("node").agg(F.count(F.lit(1)).alias("shared")), "node")
    for k in range(HUBS if some else 0):
        order = F.struct((F.xxhash64("node", F.lit(k)) if k else -F.col("shared")).alias("turn"), "node", "n", "fp")
        hubs = crowded.groupBy("key").agg(F.min(order).alias("hub")).select("key", "hub.node", "hub.n", "hub.fp")
        parts.append(_met(hubs, crowded, similarity))
    near = _verified(reduce(DataFrame.unionByName, parts), sets, similarity)
    if not some:
        return near
    apart = stage(_rooted(crowded, near), "apart")
    return near.unionByName(_compared(apart, sets, similarity, block))


def one_of_each(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """The rows of ``docs`` of which no smaller doc_id is reachable over similar sets, with all their columns.

    Rows are judged by their own text: of rows that share a doc_id, a near copy of another document goes and an unrelated text stays. Rows of
    one doc_id that are similar to each other are one document, repeated rows too, and stay together. Rows without a doc_id stay and
    let nothing go. An empty table gives none.
    """
    named = _named(docs)
    prints = stage(_signatures(named, words, similarity), "signatures")
    classes = stage(prints.groupBy("h1", "h2").agg(F.min("node").alias("node"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "classes")
    roots = components(links(classes, named, words, similarity, crowd))
    first = classes.join(roots, "node", "left").select("h1", "h2", F.coalesce("root.id", "node.id").alias("least"))
    gone = prints.select("node", "h1", "h2").join(first, ["h1", "h2"]).where(F.col("node.id") > F.col("least")).select(F.col("node").alias("gone")).distinct()
    gone = stage(gone, "gone")  # its size is known to the join, which doesn't deal out the texts for a small one
    node, other = _node(docs["doc_id"], docs["text"]), gone["gone"]
    return docs.join(gone, [node[x] == other[x] for x in ("id", "t1", "t2")], "left_anti")
