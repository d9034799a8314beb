"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint's 64 bits are split into blocks. Two fingerprints that differ in d bits agree on all blocks but d at
least, so they meet under one of the choices of the other blocks; they are compared there and nowhere else.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateworks.llm.components import components
from plateworks.llm.storage import stage

WORDS = 3
SEED = 42
DISTANCE = 2
BLOCKS = 5
#: Distinct fingerprints up to which a block's members are compared pair by pair; larger blocks go by shared neighbours.
CROWD = 64


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(set_bits: np.ndarray, number: int) -> int:
    return int(sum(1 << i for i in range(64) if 2 * set_bits[i] > number))


def fingerprint_of(hashes: np.ndarray, chunk: int = 1 << 16) -> int:
    """Unsigned 64 bits of a set of 64-bit hashes; an empty one gives zero."""
    hashes = hashes.view(np.uint64)
    return _majority(sum((_set_bits(hashes[at:at + chunk]) for at in range(0, len(hashes), chunk)), np.zeros(64, np.int64)), len(hashes))


def fingerprint(text: bytes | None, words: int = WORDS, chunk: int = 1 << 16) -> int:
    """Unsigned 64 bits. A-Z are lowered; shingles count as often as they occur; no words give zero."""
    import xxhash

    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    starts, ends = (starts[:len(starts) - words + 1], ends[words - 1:]) if len(tokens) >= words else (starts[:1], ends[-1:])
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(starts), chunk):
        hashes = [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[at:at + chunk].tolist(), ends[at:at + chunk].tolist())]
        set_bits += _set_bits(np.array(hashes, np.uint64))
    return _majority(set_bits, len(starts))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Null texts have no words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fingerprint(t.as_py()) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(got, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _choices(blocks: int, distance: int) -> list[int]:
    """Masks of the blocks that must agree, for every choice of ``blocks - distance`` of them."""
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [(1 << cuts[k + 1]) - (1 << cuts[k]) for k in range(blocks)]
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between distinct values of ``fp`` that differ in 1 to ``distance`` bits, whose components are those of all such links.

    Blocks with up to ``crowd`` members give every link. In a larger one two members within two bits share a value
    that each reaches by flipping one free bit at most; each member is linked to the smallest that shares such a value with
    it, so no chain is lost, a value has 65 members at most, and the links stay in proportion to the members.
    """
    if distance != 2:
        crowd = 1 << 62  # shared neighbours hold for two bits
    masks = _choices(blocks, distance)
    distinct = fps.select("fp").where(F.col("fp").isNotNull()).distinct()
    cases = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for k, m in enumerate(masks)])
    keyed = distinct.select("fp", F.inline(cases))
    sizes = keyed.groupBy("choice", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = keyed.join(sizes, ["choice", "part"])
    small = member.where(F.col("n") <= crowd).select("choice", "part", "fp")
    a, b = small.alias("a"), small.alias("b")
    pairs = (a.join(b, (F.col("a.choice") == F.col("b.choice")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.fp") < F.col("b.fp"))
                    & (_differ(F.col("a.fp"), F.col("b.fp")) <= distance))
             .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")))
    if distance != 2:
        return pairs.distinct()
    bits = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)).cast("long") for i in range(64)])
    free = F.element_at(F.array(*[F.lit(_signed(m)).cast("long") for m in masks]), F.col("choice") + 1)
    near = (member.where(F.col("n") > crowd)
            .select("choice", "fp", F.explode(F.filter(bits, lambda x: x.bitwiseAND(free) == 0)).alias("bit"))
            .select("choice", "fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("value")))
    least = near.groupBy("choice", "value").agg(F.min("fp").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    hubs = (near.join(least, ["choice", "value"]).select(F.col("m").alias("a"), F.col("fp").alias("b"))
            .where((F.col("a") < F.col("b")) & (_differ(F.col("a"), F.col("b")) <= distance)))
    return pairs.unionByName(hubs).distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id (smallest doc_id reachable over links, its own included).

    Documents of equal fingerprint are one class before anything is joined, so copies cost one row. Texts without
    words share the fingerprint zero and are linked like others. A null doc_id never is a component's smallest unless
    all are null.
    """
    fps = stage(fingerprints(docs), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(fps, distance, blocks)).withColumnRenamed("node", "fp")
    rooted = stage(classes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "classes")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(rooted.join(smallest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their component's smallest; rows without a doc_id stay."""
    found = near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))
