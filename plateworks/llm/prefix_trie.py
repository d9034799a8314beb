"""Trie of conversation prefixes as balanced parentheses, one encoding per shard.

A conversation is a sequence of turns; a node of the trie is a distinct sequence of first turns, the root the empty one.

1. ``sequences``: one row per conversation with a key of 16 digest bytes per turn and the words of every turn.
   Texts end here; 20 bytes a turn go on.
2. ``encoded``: conversations are range-partitioned and sorted by (key, conv_id), so that subtrees are contiguous. Every task
   writes its part as shards of at most ``SHARD`` nodes and members each: the parentheses of the shard's trie in depth-first order (an open
   bit when a node is entered, a closed one when it is left), words per node, and the members that end at each node. A very common
   first turn is one node in every shard that it reaches; a large group of equal conversations is cut between shards as well.
3. ``nodes``: in every shard, findclose over blocks of excess minima delimits all subtrees, the rank of leaf pairs counts
   leaves, and cumulative arrays give members and savings. A shard's first and last conversation (its spines) are the only nodes that another
   shard can hold too. A node counts as own in the first shard that holds it, and a leaf in the last, so sums over shards are exact.
   Shared spine nodes merge by a digest of their path; all others are final where they are.

Order of turns: by turn (null first), then role, then text digest. Rows with a null conv_id belong to no conversation and are left out; null role
and text are empty. Rows that are repeated are turns of their own. A conversation may have no turns (a member of the root alone).
An empty table gives no nodes. A turn of any length is 20 bytes after step 1; one conversation's turns must fit a row.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateworks.llm.storage import stage

SHARD = 1 << 17
DIGEST = 16
BLOCK = 64
GROUP = 20
HEADS = 4
EMPTY = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of every conversation in order, each with its digest (hexadecimal) and number of words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * DIGEST)
    kept = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"),
                                                             F.regexp_count(text, F.lit(WORD)).alias("words"))
    return kept.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "digest", "words"))).alias("turns"))


def _keyed(sequence: str) -> list:
    key = F.unhex(F.array_join(F.transform(sequence, lambda t: t["digest"]), ""))
    return [key.alias("key"), F.transform(sequence, lambda t: t["words"]).alias("words")]


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, words) of every conversation as it is."""
    return turns(conversations).select("conv_id", *_keyed("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, words) where conversation c begins with the first h = crc32(c) % 4 turns of conversation c - c % 20, followed by its own
    turns after the first h."""
    own = stage(turns(conversations), "turns").select("conv_id", "turns", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    heads = own.where(f"conv_id % {GROUP} = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    begins = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    whole = F.concat(begins, F.slice("turns", F.col("h") + 1, F.size("turns")))
    return own.join(heads, "base", "left").select("conv_id", whole.alias("turns")).select("conv_id", *_keyed("turns"))


def _shared_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // DIGEST
    if a[:n * DIGEST] == b[:n * DIGEST]:
        return n
    low, high = 0, n  # the first turns agree up to low, not up to high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid * DIGEST] == b[:mid * DIGEST] else (low, mid)
    return low


_SHARD_SCHEMA = "shard long, first binary, last binary, at_start boolean, at_end boolean, left_turns int, left_equal boolean, right_turns int, right_equal boolean, n_bits long, bits binary, words binary, n_ends binary, ends binary"


class _Encoder:
    """The shard under construction."""

    def __init__(self, before: bytes | None):
        self.before = before  # the last conversation of the shard before, in this partition
        self.first = self.last = None
        self.bits, self.words, self.ends_at, self.ends = bytearray([1]), [0], [0], []

    def add(self, conv_id: int, key: bytes, words: list[int]) -> None:
        if self.last is None:
            shared, depth, self.first = 0, 0, key
        else:
            shared, depth = (len(key) // DIGEST, len(key) // DIGEST) if key == self.last else (_shared_turns(key, self.last), len(self.last) // DIGEST)
        turns = len(key) // DIGEST
        self.bits += bytes(depth - shared) + b"\1" * (turns - shared)
        self.words += words[shared:]
        self.ends_at += [0] * (turns - shared)
        self.ends_at[-1] += 1  # keys are sorted: the node entered last is the one that a conversation ends at
        self.ends.append(conv_id)
        self.last = key

    def size(self) -> int:
        return max(len(self.words), len(self.ends))

    def row(self, number: int, at_start: bool, after: bytes | None) -> list:
        bits = np.frombuffer(bytes(self.bits) + bytes(len(self.last) // DIGEST + 1), np.uint8)
        left = (None, None) if self.before is None else (_shared_turns(self.before, self.first), self.before == self.first)
        right = (None, None) if after is None else (_shared_turns(self.last, after), self.last == after)
        return [number, self.first, self.last, at_start, after is None, *left, *right, len(bits), np.packbits(bits).tobytes(), np.array(self.words, np.int64).tobytes(),
                np.array(self.ends_at, np.int32).tobytes(), np.array(self.ends, np.int64).tobytes()]


_SHARD_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.bool_(), pa.int32(), pa.bool_(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
_SHARD_NAMES = [c.split()[0] for c in _SHARD_SCHEMA.split(", ")]


def encoded(found: DataFrame, parts: int | None = None, size: int = SHARD) -> DataFrame:
    """One row per shard, numbered in the order of keys. ``parts``: tasks; by default by the number of turns. ``size``: after so many nodes or
    members a shard ends (with the conversation at hand)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard, at_start = TaskContext.get().partitionId() << 32, _Encoder(None), True

        def closed(after):
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(shard.row(number, at_start, after), _SHARD_TYPES)], _SHARD_NAMES)

        for batch in batches:
            for conv_id, key, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if shard.ends and shard.size() >= size:
                    yield closed(key)
                    number, at_start, shard = number + 1, False, _Encoder(shard.last)
                shard.add(conv_id, key, words)
        if shard.last is not None:
            yield closed(None)

    spark = found.sparkSession
    if parts is None:
        n = found.agg(F.sum(F.octet_length("key") / DIGEST + 1)).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n) // size + 1)
    return found.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(run, _SHARD_SCHEMA)


class Parentheses:
    """Balanced parentheses with excess minima of blocks and, above them, of pairs of blocks (a range min-max tree)."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(2 * bits.astype(np.int32) - 1)
        n = -(-len(bits) // BLOCK)
        self.rows = np.full((n, BLOCK), np.iinfo(np.int32).max, np.int32)
        self.rows.ravel()[:len(bits)] = self.excess
        self.levels = [self.rows.min(1)]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            low = np.r_[low, np.full(len(low) % 2, np.iinfo(np.int32).max, np.int32)]
            self.levels.append(np.minimum(low[::2], low[1::2]))

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """For every open position that of its closing parenthesis: the first position behind it with less excess."""
        out = np.empty(len(opens), np.int64)
        for k in range(0, len(opens), 1 << 14):  # bounded memory
            out[k:k + (1 << 14)] = self._close(opens[k:k + (1 << 14)])
        return out

    def _close(self, opens: np.ndarray) -> np.ndarray:
        want, block = self.excess[opens], opens // BLOCK
        hit = (self.rows[block] < want[:, None]) & (np.arange(BLOCK) > (opens % BLOCK)[:, None])
        out = np.where(hit.any(1), block * BLOCK + hit.argmax(1), -1)
        far = np.flatnonzero(out < 0)
        if len(far):
            at = self._next_block(block[far], want[far])
            out[far] = at * BLOCK + (self.rows[at] < want[far][:, None]).argmax(1)
        return out

    def _next_block(self, block: np.ndarray, want: np.ndarray) -> np.ndarray:
        """The first block behind ``block`` whose minimum is below ``want``: up to a right sibling that has one, then down."""
        at, level, found = block.copy(), np.zeros(len(block), np.int64), np.zeros(len(block), bool)
        for k, minima in enumerate(self.levels):
            open_ = np.flatnonzero(~found)
            if not len(open_):
                break
            right = at[open_] + 1
            ok = (at[open_] % 2 == 0) & (right < len(minima))
            ok[ok] = minima[right[ok]] < want[open_[ok]]
            now = open_[ok]
            at[now], level[now], found[now] = at[now] + 1, k, True
            up = open_[~ok]
            at[up] //= 2
        for k in range(len(self.levels) - 1, 0, -1):
            down = np.flatnonzero(level == k)
            if len(down):
                left = 2 * at[down]
                at[down] = np.where(self.levels[k - 1][left] < want[down], left, left + 1)
                level[down] = k - 1
        return at


def _path_digests(key: bytes, turns: int) -> list[bytes]:
    """Digests of the first 0, 1, ... ``turns`` turns."""
    chain, out = hashlib.sha256(), []
    for d in range(turns + 1):
        out.append(chain.copy().digest())
        chain.update(key[d * DIGEST:(d + 1) * DIGEST])
    return out


_NODE_SCHEMA = "shard long, path binary, parent_path binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, repeated_words long, own_words long, ends_sha256 string, first_end long, ends string"
_NODE_NAMES = [c.split()[0] for c in _NODE_SCHEMA.split(", ")]
_NODE_TYPES = [{"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[c.split()[1]] for c in _NODE_SCHEMA.split(", ")]


def _shard_nodes(shard: int, first: bytes, last: bytes, left: int, left_equal: bool, right: int, right_equal: bool, bits: np.ndarray, words: np.ndarray, n_ends: np.ndarray, ends: np.ndarray) -> dict:
    """The nodes of one shard in depth-first order. ``left`` and ``right``: turns shared with the conversations before and after it, -1 for none."""
    opens = np.flatnonzero(bits)
    tree = Parentheses(bits)
    n, depth = len(opens), (tree.excess[opens] - 1).astype(np.int64)
    closes = tree.findclose(opens)
    stop = np.arange(n) + (closes - opens + 1) // 2  # preorder number behind the subtree
    parent = np.full(n, -1, np.int64)
    order = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    for d in range(1, int(depth.max()) + 1):
        above, here = order[bounds[d - 1]:bounds[d]], order[bounds[d]:bounds[d + 1]]
        parent[here] = above[np.searchsorted(above, here) - 1]
    left_spine, right_spine = len(first) // DIGEST, len(last) // DIGEST
    # the nodes of the first conversation are entered first; those of the last one are open at the end
    right_nodes = np.empty(right_spine + 1, np.int64)
    at = n - 1
    for d in range(right_spine, -1, -1):
        right_nodes[d], at = at, parent[at]
    own = np.ones(n, bool)
    own[:left + 1] = False
    leaf = bits[np.minimum(opens + 1, len(bits) - 1)] == 0
    if right >= right_spine:
        leaf[n - 1] = False  # the next shard goes on at this node or below it

    def below(values: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(values)]
        return total[stop] - total[:n]

    n_convs = below(n_ends.astype(np.int64))
    starts = np.r_[0, np.cumsum(n_ends, dtype=np.int64)]
    least = np.full(n, np.iinfo(np.int64).max)
    ending = np.flatnonzero(n_ends)
    least[ending] = ends[starts[ending]]  # members of a node are in order
    for d in range(int(depth.max()), 0, -1):
        here = order[bounds[d]:bounds[d + 1]]
        np.minimum.at(least, parent[here], least[here])
    shas, first_end, pieces = [EMPTY] * n, [None] * n, [None] * n
    split = {int(i) for i in ([right_nodes[-1]] if right_equal else []) + ([left_spine] if left_equal else [])}
    for i in ending.tolist():
        text = ",".join(map(str, ends[starts[i]:starts[i + 1]].tolist()))
        if i in split:
            shas[i], first_end[i], pieces[i] = None, int(ends[starts[i]]), text
        else:
            shas[i] = hashlib.sha256(text.encode()).hexdigest()
    paths: list[bytes | None] = [None] * n
    for d, path in enumerate(_path_digests(first, left) if left >= 0 else []):
        paths[d] = path
    for d, path in enumerate(_path_digests(last, right) if right >= 0 else []):
        paths[right_nodes[d]] = path
    inner = parent >= 0
    children = np.bincount(parent[inner & own], minlength=n)
    parent_conv = [int(least[p]) if p >= 0 and paths[p] is None else None for p in parent.tolist()]
    return {"shard": [shard] * n, "path": paths, "parent_path": [paths[p] if p >= 0 else None for p in parent.tolist()], "conv_id": least, "depth": depth, "parent_conv_id": parent_conv, "n_convs": n_convs,
            "n_children": children, "n_leaves": below(leaf.astype(np.int64)), "repeated_words": below(n_convs * words), "own_words": below(words * own), "ends_sha256": shas, "first_end": first_end, "ends": pieces}


def _edges(shards: DataFrame) -> tuple[dict, dict]:
    """For the first and the last shard of every task what it shares with the neighbouring task's. As many rows as Spark's own range
    partitioning has bounds."""
    rows = shards.where("at_start OR at_end").select("shard", "at_start", "at_end", F.when(F.col("at_start"), F.col("first")).alias("first"), F.when(F.col("at_end"), F.col("last")).alias("last")).orderBy("shard").collect()
    left, right, before = {}, {}, None
    for r in rows:
        if r.at_start and before is not None:
            a, b = bytes(before.last), bytes(r.first)
            left[r.shard] = right[before.shard] = (_shared_turns(a, b), a == b)
        before = r if r.at_end else before
    return left, right


def _end_hashes(pieces: DataFrame) -> DataFrame:
    """(path, ends_sha256) of nodes whose members lie in several shards: the pieces are hashed one after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, chain = None, None
        for batch in batches:
            done = []
            for p, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != path:
                    if path is not None:
                        done.append((path, chain.hexdigest()))
                    path, chain = p, hashlib.sha256(text.encode())
                else:
                    chain.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["path", "whole_sha256"])
        if path is not None:
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([chain.hexdigest()], pa.string())], ["path", "whole_sha256"])

    ordered = pieces.select("path", "ends", "first_end").repartition("path").sortWithinPartitions("path", "first_end").select("path", "ends")
    return ordered.mapInArrow(run, "path binary, whole_sha256 string")


def nodes(shards: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node. ``shards``: a stored table of ``encoded``."""
    left_of, right_of = _edges(shards)
    names = [c for c in _SHARD_NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(k)[i].as_py() for k, name in enumerate(names)}
                left = left_of.get(r["shard"], (-1, False)) if r["at_start"] else (r["left_turns"], r["left_equal"])
                right = right_of.get(r["shard"], (-1, False)) if r["at_end"] else (r["right_turns"], r["right_equal"])
                bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n_bits"])
                out = _shard_nodes(r["shard"], r["first"], r["last"], *left, *right, bits, np.frombuffer(r["words"], np.int64), np.frombuffer(r["n_ends"], np.int32), np.frombuffer(r["ends"], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in zip(_NODE_NAMES, _NODE_TYPES)], _NODE_NAMES)

    found = stage(shards.mapInArrow(run, _NODE_SCHEMA), "trie-nodes")
    shared, local = found.where("path IS NOT NULL"), found.where("path IS NULL")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "repeated_words", "own_words")]
    merged = shared.groupBy("path").agg(F.max("parent_path").alias("parent_path"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *sums, F.max(F.when(F.col("ends_sha256") != EMPTY, F.col("ends_sha256"))).alias("one_sha256"))
    merged = stage(merged.join(_end_hashes(shared.where("ends IS NOT NULL")), "path", "left"), "trie-spines").withColumn("ends_sha256", F.coalesce("whole_sha256", "one_sha256", F.lit(EMPTY)))
    above = merged.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("merged_parent"))
    # a shared node is looked up once per shard that holds it, so no key has more rows than a shard has nodes
    by_shard = shared.select("shard", F.col("path").alias("parent_path")).join(above, "parent_path")
    local = local.join(by_shard, ["shard", "parent_path"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "merged_parent"))
    spines = merged.join(above, "parent_path", "left").withColumn("parent_conv_id", F.col("merged_parent"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("repeated_words") - F.col("own_words")).alias("saved_tokens"), "ends_sha256"]
    return local.select(*columns).unionByName(spines.select(*columns))


def trie(found: DataFrame, parts: int | None = None, size: int = SHARD) -> DataFrame:
    """The nodes over ``found`` (conv_id, key, words)."""
    return nodes(stage(encoded(stage(found, "sequences"), parts, size), "trie-shards"))
