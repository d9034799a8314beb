"""Centroid clustering in integers, with heap-ordered bounds.

Vectors lie in blocks. Within a block every cluster keeps a heap of its vectors, ordered by the gap between the distance to
the second nearest and to the nearest centroid, plus the drift that the cluster had accumulated when the gap was measured. A round adds
to a cluster's drift how far its centroid moved and the farthest that any other one did. A vector whose entry is not above the
drift may have changed sides: it is popped and exactly rescanned against all centroids; all others keep their cluster unread. Entries are
compared with a margin far above rounding errors, so clusters are those of a full scan, ties (smaller number) included.

Vectors are written once, bucketed by block; the heaps are a table of their own, bucketed alike, so that a round joins the two
without a shuffle and rewrites about 20 bytes a vector. Sums move by what changed: a block sends, for every cluster that
gained or lost vectors, the difference of its sums, and the driver holds only centroids, sums and drifts.

Components are ``floor(SCALE * x)``, exact integers of any size: floating-point products are used where all are
exact, 64-bit integers beyond, and Python integers beyond those. Sums travel in limbs of ``LIMB`` bits. Distances and inertias above
the range of long are null.

Vectors with another number of components than ``size``, or with a null or non-finite one, are left out; so is a null vector. A null id
counts as empty text in the seeding order and stays null. Rows with equal ids or equal vectors are each kept; equal hashes are ordered by vector. Fewer
vectors than ``k`` give as many centroids as there are vectors. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateworks.llm.storage import shared_folder

SIZE = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
SEED = "2:"
BLOCK = 4096
LIMB = 40
LONG = 2 ** 63 - 1
#: Up to these components products are exact in float64, and distances fit int64.
FLOATS, LONGS = 2 ** 21, 2 ** 27
#: Roots of distances are compared with this margin, relative to their size.
MARGIN = 1e-9
TOP = 1e300


def whole(x: float) -> int:
    """floor(SCALE * x), exactly."""
    return SCALE * int(x) if abs(x) >= 2.0 ** 53 else math.floor(SCALE * x)


def _integers(values: np.ndarray) -> np.ndarray:
    """Rows of doubles as integers: int64 where they are small enough, Python integers where not."""
    if not values.size or np.abs(values).max() <= LONGS // SCALE:
        return np.floor(SCALE * values).astype(np.int64)
    return np.array([[whole(v) for v in row] for row in values.tolist()], object)


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, points by centroids."""
    if points.dtype != object and centroids.dtype != object:
        most = max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0))
        if most <= FLOATS:
            p, c = points.astype(float), centroids.astype(float)
            return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)).astype(np.int64)
    out = np.empty((len(points), len(centroids)), points.dtype if points.dtype == object else centroids.dtype)
    for k, c in enumerate(centroids):
        out[:, k] = ((points - c) ** 2).sum(1)
    return out


def root(n: int) -> float:
    """Square root, at most ``TOP``: beyond it gaps are 0, and such vectors are rescanned each round."""
    return math.sqrt(n) if n < 10 ** 300 else min(float(min(math.isqrt(n), 10 ** 301)), TOP)


def _roots(d: np.ndarray) -> np.ndarray:
    return np.array([root(v) for v in d.tolist()], float) if d.dtype == object else np.sqrt(d.astype(float))


def scanned(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: smaller number) of every point, the roots of its distance, and the gap to the second nearest."""
    d = squared(points, centroids)
    best = np.array([min(range(d.shape[1]), key=row.__getitem__) for row in d], np.int64) if d.dtype == object else d.argmin(1)
    rows = np.arange(len(d))
    near = _roots(d[rows, best])
    if d.shape[1] == 1:
        return best, near, np.full(len(d), np.inf)
    d = d.copy()
    d[rows, best] = d.max() + 1 if d.dtype == object else LONG
    return best, near, _roots(d.min(1)) - near


class Heaps:
    """The heaps of one block, one per cluster, of (gap plus drift at that time, number of the vector)."""

    def __init__(self, clusters: int, keys: np.ndarray | None = None, members: np.ndarray | None = None, sizes: np.ndarray | None = None):
        self.of: list[list[tuple[float, int]]] = [[] for _ in range(clusters)]
        if sizes is not None:
            at = 0
            for c, n in enumerate(sizes.tolist()):
                self.of[c] = list(zip(keys[at:at + n].tolist(), members[at:at + n].tolist()))
                at += n

    def expired(self, drift: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """Pops the vectors whose gap is used up: their numbers, and the clusters that they were in."""
        gone, was = [], []
        for c, heap in enumerate(self.of):
            while heap and heap[0][0] - drift[c] <= margin:
                gone.append(heapq.heappop(heap)[1])
                was.append(c)
        return np.array(gone, np.int64), np.array(was, np.int64)

    def push(self, members: np.ndarray, clusters: np.ndarray, gaps: np.ndarray, drift: np.ndarray) -> None:
        for i, c, g in zip(members.tolist(), clusters.tolist(), gaps.tolist()):
            heapq.heappush(self.of[c], (g + float(drift[c]), i))

    def packed(self) -> list[bytes]:
        return [np.array([k for h in self.of for k, _ in h], float).tobytes(), np.array([i for h in self.of for _, i in h], np.int32).tobytes(), np.array([len(h) for h in self.of], np.int32).tobytes()]

    def clusters(self, n: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        for c, heap in enumerate(self.of):
            out[[i for _, i in heap]] = c
        return out


def _changes(points: np.ndarray, was: np.ndarray, now: np.ndarray, first: bool) -> list[dict]:
    """(cluster, limb, sums by component, count) of what clusters gained and lost; count only with limb 0."""
    moved = np.ones(len(now), bool) if first else was != now
    out = []
    for sign, of in ((1, now), (-1, was)):
        if first and sign < 0:
            continue
        for c in np.unique(of[moved]).tolist():
            rows = points[moved & (of == c)]
            if rows.dtype != object:
                out.append({"cluster": c, "limb": 0, "sums": (sign * rows.sum(0)).tolist(), "count": sign * len(rows)})
                continue
            sums, limb = [sign * sum(col) for col in rows.T.tolist()], 0
            while limb == 0 or any(sums):
                last = all(-(2 ** 62) < s < 2 ** 62 for s in sums)
                out.append({"cluster": c, "limb": limb, "sums": sums if last else [s & (2 ** LIMB - 1) for s in sums], "count": sign * len(rows) if limb == 0 else 0})
                sums, limb = ([0] * len(sums) if last else [s >> LIMB for s in sums]), limb + 1
    return out


_STATE = "block long, keys binary, members binary, sizes binary, rescanned long, changes array<struct<cluster:int,limb:int,sums:array<long>,count:long>>"
_CHANGES = pa.list_(pa.struct([("cluster", pa.int32()), ("limb", pa.int32()), ("sums", pa.list_(pa.int64())), ("count", pa.int64())]))
_STATE_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), _CHANGES]
_STATE_NAMES = ["block", "keys", "members", "sizes", "rescanned", "changes"]


def kept(vectors: DataFrame, id_column: str, vector_column: str, size: int) -> DataFrame:
    """(vec_id, vec) of the vectors that take part, components as doubles."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where((F.size("vec") == size) & finite)


def seeds(rows: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The ``k`` vectors of smallest hash, in that order."""
    text = F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    return [[whole(x) for x in r.vec] for r in rows.orderBy(F.sha2(text.cast("binary"), 256), "vec").limit(k).select("vec").collect()]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (vec_id, vec) as blocks of (block, ids, nulls, vectors)."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            ids = part.column(0)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()),
                                              pa.array([ids.is_null().to_numpy(zero_copy_only=False).tobytes()], pa.binary()),
                                              pa.array([np.asarray(part.column(1).flatten(), float).tobytes()], pa.binary())], ["block", "ids", "nulls", "vecs"])
            number += 1


def _exact(centroids: list[list[int]]) -> np.ndarray:
    most = max((abs(x) for c in centroids for x in c), default=0)
    return np.array(centroids, np.int64 if most <= LONGS else object)


class Clustering:
    """The blocks of one table of vectors and, after ``run``, its clusters."""

    def __init__(self, vectors: DataFrame, k: int = CLUSTERS, size: int = SIZE, seed: str = SEED, id_column: str = "vec_id", vector_column: str = "embedding"):
        self.spark, self.size = vectors.sparkSession, size
        rows = kept(vectors, id_column, vector_column, size)
        self.centroids = seeds(rows, k, seed)
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.run_name = uuid.uuid4().hex
        self.blocks = self._bucketed(rows.mapInArrow(_packed, "block long, ids binary, nulls binary, vecs binary"), "blocks")
        self.rescanned: list[int] = []

    def _bucketed(self, df: DataFrame, label: str, spread: bool = True) -> DataFrame:
        """A table in the shared folder, bucketed by block."""
        name, folder = f"{label}_{self.run_name}", f"{shared_folder(self.spark)}/llm/{label}-{self.run_name}"
        (df.repartition(self.buckets, "block") if spread else df).write.bucketBy(self.buckets, "block").sortBy("block").option("path", folder).saveAsTable(name)
        return self.spark.table(name)

    def _round(self, state: DataFrame | None, drift: np.ndarray, number: int) -> DataFrame:
        centroids, size, k = _exact(self.centroids), self.size, len(self.centroids)
        margin = MARGIN * (1 + max((root(sum(x * x for x in c)) for c in self.centroids), default=0.0) + float(drift.max(initial=0)))
        first = state is None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    block, n = batch.column(0)[i].as_py(), len(batch.column(1)[i].as_py()) // 8
                    vecs = np.frombuffer(batch.column(2)[i].as_py(), float).reshape(n, size)
                    if first:
                        heaps, gone, was = Heaps(k), np.arange(n), np.full(n, -1)
                    else:
                        keys, members, sizes = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in ((3, float), (4, np.int32), (5, np.int32)))
                        heaps = Heaps(k, keys, members, sizes)
                        gone, was = heaps.expired(drift, margin)
                    changes = []
                    if len(gone):
                        points = _integers(vecs[gone])
                        now, near, gaps = scanned(points, centroids)
                        heaps.push(gone, now, gaps - MARGIN * near, drift)
                        changes = _changes(points, was, now, first)
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([block, *heaps.packed(), len(gone), changes], _STATE_TYPES)], _STATE_NAMES)

        rows = self.blocks.select("block", "ids", "vecs")
        if not first:
            rows = rows.join(state.select("block", "keys", "members", "sizes"), "block")
        return self._bucketed(rows.mapInArrow(run, _STATE), f"heaps{number}")

    def run(self, rounds: int = ROUNDS) -> DataFrame:
        """(vec_id, cluster, distance) after ``rounds`` rounds and one more assignment. ``distance`` is a decimal number as text."""
        k = len(self.centroids)
        state, drift = None, np.zeros(k)
        sums, counts = [[0] * self.size for _ in range(k)], [0] * k
        for number in range(rounds + 1):
            state = self._round(state, drift, number)
            self.rescanned.append(state.agg(F.sum("rescanned")).first()[0] or 0)
            if number == rounds:
                break
            change = F.explode("changes").alias("d")
            moved = state.select(change).select("d.cluster", "d.limb", "d.count", F.posexplode("d.sums").alias("at", "sum"))
            for r in moved.groupBy("cluster", "limb", "at").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"), F.sum("count").alias("count")).collect():
                sums[r.cluster][r["at"]] += int(r["sum"]) << (LIMB * r.limb)
                counts[r.cluster] += r["count"] if r["at"] == 0 else 0
            new = [[s // counts[c] for s in sums[c]] if counts[c] else self.centroids[c] for c in range(k)]
            steps = np.array([root(sum((a - b) ** 2 for a, b in zip(x, y))) for x, y in zip(new, self.centroids)])
            top = np.argsort(steps)[::-1]
            farthest = np.array([0.0 if k == 1 else steps[top[1]] if c == top[0] else steps[top[0]] for c in range(k)])
            drift, self.centroids = drift + (steps + farthest) * (1 + MARGIN), new
        return self._assigned(state)

    def _assigned(self, state: DataFrame) -> DataFrame:
        centroids, size, k = _exact(self.centroids), self.size, len(self.centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, nulls = np.frombuffer(batch.column(0)[i].as_py(), np.int64), np.frombuffer(batch.column(1)[i].as_py(), bool)
                    points = _integers(np.frombuffer(batch.column(2)[i].as_py(), float).reshape(len(ids), size))
                    keys, members, sizes = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in ((3, float), (4, np.int32), (5, np.int32)))
                    cluster = Heaps(k, keys, members, sizes).clusters(len(ids))
                    own = centroids[cluster]
                    if points.dtype != object and own.dtype != object and max(np.abs(points).max(initial=0), np.abs(own).max(initial=0)) <= LONGS:
                        distance = ((points - own) ** 2).sum(1)
                    else:
                        distance = ((points.astype(object) - own.astype(object)) ** 2).sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(cluster), pa.array(list(map(str, distance.tolist())))], ["vec_id", "cluster", "distance"])

        rows = self.blocks.join(state.select("block", "keys", "members", "sizes"), "block").select("ids", "nulls", "vecs", "keys", "members", "sizes")
        return rows.mapInArrow(run, "vec_id long, cluster long, distance string")

    def digest(self, assigned: DataFrame) -> DataFrame:
        """Per vector its cluster, the squared distance, the inertias, and the digest of its centroid."""
        assigned = self._bucketless(assigned)
        exact = F.when(F.length("distance") <= 19, F.col("distance").cast("decimal(20,0)"))  # no number with more digits is a long
        sums = {r.cluster: r for r in assigned.groupBy("cluster").agg(F.sum(exact).alias("inertia"), F.bool_or(exact.isNull()).alias("beyond")).collect()}
        inertia = {c: None if r.beyond or r.inertia is None else int(r.inertia) for c, r in sums.items()}
        total = None if None in inertia.values() else sum(inertia.values())
        fit = lambda n: n if n is not None and n <= LONG else None
        rows = [(c, fit(n), fit(total), hashlib.sha256(",".join(map(str, self.centroids[c])).encode()).hexdigest()) for c, n in sorted(inertia.items())]
        of_cluster = self.spark.createDataFrame(rows, "cluster long, cluster_inertia long, inertia long, centroid_sha256 string")
        distance = F.when(exact <= LONG, exact.cast("long")).alias("distance")
        return assigned.join(F.broadcast(of_cluster), "cluster").select("vec_id", F.col("cluster").cast("int").alias("cluster"), distance, "cluster_inertia", "inertia", "centroid_sha256")

    def _bucketless(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/llm/assigned-{self.run_name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, seed: str = SEED) -> DataFrame:
    work = Clustering(vectors, k, size, seed)
    return work.digest(work.run(rounds))
