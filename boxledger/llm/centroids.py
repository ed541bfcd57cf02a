"""Centroid clustering (operator 11): exact k-means with heap-ordered bounds.

A vector that was measured against all centroids knows its distance to the nearest one (upper bound later on) and to the
second nearest (lower bound later on). As centroids move, the gap between the two shrinks by no more in a round than the
move of the vector's own centroid and the largest move of another. These drifts add up per cluster, so a vector with gap g,
measured when its cluster's drift was D, keeps its centroid until the drift reaches g + D. Each cluster keeps a heap of these
expiry marks; a round pops only those that its drift has reached, measures just these vectors, and pushes them onto the heap
of their nearest centroid. Sums of clusters change by the vectors that were moved alone.

Vectors are packed into blocks once, bucketed by block; the heaps of a block are a row that is written every round, bucketed
alike, so that rounds join both without a shuffle. A heap is a sorted run (every sorted array is a heap): the expired ones
are its head, and pushes are merged in. Components are integers: sums, distances and ties are exact; bounds are floating
point with a margin, and a vector inside it is measured again.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxledger.llm.common import partitions
from boxledger.session import new_path, remove, scratch, settings

CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
BLOCK = 8192  # vectors of a block
BLOCKS = 4  # of a bucket, about
MOST_BUCKETS = 50_000
LARGEST = 2**27  # components are held to -LARGEST .. LARGEST: a distance over 64 of them fits in a long
MARGIN = 1e-9

STATE = "block bigint, heap array<int>, marks array<double>, sizes array<int>, gains array<bigint>, measured bigint"
RESULT = "object_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>"


def integer_features(objects: DataFrame, dimensions: int, scale: int = SCALE) -> DataFrame:
    """(object_id, features) of the objects with ``dimensions`` finite numbers, as integers floor(scale * x)."""
    x = F.transform("features", lambda v: v.cast("double"))
    good = (F.size("features") == dimensions) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    bound = F.lit(float(LARGEST))
    held = F.transform(x, lambda v: F.floor(F.greatest(-bound, F.least(bound, v * F.lit(float(scale))))).cast("int"))
    return objects.where(F.coalesce(good, F.lit(False))).select(F.col("object_id").cast("bigint").alias("object_id"), held.alias("features"))


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (object_id, features) packed into blocks (block, ids, vectors)."""
    number = TaskContext.get().partitionId() << 33
    ids: list[pa.Array] = []
    vectors: list[np.ndarray] = []

    def packed() -> pa.RecordBatch:
        own = pa.concat_arrays(ids)
        data = np.concatenate(vectors).astype("<i4").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([data], pa.binary())], names=["block", "ids", "vectors"])

    held = 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            some = batch.slice(at, BLOCK)
            ids.append(some.column(0))
            vectors.append(some.column(1).flatten().to_numpy(zero_copy_only=False))
            held += some.num_rows
            if held >= BLOCK:
                yield packed()
                number, ids, vectors, held = number + 1, [], [], 0
    if held:
        yield packed()


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows x centroids; through floating point where every sum is below 2**53."""
    top = float(np.abs(x).max(initial=0)) + float(np.abs(centroids).max(initial=0))
    if x.shape[1] * top * top < 2**52:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    x = x.astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


class Heaps:
    """Heaps of the expiry marks of one block's vectors, one for each cluster, as sorted runs."""

    def __init__(self, k: int, heap: np.ndarray | None = None, marks: np.ndarray | None = None, sizes: np.ndarray | None = None):
        ends = np.cumsum(sizes)[:-1] if sizes is not None else None
        self.vectors = np.split(heap, ends) if sizes is not None else [np.zeros(0, np.int32)] * k
        self.marks = np.split(marks, ends) if sizes is not None else [np.zeros(0)] * k

    def pop(self, cluster: int, drift: float) -> np.ndarray:
        """The vectors whose mark the drift has reached."""
        n = int(np.searchsorted(self.marks[cluster], drift, "right"))
        out = self.vectors[cluster][:n]
        self.vectors[cluster], self.marks[cluster] = self.vectors[cluster][n:], self.marks[cluster][n:]
        return out

    def push(self, cluster: int, vectors: np.ndarray, marks: np.ndarray) -> None:
        order = np.argsort(marks, kind="stable")
        at = np.searchsorted(self.marks[cluster], marks[order], "right")
        self.vectors[cluster] = np.insert(self.vectors[cluster], at, vectors[order])
        self.marks[cluster] = np.insert(self.marks[cluster], at, marks[order])


def settle(x: np.ndarray, heaps: Heaps, centroids: np.ndarray, drift: np.ndarray, first: bool) -> tuple[np.ndarray, int]:
    """Pop what has expired, measure it and push it back; (gains, measured).

    ``gains``: for each cluster the change of its count and of its component sums.
    """
    k = len(centroids)
    popped = [heaps.pop(c, drift[c]) for c in range(k)]
    who = np.arange(len(x), dtype=np.int32) if first else np.concatenate(popped)
    old = np.full(len(x), -1) if first else np.repeat(np.arange(k), [len(p) for p in popped])
    gains = np.zeros((k, 1 + x.shape[1]), np.int64)
    if len(who):
        d = distances(x[who], centroids)
        new = d.argmin(1)  # the smallest number among ties
        near = np.sqrt(d[np.arange(len(who)), new].astype(np.float64))
        d[np.arange(len(who)), new] = np.iinfo(np.int64).max
        far = np.sqrt(d.min(1).astype(np.float64)) if k > 1 else np.full(len(who), np.inf)
        marks = (far - near) - MARGIN * (1 + np.where(np.isfinite(far), far, 0) + near) + drift[new] * (1 - MARGIN)
        for c in range(k):
            heaps.push(c, who[new == c], marks[new == c])
            come, gone = who[(new == c) & (old != c)], who[(old == c) & (new != c)]
            gains[c, 0] = len(come) - len(gone)
            gains[c, 1:] = x[come].sum(0, dtype=np.int64) - x[gone].sum(0, dtype=np.int64)
    return gains, len(who)


def cluster_objects(objects: DataFrame, dimensions: int, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(object_id, cluster, distance, cluster_inertia, inertia, centroid) of every clustered object.

    ``objects``: object_id, features, an array of ``dimensions`` numbers (of page objects: edges, sizes, confidence; of
    document texts: an embedding). Objects with another number of features, a null or a non-finite one take no part. A
    feature x counts as floor(scale * x), held to +-2**27. The first centroids are the objects with the smallest sha256 of
    ``seed:object_id``, as many as there are if fewer than ``clusters``; objects without an id are never among them unless
    ids run out, repeated ids go by features. Each round assigns every object to the nearest centroid (ties: smaller
    number) and replaces the centroid of every cluster that has objects by their floored mean; then objects are assigned
    once more. Repeated rows are objects of their own. ``distance`` is squared; sums that no long holds are null.
    """
    spark = objects.sparkSession
    kept = integer_features(objects, dimensions, scale)
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("object_id").cast("string")), 256)
    found = kept.orderBy(mark.asc_nulls_last(), "features").limit(clusters).collect()
    if not found:
        return spark.createDataFrame([], RESULT)
    centroids = [list(r["features"]) for r in found]
    k = len(centroids)
    buckets = max(1, min(MOST_BUCKETS, max(partitions(spark), -(-objects.count() // (BLOCK * BLOCKS)))))

    def store(df: DataFrame) -> tuple[str, str, DataFrame]:
        name, path = f"boxledger_{uuid.uuid4().hex}", new_path(spark)
        df.write.bucketBy(buckets, "block").sortBy("block").option("path", path).saveAsTable(name)
        return name, path, spark.table(name)

    def drop(name: str, path: str, _: DataFrame) -> None:
        spark.sql(f"DROP TABLE {name}")
        remove(spark, path)

    def step(vectors: DataFrame, state: DataFrame | None, drift: np.ndarray) -> DataFrame:
        c, first = np.array(centroids, np.int64), state is None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    x = np.frombuffer(batch.column("vectors")[i].as_buffer(), "<i4").reshape(-1, dimensions)
                    of = lambda name: batch.column(name)[i].values.to_numpy()  # noqa: B023, E731
                    heaps = Heaps(k) if first else Heaps(k, of("heap"), of("marks"), of("sizes"))
                    gains, measured = settle(x, heaps, c, drift, first)
                    row = [[batch.column("block")[i].as_py()], [np.concatenate(heaps.vectors)], [np.concatenate(heaps.marks)], [np.array([len(v) for v in heaps.vectors], np.int32)], [gains.ravel()], [measured]]
                    kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["block", "heap", "marks", "sizes", "gains", "measured"])

        rows = vectors.select("block", "vectors")
        return (rows if state is None else rows.join(state.select("block", "heap", "marks", "sizes"), "block")).mapInArrow(run, STATE)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, np.int64)  # as they are when the frame is made
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column("vectors")[i].as_buffer(), "<i4").reshape(-1, dimensions)
                sizes = batch.column("sizes")[i].values.to_numpy()
                cluster = np.zeros(len(x), np.int32)
                cluster[batch.column("heap")[i].values.to_numpy()] = np.repeat(np.arange(k, dtype=np.int32), sizes)
                own = np.zeros(len(x), np.int64)
                for j in range(k):
                    own[cluster == j] = distances(x[cluster == j], c[j : j + 1])[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(cluster), pa.array(own)], names=["object_id", "cluster", "distance"])

    # A row holds a whole block, so few of them go to Python at once.
    path = new_path(spark)
    with scratch(spark), settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(BLOCKS)):
        with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(BLOCK)):
            vectors = store(kept.mapInArrow(blocks_of, "block bigint, ids array<bigint>, vectors binary").repartition(buckets, "block"))
        drift, totals = np.zeros(k), [[0] * (1 + dimensions) for _ in range(k)]
        state = store(step(vectors[2], None, drift))
        for _ in range(rounds):
            gains = state[2].select(F.posexplode("gains").alias("at", "gain")).groupBy("at").agg(F.sum("gain").alias("gain"))
            for r in gains.collect():  # clusters x (1 + dimensions) numbers
                totals[r["at"] // (1 + dimensions)][r["at"] % (1 + dimensions)] += r["gain"]
            moved = [[s // n for s in sums] if n else old for (n, *sums), old in zip(totals, centroids, strict=True)]
            if moved == centroids:
                break
            moves = [math.dist(a, b) for a, b in zip(moved, centroids, strict=True)]
            drift = np.array([d + moves[j] + max([0.0, *moves[:j], *moves[j + 1 :]]) for j, d in enumerate(drift)])
            centroids = moved
            before, state = state, store(step(vectors[2], state[2], drift))
            drop(*before)
        assigned = vectors[2].select("block", "ids", "vectors").join(state[2].select("block", "heap", "sizes"), "block")
        assigned.mapInArrow(last, "object_id bigint, cluster int, distance bigint").write.parquet(path)
        drop(*vectors)
        drop(*state)
    result = spark.read.schema("object_id bigint, cluster int, distance bigint").parquet(path)
    total = F.sum(F.col("distance").cast("decimal(19,0)"))
    inertias = {r["cluster"]: r["s"] for r in result.groupBy("cluster").agg(total.alias("s")).collect()}  # a row for each cluster
    fits = lambda n: n if n < 2**63 else None
    whole = fits(int(sum(inertias.values())))
    rows = [(j, fits(int(inertias[j])), whole, centroids[j]) for j in inertias]
    each = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return result.join(F.broadcast(each), "cluster").select("object_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
