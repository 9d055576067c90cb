"""Centroid clustering by partial-distance search, in whole numbers, so that every run gives the same result.

A vector's components become floor(scale * x). Assignment walks the centroids in ascending order for a batch of vectors at once: squared
differences are added up over the dimensions of the highest variance first, a few at a time, and a centroid is abandoned for a vector as soon as
its sum is strictly above the best distance so far. Survivors finish all dimensions, so that distances are exact; at equal distances the smaller
number stays. A task holds a batch of vectors and the centroids; a round sends one row of sums a task and cluster, and the driver holds
``k`` centroids of ``dims`` numbers, whatever the size of the table.

Defined results. Kept are vectors with exactly ``dims`` components, none null, NaN or infinite; others have no row. Repeated rows are vectors of
their own, a null id counts as the empty text when the first centroids are drawn. With fewer than ``k`` kept vectors there are as many centroids;
an empty table gives an empty one. Components beyond 2**27 in size count as that, so that distances fit 64 bits. Other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import checkpoint

K, DIMS, ROUNDS, SCALE, SEED = 16, 64, 3, 64, 1
LARGEST = 1 << 27
#: Dimensions that are added up between two looks at the best distance, and vectors held at a time.
STEP, HELD = 8, 8192


def kept(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = DIMS) -> DataFrame:
    """Rows (id, v) of the vectors that take part, their components as doubles."""
    v = F.col(vector).cast("array<double>")
    good = F.forall("v", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return table.select(F.col(vec_id).alias("id"), v.alias("v")).filter((F.size("v") == dims) & good)


def _whole(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return np.clip(np.floor(scale * flat), -LARGEST, LARGEST).astype(np.int64)


def assign(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its squared distance; ``order``: the dimensions, those first that part the vectors most."""
    x, c = np.ascontiguousarray(x[:, order].T), centroids[:, order]
    first = c[0][:, None]
    best, where = ((x - first) ** 2).sum(axis=0), np.zeros(x.shape[1], dtype=np.int32)
    for j in range(1, len(c)):
        live = np.arange(x.shape[1])
        total = np.zeros(len(live), dtype=np.int64)
        for at in range(0, len(order), STEP):
            part = x[at : at + STEP] if len(live) == x.shape[1] else x[at : at + STEP, live]
            total = total + ((part - c[j, at : at + STEP, None]) ** 2).sum(axis=0)
            stay = total <= best[live]
            if not stay.all():
                live, total = live[stay], total[stay]
            if not len(live):
                break
        else:
            nearer = total < best[live]
            best[live[nearer]], where[live[nearer]] = total[nearer], j
    return where, best


def _runs(batches, dims: int, scale: int):
    for batch in batches:
        for at in range(0, batch.num_rows, HELD):
            part = batch.slice(at, HELD)
            yield part, _whole(part.column(1), dims, scale)


def _first(rows: DataFrame, k: int, seed: int, dims: int, scale: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in that order; equal ids by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    top = rows.withColumn("h", digest).orderBy("h", "v").limit(k).select("id", "v").toArrow()
    return _whole(top.column(1).combine_chunks(), dims, scale) if top.num_rows else np.zeros((0, dims), np.int64)


def _by_variance(rows: DataFrame, dims: int, scale: int) -> np.ndarray:
    """All dimensions, those of the highest variance first; it settles how fast the search is, not what it finds."""

    def run(batches):
        n, one, two = 0, np.zeros(dims), np.zeros(dims)
        for _, x in _runs(batches, dims, scale):
            n, one, two = n + len(x), one + x.sum(axis=0), two + (x.astype(np.float64) ** 2).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, n, np.int64)), pa.array(one), pa.array(two)], ["d", "n", "one", "two"])

    sums = rows.mapInArrow(run, "d int, n long, one double, two double").groupBy("d").agg(*[F.sum(c).alias(c) for c in ("n", "one", "two")])
    return np.array([r.d for r in sums.orderBy((F.col("two") / F.col("n") - F.pow(F.col("one") / F.col("n"), 2)).desc(), "d").select("d").collect()], dtype=np.int64)


def _moved(rows: DataFrame, centroids: np.ndarray, order: np.ndarray, scale: int) -> np.ndarray:
    """Centroids moved to the exact floored means of their vectors; one without vectors stays."""
    k, dims = centroids.shape

    def run(batches):
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, x in _runs(batches, dims, scale):
            where, _ = assign(x, centroids, order)
            n += np.bincount(where, minlength=k)
            for j in np.unique(where):
                total[j] += x[where == j].sum(axis=0)
        some = np.flatnonzero(n)
        at = np.repeat(some, dims)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(some))), pa.array(n[at]), pa.array(total[some].reshape(-1))], ["j", "d", "n", "total"])

    sums = rows.mapInArrow(run, "j int, d int, n long, total long").groupBy("j", "d").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = centroids.copy()
    for r in sums.collect():
        out[r.j, r.d] = r.total // r.n
    return out


def cluster(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, dims: int = DIMS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """Rows (id, cluster, distance), checkpointed, and the final centroids."""
    rows = kept(table, vec_id, vector, dims)
    id_type = rows.schema["id"].dataType.simpleString()
    centroids = _first(rows, k, seed, dims, scale)
    if not len(centroids):
        return rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    order = _by_variance(rows, dims, scale)
    for _ in range(rounds):
        centroids = _moved(rows, centroids, order, scale)

    def run(batches):
        for part, x in _runs(batches, dims, scale):
            where, best = assign(x, centroids, order)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(where), pa.array(best)], ["id", "cluster", "distance"])

    return checkpoint(rows.mapInArrow(run, f"id {id_type}, cluster int, distance long")), centroids


def report(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows of :func:`cluster` with each cluster's inertia, the sum of all, and a hash of the cluster's centroid."""
    sums = dict(found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect())
    told = [(j, sums.get(j, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    named = found.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster")
