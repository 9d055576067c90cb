"""Exact nearest neighbours by cells, and the divergence estimate that rests on them.

Vectors belong to the nearest of a bounded number of pivots. A first pass looks for a query's neighbours in its own cell (or the next one that holds enough vectors) and so
bounds their distance. The second pass visits only cells that can hold a nearer one: none closer to the query than its distance to the pivot
less the cell's radius, nor than half the difference of squared distances to both pivots over the distance of the pivots. In each pass a cell's queries and vectors meet in tiles of
bounded size, so that a hot cell is many tasks' work. Nothing is approximate; in many dimensions few cells can be left out, and the work nears that of all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import checkpoint
from .scores import CLOSE

PIVOTS, TILE = 32, 2048


def pivots(rows: DataFrame, vector: str, count: int = PIVOTS) -> np.ndarray:
    """At most ``count`` distinct vectors of the smallest hashes, whatever the size of the table."""
    some = rows.select(F.col(vector).alias("v")).withColumn("h", F.xxhash64("v")).groupBy("h").agg(F.min("v").alias("v")).orderBy("h").limit(count).collect()
    return np.array([r["v"] for r in some], dtype=float)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of two blocks; from the differences where the product cancels."""
    centre = b.mean(axis=0)
    a, b = a - centre, b - centre
    scale = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)
    out = np.maximum(scale - 2 * a @ b.T, 0)
    r, c = np.nonzero(out < CLOSE * scale)
    for m in range(0, len(r), 4096):
        out[r[m : m + 4096], c[m : m + 4096]] = ((a[r[m : m + 4096]] - b[c[m : m + 4096]]) ** 2).sum(axis=1)
    return out


def _smallest(d: np.ndarray, k: int) -> np.ndarray:
    return np.sort(np.partition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else d, axis=1)


def _met(queries: DataFrame, targets: DataFrame, sizes: DataFrame, k: int, tile: int) -> DataFrame:
    """Rows (qid, near): up to k smallest distances of each query to the vectors of each cell it visits. ``queries``: (qid, g, side, cell, v); ``targets``: (g, side, cell, v)."""
    own = ["g", "side", "cell"]
    cut = lambda n: F.ceil(F.col(n) / F.lit(tile))
    asked = checkpoint(queries.groupBy(*own).agg(F.count(F.lit(1)).alias("asked")))
    told = checkpoint(sizes.join(asked, own).select(F.struct(*own).alias("key"), cut("asked").alias("qs"), cut("n").alias("ts")))
    spread = lambda df, mine, other, salt: df.withColumn("key", F.struct(*own)).join(told, "key").withColumns({mine[0]: F.pmod(F.xxhash64(*salt), F.col(mine[1])), other[0]: F.explode(F.sequence(F.lit(0).cast("long"), F.col(other[1]) - 1))})
    q = spread(queries, ("i", "qs"), ("j", "ts"), ["qid"]).select("key", "i", "j", "qid", "v")
    t = spread(targets, ("j", "ts"), ("i", "qs"), ["tid"]).select("key", "i", "j", F.lit(None).cast("long").alias("qid"), "v")

    def run(table: pa.Table) -> pa.Table:
        qid = table.column("qid").combine_chunks()
        ask = qid.is_valid().to_numpy(zero_copy_only=False)
        lists = table.column("v").combine_chunks()
        x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
        if ask.all() or not ask.any():
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.list_(pa.float64()))], names=["qid", "near"])
        near = np.sqrt(_smallest(_squares(x[ask], x[~ask]), k))
        return pa.table([qid.filter(pa.array(ask)), pa.array(list(near), pa.list_(pa.float64()))], names=["qid", "near"])

    return q.unionByName(t).groupBy("key", "i", "j").applyInArrow(run, "qid long, near array<double>")


def neighbour_distances(queries: DataFrame, targets: DataFrame, k: int, centres: np.ndarray, tile: int = TILE) -> DataFrame:
    """Rows (qid, distance): to the k-th nearest vector, a query's own copy among the targets included. ``queries``: (qid, g, side, v), of which side names that of the vectors asked for; ``targets``: (g, side, v, tid).

    A query whose group has fewer than k vectors of that side has no row.
    """
    between = np.sqrt(_squares(centres, centres))

    def to_pivots(batches):
        for batch in batches:
            if batch.num_rows:
                lists = batch.column(batch.num_columns - 1)
                d = np.sqrt(_squares(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1), centres))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(d), pa.list_(pa.float64())), pa.array(d.argmin(axis=1).astype(np.int32))], [*batch.schema.names, "far", "cell"])

    def placed(df: DataFrame, names: list[str]) -> DataFrame:
        rows = df.select(*names, F.col("v").cast("array<double>").alias("v"))
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        return checkpoint(rows.mapInArrow(to_pivots, f"{kinds}, far array<double>, cell int"))

    asked, held = placed(queries, ["qid", "g", "side"]), placed(targets, ["tid", "g", "side"])
    sizes = checkpoint(held.groupBy("g", "side", "cell").agg(F.count(F.lit(1)).alias("n"), F.max(F.get("far", F.col("cell"))).alias("radius")))
    cells = checkpoint(sizes.groupBy("g", "side").agg(F.collect_list(F.struct("cell", "n", "radius")).alias("cells")).withColumn("key", F.struct("g", "side")).select("key", "cells"))
    known = asked.withColumn("key", F.struct("g", "side")).join(cells, "key").drop("key")
    full = F.filter("cells", lambda c: c["n"] >= k)
    first = F.array_min(F.transform(full, lambda c: F.struct(F.get("far", c["cell"]).alias("d"), c["cell"].alias("cell"))))["cell"]
    known = checkpoint(known.withColumn("first", first))
    # Without a cell of k vectors there is no bound, and all cells are visited.
    one = _met(known.filter("first IS NOT NULL").select("qid", "g", "side", F.col("first").alias("cell"), "v"), held, sizes, k, tile)
    one = checkpoint(one.groupBy("qid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near")))
    bounded = known.join(one, "qid", "left").withColumn("bound", F.when(F.size("near") >= k, F.get("near", F.lit(k - 1))))
    apart = F.lit([[float(x) for x in row] for row in between])
    own, d = F.col("cell"), lambda c: F.get("far", c["cell"])
    gap = lambda c: F.get(F.get(apart, F.col("cell")), c["cell"])
    plane = lambda c: F.when(gap(c) > 0, (d(c) * d(c) - F.get("far", own) * F.get("far", own)) / (2 * gap(c))).otherwise(0.0)
    slack = 1 + 1e-9
    may = lambda c: F.col("bound").isNull() | ((c["cell"] != F.col("first")) & (F.greatest(d(c) - c["radius"], plane(c)) <= F.col("bound") * slack + 1e-9))
    visits = bounded.select("qid", "g", "side", "v", F.explode(F.filter("cells", may)).alias("c")).select("qid", "g", "side", F.col("c.cell").alias("cell"), "v")
    two = _met(checkpoint(visits), held, sizes, k, tile)
    found = one.unionByName(two).groupBy("qid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return found.filter(F.size("near") >= k).select("qid", F.get("near", F.lit(k - 1)).alias("distance"))


def knn_kl(rows: DataFrame, by: list[str], side: str, vector: str, k: int = 5, count: int = PIVOTS, tile: int = TILE) -> DataFrame:
    """Per group, the k-nearest-neighbour estimate of Wang, Kulkarni and Verdu of the divergence of its draws of side 0 from those of side 1.

    Repeated draws have distance zero, which counts as the smallest double. A group with at most k draws of side 0 or fewer than k of side 1 has a null estimate.
    """
    named = rows.select(F.struct(*by).alias("g"), F.col(side).cast("int").alias("side"), F.col(vector).cast("array<double>").alias("v"))
    counts = checkpoint(named.groupBy("g").agg(F.count_if(F.col("side") == 0).cast("double").alias("p"), F.count_if(F.col("side") == 1).cast("double").alias("q"), F.max(F.size("v")).alias("dims")))
    centres = pivots(named, "v", count)
    if not len(centres):
        return counts.select(*[F.col("g")[c].alias(c) for c in by], F.lit(None).cast("double").alias("kl"))
    # Numbers that tell repeated draws apart are fixed once.
    held = checkpoint(named.withColumn("tid", F.monotonically_increasing_id()))
    asked = held.filter("side = 0").select(F.col("tid").alias("qid"), "g", "side", "v")
    own = neighbour_distances(asked, held.filter("side = 0"), k + 1, centres, tile).withColumnRenamed("distance", "own")
    other = neighbour_distances(asked.withColumn("side", F.lit(1)), held.filter("side = 1"), k, centres, tile).withColumnRenamed("distance", "other")
    least = F.lit(float(np.finfo(float).tiny))
    log = F.ln(F.greatest("other", least)) - F.ln(F.greatest("own", least))
    sums = asked.select("qid", "g").join(own, "qid").join(other, "qid").groupBy("g").agg(F.avg(log).alias("log"))
    kl = F.when((F.col("p") > k) & (F.col("q") >= k), F.col("dims") * F.col("log") + F.ln(F.col("q") / (F.col("p") - 1)))
    return counts.join(sums, "g", "left").select(*[F.col("g")[c].alias(c) for c in by], kl.alias("kl"))
