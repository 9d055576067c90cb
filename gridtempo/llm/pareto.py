"""Pareto frontier layers by longest dominance chains, with tasks of bounded size.

A vector's layer is the length of the longest chain of vectors, each dominating the next, that ends with it. Within a task the chain programme
goes through the vectors in price order (ties by the other measures, so that whatever dominates a vector comes before it), asks nested sparse
Fenwick trees over the other three measures for the largest layer in the vector's orthant, and adds one. An entry that another one of the same
tree already answers for isn't stored, and nothing beyond the deepest layer asked for is.

No group passes one task. Only vectors of at most ``most`` layers matter, and all that dominate such a vector are such themselves. A chain
within any part of a group bounds the layer from below, so that a group of more than ``block`` vectors is dealt by hash into parts of about that many,
each part drops what is beyond ``most`` already among its own, and the rest is dealt anew. A group that fits a block is solved there. One that stops
shrinking above that is cut into slabs in price order: each slab is solved, sends its vectors to the later slabs (one task for each pair of slabs,
two blocks at most), and is solved again with the bounds found, until no layer rises. The bounds are right up to layer r after r rounds, so that
there are at most ``most`` + 1 of them. Rows sent grow with the number of slabs of such a group.

The driver gets counts alone. Smaller is better in every column of ``dims``; rows are distinct on scope and dims, without nulls.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import checkpoint, settled

MOST, BLOCK = 24, 32_768
#: Scopes whose counts are broadcast; more are joined by a shuffle.
FEW_SCOPES = 10_000
#: What a part must lose to be dealt once more.
SHRINK = 0.9
NULL = (1 << 63) - 1


class Orthants:
    """Nested sparse Fenwick trees: the largest value stored at or below given ranks in three dimensions."""

    def __init__(self, ranks: np.ndarray, most: int):
        self.order = np.argsort(ranks.max(axis=0, initial=0), kind="stable")
        self.tops = [int(x) for x in ranks.max(axis=0, initial=0)[self.order]]
        self.most, self.root = most, {}
        self.down = [[self._down(r) for r in range(m + 1)] for m in self.tops]
        self.up = [[self._up(r, m) for r in range(m + 1)] for m in self.tops]

    @staticmethod
    def _down(r: int) -> list[int]:
        """Nodes that make up the ranks 1 to r, the widest first, which is the likeliest to answer at once."""
        out = []
        while r:
            out.append(r)
            r &= r - 1
        return out[::-1]

    @staticmethod
    def _up(r: int, top: int) -> list[int]:
        out = []
        while 0 < r <= top:
            out.append(r)
            r += r & -r
        return out

    def largest(self, at) -> int:
        a, b, c = (self.down[k][at[k]] for k in range(3))
        best, most = 0, self.most
        for i in a:
            middle = self.root.get(i)
            if middle:
                for j in b:
                    inner = middle.get(j)
                    if inner:
                        for k in c:
                            x = inner.get(k, 0)
                            if x > best:
                                best = x
                                if best >= most:
                                    return best
        return best

    def put(self, at, value: int) -> None:
        c, up = self.down[2][at[2]], self.up[2][at[2]]
        for i in self.up[0][at[0]]:
            middle = self.root.setdefault(i, {})
            for j in self.up[1][at[1]]:
                inner = middle.setdefault(j, {})
                for k in c:
                    if inner.get(k, 0) >= value:
                        break
                else:
                    for k in up:
                        if inner.get(k, 0) < value:
                            inner[k] = value


def _ranks(points: np.ndarray) -> np.ndarray:
    return np.stack([np.unique(points[:, k], return_inverse=True)[1] + 1 for k in range(1, 4)], axis=1) if len(points) else np.zeros((0, 3), np.int64)


def price_order(points: np.ndarray) -> np.ndarray:
    return np.lexsort(points.T[::-1])


def chains(points: np.ndarray, most: int, least: np.ndarray | None = None) -> np.ndarray:
    """The layer of each of the distinct points, ``most`` + 1 for all beyond; ``least``: bounds known from elsewhere."""
    out = np.zeros(len(points), dtype=np.int64)
    ranks = _ranks(points)
    trees = Orthants(ranks, most)
    at = ranks[:, trees.order].tolist()
    for i in price_order(points).tolist():
        own = trees.largest(at[i]) + 1
        if least is not None and least[i] > own:
            own = int(least[i])
        if own <= most:
            trees.put(at[i], own)
            out[i] = own
        else:
            out[i] = most + 1
    return out


def _points(table: pa.Table, dims: list[str]) -> np.ndarray:
    return np.stack([table.column(d).to_numpy() for d in dims], axis=1).astype(np.int64)


def _with(table: pa.Table, keep: np.ndarray, **columns: np.ndarray) -> pa.Table:
    for name, values in columns.items():
        at = table.schema.get_field_index(name)
        table = table.set_column(at, name, pa.array(values)) if at >= 0 else table.append_column(name, pa.array(values))
    return table.filter(pa.array(keep))


def dominance_layers(rows: DataFrame, scope: str, dims: list[str], most: int = MOST, block: int = BLOCK) -> DataFrame:
    """Rows (scope, *dims, layer) of all vectors whose layer within their scope is at most ``most``, checkpointed."""
    kinds = f"{scope} {rows.schema[scope].dataType.simpleString()}, " + ", ".join(f"{d} long" for d in dims)
    live = checkpoint(rows.select(scope, *[F.col(d).cast("long").alias(d) for d in dims]))
    n, seed = live.count(), 0

    def sieve(table: pa.Table) -> pa.Table:
        return _with(table.select([scope, *dims]), chains(_points(table, dims), most) <= most)

    def solve(table: pa.Table) -> pa.Table:
        layer = chains(_points(table, dims), most)
        return _with(table.select([scope, *dims]), layer <= most, layer=layer)

    while True:
        sizes = checkpoint(live.groupBy(scope).agg(F.count(F.lit(1)).alias("__n")))
        if sizes.filter(F.col("__n") > block).isEmpty():
            return checkpoint(live.groupBy(scope).applyInArrow(solve, f"{kinds}, layer long"))
        told = F.broadcast(sizes) if sizes.count() <= FEW_SCOPES else sizes
        dealt = live.join(told, scope)
        if seed and now > SHRINK * n:
            small = dealt.filter(F.col("__n") <= block).drop("__n").groupBy(scope).applyInArrow(solve, f"{kinds}, layer long")
            return checkpoint(small.unionByName(_by_slabs(dealt.filter(F.col("__n") > block).drop("__n"), scope, dims, most, block, kinds)))
        n, seed = now if seed else n, seed + 1
        part = F.pmod(F.xxhash64(*dims, F.lit(seed)), F.ceil(F.col("__n") / F.lit(block)))
        live = checkpoint(dealt.withColumn("__part", part).groupBy(scope, "__part").applyInArrow(sieve, kinds))
        now = live.count()


def _by_slabs(rows: DataFrame, scope: str, dims: list[str], most: int, block: int, kinds: str) -> DataFrame:
    """Layers of scopes of any size: slabs in price order, solved again with what earlier slabs tell until no layer rises."""
    rows = checkpoint(rows)
    count = -(-rows.count() // max(1, block // 2))
    state = checkpoint(rows.repartitionByRange(count, scope, *dims).withColumn("slab", F.spark_partition_id()).withColumn("layer", F.lit(1).cast("long")))
    slabs = checkpoint(state.select(scope, "slab").distinct())
    pairs = checkpoint(slabs.join(slabs.select(scope, F.col("slab").alias("later")), scope).filter("slab < later"))

    def solve(table: pa.Table) -> pa.Table:
        points = _points(table, dims)
        known = table.column("layer").to_numpy()
        own, place = np.unique(points, axis=0, return_inverse=True)
        place = place.reshape(-1)
        least = np.zeros(len(own), dtype=np.int64)
        np.maximum.at(least, place, known)
        layer = chains(own, most, least)[place]
        first = np.zeros(len(points), dtype=bool)
        first[np.flatnonzero(table.column("old").to_numpy(zero_copy_only=False))] = True
        return _with(table.select([scope, *dims, "slab", "layer", "rose"]), first, layer=layer, rose=layer > known)

    def across(table: pa.Table) -> pa.Table:
        """Bounds on the later slab's vectors from an earlier slab's."""
        points, source = _points(table, dims), table.column("source").to_numpy(zero_copy_only=False)
        layer = table.column("layer").to_numpy().copy()
        ranks = _ranks(points)
        trees = Orthants(ranks, most)
        at = ranks[:, trees.order].tolist()
        told = np.flatnonzero(source)
        for i in told[np.argsort(-layer[told], kind="stable")].tolist():
            trees.put(at[i], int(layer[i]))
        asked = np.flatnonzero(~source)
        layer[asked] = np.maximum(layer[asked], [trees.largest(at[i]) + 1 for i in asked.tolist()])
        out = _with(table.select([scope, *dims, "later", "layer"]), ~source & (layer > table.column("layer").to_numpy()), layer=layer)
        return out.rename_columns([scope, *dims, "slab", "layer"])

    told = state.withColumn("old", F.lit(True)).withColumn("rose", F.lit(True))
    for _ in range(most + 2):
        state = settled(told.groupBy(scope, "slab").applyInArrow(solve, f"{kinds}, slab int, layer long, rose boolean"))
        moved = checkpoint(state.filter("rose").select(scope, "slab").distinct()) if _ else slabs
        open_pairs = pairs.join(moved, [scope, "slab"], "left_semi")
        sent = state.filter(F.col("layer") <= most).join(open_pairs, [scope, "slab"]).select(scope, *dims, "slab", "later", "layer", F.lit(True).alias("source"))
        asked = state.filter(F.col("layer") <= most).withColumnRenamed("slab", "later").join(open_pairs, [scope, "later"]).select(scope, *dims, "slab", "later", "layer", F.lit(False).alias("source"))
        bounds = sent.unionByName(asked).groupBy(scope, "slab", "later").applyInArrow(across, f"{kinds}, slab int, layer long")
        bounds = checkpoint(bounds.groupBy(scope, "slab", *dims).agg(F.max("layer").alias("layer")))
        if bounds.isEmpty():
            break
        flags = lambda df, old: df.select(scope, *dims, "slab", "layer", F.lit(old).alias("old"), F.lit(False).alias("rose"))
        told = flags(state, True).unionByName(flags(bounds, False))
    return state.filter(F.col("layer") <= most).select(scope, *dims, "layer")


def _floor_div(a: Column, b: Column) -> Column:
    """floor(a / b) of whole numbers, exactly; null for a divisor of zero."""
    b = F.nullif(b, F.lit(0).cast("long"))
    top, low = F.when(b < 0, -a).otherwise(a), F.abs(b)
    return F.when(b.isNotNull(), F.call_function("div", top - F.pmod(top, low), low)).cast("long")


def _hundredths(x: str) -> Column:
    """floor(100 x + 0.5) in doubles; null for null, NaN and infinite values and those beyond 64 bits."""
    v = F.floor(F.lit(100.0) * F.col(x).cast("double") + F.lit(0.5))
    raw = F.lit(100.0) * F.col(x).cast("double") + F.lit(0.5)
    return F.when(~F.isnan(raw) & (F.abs(raw) < F.lit(9e18)), v)


def offers(lines: DataFrame, sales: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each pair of item and vendor: item_id, vendor_id, part_type, price, discount, delay, quantity.

    Repeated lines all count; of a repeated sale the earliest date does, of a repeated item the row of the smallest price (nulls last), then kind.
    A line without its sale lacks a date alone, an item without its row has neither price nor type. NaN and infinite numbers count as lacking.
    """
    c, d, q = F.col("c"), F.col("d"), F.col("quantity").cast("long")
    own = lines.select("sale_id", "item_id", "vendor_id", "quantity", _hundredths("amount").alias("c"), _hundredths("discount").alias("d"), F.to_date("shipped_at").alias("shipped")).filter("item_id IS NOT NULL AND vendor_id IS NOT NULL")
    # Parted from its aggregate, so that both sides of the join are plain exchanges: a sale may have a third of all lines.
    dates = checkpoint(sales.filter("sale_id IS NOT NULL").groupBy("sale_id").agg(F.to_date(F.min("sold_at")).alias("sold")))
    days = F.datediff("shipped", "sold")
    whole = c.isNotNull() & d.isNotNull() & q.isNotNull()
    sums = own.join(dates, "sale_id", "left").groupBy("item_id", "vendor_id").agg(
        F.sum(F.when(whole, c * (100 - d))).alias("worth"), F.sum(F.when(whole, q)).alias("sold"), F.sum("d").alias("d"), F.count("d").alias("nd"),
        F.sum(days.cast("long")).alias("days"), F.count(days).alias("ndays"), F.max(q).alias("quantity"),
    )
    known = items.filter("item_id IS NOT NULL").select("item_id", F.struct(_hundredths("price").isNull().alias("none"), _hundredths("price").alias("p"), F.col("kind").alias("kind")).alias("i")).groupBy("item_id").agg(F.min("i").alias("i"))
    p = F.when(F.col("i.p") >= 1, F.col("i.p"))
    return sums.join(known, "item_id", "left").select(
        "item_id", "vendor_id", F.col("i.kind").alias("part_type"), _floor_div(F.col("worth"), p * F.col("sold")).alias("price"), _floor_div(F.col("d"), F.col("nd")).alias("discount"),
        _floor_div(F.col("days"), F.col("ndays")).alias("delay"), "quantity",
    )


DIMS = ["x1", "x2", "x3", "x4"]


def layered(offered: DataFrame, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """``offered`` with type_layer, global_layer (0 beyond ``most``) and n_equal. Null measures are worse than all numbers and equal to one another."""
    worse = [F.coalesce(x.cast("long"), F.lit(NULL)) for x in (F.col("price"), -F.col("discount"), F.col("delay"), -F.col("quantity"))]
    offered = checkpoint(offered.withColumns(dict(zip(DIMS, worse, strict=True))).withColumn("__scope", F.when(F.col("part_type").isNull(), "n").otherwise(F.concat(F.lit("t"), F.col("part_type")))))
    typed = checkpoint(offered.groupBy("__scope", *DIMS).agg(F.count(F.lit(1)).alias("n")))
    whole = checkpoint(typed.groupBy(*DIMS).agg(F.sum("n").alias("n_equal")))
    found = dominance_layers(typed.select("__scope", *DIMS).unionByName(whole.select(F.lit("g").alias("__scope"), *DIMS)), "__scope", DIMS, most, block)
    everywhere = whole.join(found.filter("__scope = 'g'").select(*DIMS, F.col("layer").alias("global_layer")), DIMS, "left")
    own = typed.select("__scope", *DIMS).join(found.select("__scope", *DIMS, F.col("layer").alias("type_layer")), ["__scope", *DIMS], "left")
    both = checkpoint(own.join(everywhere, DIMS).select("__scope", *DIMS, "n_equal", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("type_layer", "global_layer")]))
    return offered.join(both, ["__scope", *DIMS]).drop("__scope", *DIMS)
