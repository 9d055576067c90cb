"""R-hat and effective sample sizes of chains of any length (Vehtari et al. 2021), spread over tasks of bounded size.

Draws are ranked over a site by :mod:`ranking`, once for each distinct value, and meet all that depends on their value in one join; chain means and variances are
aggregates. Autocovariances come from blocks of ``block`` draws, packed into a row each; a task adds up its own blocks' products. For the lags from d to d + 1 blocks, a task has a block and the two that lie d and d + 1 blocks later, whatever the length of the chain.
Distances are taken in rounds, each twice as far as the last, until the pairs of lags that Geyer's initial monotone sequence adds up have turned negative
in every site, so that only chains which stay correlated over long stretches are read far.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import mathx
from ..lineage import checkpoint
from . import ranking

BLOCK = 4096
SIZED, SPREAD = ("bulk", "low", "high"), ("bulk", "fold", "low", "high")


def _score(before: str, n: str) -> Column:
    """The normal score of the mean rank of ``n`` equal values after ``before`` smaller ones, of ``total``."""
    return mathx.col(mathx.ppf(f"(({before} + ({n} + 1) / 2 - 0.375D) / (total + 0.25D))"))


def _split_draws(draws: DataFrame, site: list[str], chain: str, draw: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Rows (s, c, half, t, x, h; half is null for an odd chain's middle draw) and sites (s, m, length). A draw counts if all chains of its site have a value for it."""
    named = draws.select(F.struct(*site).alias("s"), F.col(chain).alias("c"), F.col(draw).alias("d"), F.col(value).cast("double").alias("x"))
    rows = checkpoint(named)
    chains = checkpoint(rows.groupBy("s", "c").agg(F.lit(1).alias("one")).groupBy("s").agg(F.count("one").alias("m")))
    valued = rows.filter(F.col("x").isNotNull() & ~F.isnan("x"))
    # A value for each chain is what a draw's row holds.
    listed = checkpoint(valued.groupBy("s", "d").agg(F.collect_list(F.struct("c", "x")).alias("e")))
    shared = listed.join(chains, "s").filter(F.size("e") == F.col("m")).select("s", "d", "e")
    placed = ranking.placed(shared, ["s"], "d", "t")
    lengths = placed.groupBy("s").agg(F.count(F.lit(1)).alias("length"))
    sites = checkpoint(chains.join(lengths, "s", "left").withColumn("length", F.coalesce("length", F.lit(0).cast("long"))))
    kept = placed.join(sites.filter("length >= 4"), "s").select("s", "t", "length", F.explode("e").alias("e"))
    h = F.expr("length div 2")
    half = F.when(F.col("t") < h, 0).when(F.col("t") >= F.col("length") - h, 1)
    t = F.when(half == 1, F.col("t") - (F.col("length") - h)).otherwise(F.col("t"))
    return checkpoint(kept.select("s", "e.c", half.alias("half"), t.alias("t"), "e.x", h.alias("h"))), sites


def _values(kept: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows (s, x, bulk, fold, low, high), checkpointed: normal scores of each distinct value and of its distance from the site's median, and whether it is in the tails."""
    counted = kept.groupBy("s", "x").agg(F.count(F.lit(1)).alias("all"), F.count("half").alias("n"))
    found = ranking.cumulated(counted, ["s"], "x", {"all": "below", "n": "before"})
    long = sites.filter("length >= 4").withColumn("total", F.expr("2 * m * (length div 2)"))
    place = lambda q: F.lit(q) * (F.col("m") * F.col("length") - 1)
    one = lambda n, p: F.struct(F.lit(n).alias("name"), p.cast("long").alias("place"))

    def at(n: str, before: str, places: list[Column]) -> DataFrame:
        told = found.select("s", "x", F.col(n).alias("__n"), F.col(before).alias("__before"))
        return ranking.at_positions(told, ["s"], long.select("s", F.array(*places).alias("places")), "x")

    # Quantiles of all draws, interpolated between order statistics; the median and the ranks are of those in halves.
    ends = at("all", "below", [one(f"{side}{q}", end(place(q / 100))) for q in (5, 95) for side, end in (("a", F.floor), ("b", F.ceil))])
    middle = at("n", "before", [one(n, F.expr(p)) for n, p in (("a", "total div 2 - 1"), ("b", "total div 2"))]).groupBy("s").agg(F.avg("x").alias("median"))
    wide = ends.groupBy("s").agg(*[F.max(F.when(F.col("name") == n, F.col("x"))).alias(n) for n in ("a5", "b5", "a95", "b95")]).join(long, "s").join(middle, "s")
    told = checkpoint(wide.select("s", "total", "median", *[ranking.interpolated(F.col(f"a{q}"), F.col(f"b{q}"), place(q / 100) - F.floor(place(q / 100))).alias(n) for q, n in ((5, "q05"), (95, "q95"))]))
    low, high = ((F.col("x") <= F.col(q)).cast("double").alias(n) for q, n in (("q05", "low"), ("q95", "high")))
    scored = checkpoint(found.filter("n > 0").join(told, "s").select("s", "x", "n", "total", F.abs(F.col("x") - F.col("median")).alias("far"), _score("before", "n").alias("bulk"), low, high))
    folded = ranking.cumulated(scored.groupBy("s", "far").agg(F.sum("n").alias("k"), F.max("total").alias("total")), ["s"], "far", {"k": "before"})
    fold = folded.select(F.struct("s", "far").alias("at"), _score("before", "k").alias("fold"))
    return checkpoint(scored.withColumn("at", F.struct("s", "far")).join(fold, "at").select("s", "x", "bulk", "fold", "low", "high"))


def _packed(rows: DataFrame, block: int) -> DataFrame:
    """Rows (s, c, half, b, h, bulk, low, high): the centred draws of each block of a half chain, as bytes of doubles; those of the tails with their mean apart."""

    def run(table: pa.Table) -> pa.Table:
        t = table.column("t").to_numpy() % block
        out = {}
        for kind in SIZED:
            x, mean = np.zeros(len(t)), table.column(f"m_{kind}")[0].as_py()
            x[t] = table.column(kind).to_numpy()
            out[kind] = [(x - mean).tobytes()] if kind == "bulk" else [np.float64(mean).tobytes() + x.astype(np.uint8).tobytes()]
        site = pa.array(table.column("s").slice(0, 1).to_pylist(), pa.struct([f.with_nullable(True) for f in table.schema.field("s").type]))
        return pa.table({"s": site, **{k: table.column(k).slice(0, 1) for k in ("c", "half", "b", "h")}, **{k: pa.array(v, pa.binary()) for k, v in out.items()}})

    named = rows.withColumn("b", F.expr(f"t div {block}"))
    of = {k: rows.schema[k].dataType.simpleString() for k in ("s", "c", "half", "h")}
    return checkpoint(named.groupBy("s", "c", "half", "b").applyInArrow(run, f"s {of['s']}, c {of['c']}, half {of['half']}, b long, h {of['h']}, bulk binary, low binary, high binary"))


def _products(blocks: DataFrame, first: int, last: int, block: int) -> DataFrame:
    """Rows (s, kind, lag, v): sums of products of centred draws, for lags of ``first`` to ``last`` blocks (the latter not included)."""
    # Where a block stands in the work of distance d: 0 the earlier one, 1 and 2 those d and d + 1 blocks later.
    at = [F.struct((F.col("b") - back).alias("b"), F.lit(role).alias("role")) for role, back in ((0, F.lit(0)), (1, F.col("d")), (2, F.col("d") + 1))]
    spread = blocks.withColumn("d", F.explode(F.sequence(F.lit(first), F.lit(last - 1)))).withColumn("r", F.explode(F.array(*at)))
    dealt = spread.filter(f"r.b >= 0 AND (r.b + d) * {block} < h").select("s", "c", "half", "d", "r.b", "r.role", "h", *SIZED)
    struct = blocks.schema["s"].dataType.simpleString()
    size = 1 << (3 * block - 1).bit_length()

    def draws(kind: str, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed) if kind == "bulk" else np.frombuffer(packed, np.uint8, offset=8) - np.frombuffer(packed, count=1)

    def run(batches):
        s_type, site, d, lags, sums, work, ends = None, None, None, 0, None, None, None

        def meet():
            for i in range(len(SIZED)):
                sums[i] += np.fft.irfft(np.conj(np.fft.rfft(ends[0][i], size)) * np.fft.rfft(ends[1][i], size), size)[:lags]

        def told():
            for i, kind in enumerate(SIZED):
                yield pa.RecordBatch.from_arrays([pa.array([site] * lags, s_type), pa.array([kind] * lags), pa.array(np.arange(lags, dtype=np.int64) + d * block), pa.array(sums[i])], ["s", "kind", "lag", "v"])

        for batch in batches:
            s_type = pa.struct([f.with_nullable(True) for f in batch.schema.field("s").type])
            for row in range(batch.num_rows):
                r = {n: batch.column(i)[row].as_py() for i, n in enumerate(batch.schema.names)}
                own = repr((r["s"], r["d"])), repr((r["c"], r["half"], r["b"]))  # text, so that NaN equals itself
                if own != work:
                    if work is not None:
                        meet()
                    if work is None or work[0] != own[0]:
                        if work is not None:
                            yield from told()
                        site, d, lags = r["s"], r["d"], min(block, r["h"] - r["d"] * block)
                        sums = np.zeros((len(SIZED), lags))
                    work, ends = own, np.zeros((2, len(SIZED), 2 * block))
                for i, kind in enumerate(SIZED):
                    x, start = draws(kind, r[kind]), block * (r["role"] == 2)
                    ends[min(r["role"], 1)][i][start : start + len(x)] = x
        if work is not None:
            meet()
            yield from told()

    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(parts, "s", "c", "half", "d", "b").sortWithinPartitions("s", "d", "c", "half", "b", "role")
    found = sorted_.mapInArrow(run, f"s {struct}, kind string, lag long, v double")
    return checkpoint(found.groupBy("s", "kind", "lag").agg(F.sum("v").alias("v")))


def _sizes(products: DataFrame, spread: DataFrame) -> DataFrame:
    """Rows (s, kind, ended, ess) from products up to some lag: ``ended`` if a pair of lags is negative or no lag is left."""
    told = products.join(spread, ["s", "kind"])
    a, n, k = F.col("v") / (F.col("h") * F.col("k")), F.col("h"), F.col("k")
    within = F.col("first") / (n * k) * n / (n - 1)
    plus = within * (n - 1) / n + F.coalesce("between", F.lit(0.0))
    rho = F.when(F.col("lag") == 0, 1.0).when(plus > 0, 1 - (within - a) / plus).otherwise(F.lit(float("nan")))
    lag0 = products.filter("lag = 0").select("s", "kind", F.col("v").alias("first"))
    rows = told.join(lag0, ["s", "kind"]).withColumn("rho", rho).withColumn("none", ~(plus > 0)).filter("lag < h - h % 2")
    pairs = rows.groupBy("s", "kind", F.expr("lag div 2").alias("pair")).agg(F.sum("rho").alias("p"), F.max("h").alias("h"), F.max("k").alias("k"), F.max("none").alias("none"))
    w = Window.partitionBy("s", "kind").orderBy("pair").rowsBetween(Window.unboundedPreceding, 0)
    cut = pairs.withColumns({"gone": F.max(F.col("p") < 0).over(w), "least": F.min("p").over(w)})
    sums = cut.groupBy("s", "kind").agg(F.sum(F.when(~F.col("gone"), F.col("least"))).alias("sum"), F.max("gone").alias("gone"), F.max("pair").alias("pair"), F.max("h").alias("h"), F.max("k").alias("k"), F.max("none").alias("none"))
    total = F.col("h") * F.col("k")
    tau = F.greatest(-1 + 2 * F.coalesce("sum", F.lit(0.0)), 1 / F.log10(total))
    ended = F.col("gone") | F.col("none") | ((F.col("pair") + 1) * 2 >= F.col("h") - F.col("h") % 2)
    return sums.select("s", "kind", ended.alias("ended"), F.when(F.col("none"), F.lit(float("nan"))).otherwise(total / tau).alias("ess"))


def mcmc_summary(draws: DataFrame, site: list[str], chain: str, draw: str, value: str, block: int = BLOCK) -> DataFrame:
    """Rows (site, r_hat, ess_bulk, ess_tail), the largest R-hat first: rank-normalised split R-hat (the larger of that of the draws and that of their folded values), and effective
    sizes of the normal scores and of the less well sampled tail.

    Draws that some chain of the site lacks (or has as null or NaN) are left out; a site with fewer than four draws left has NaN; an empty table gives an empty one.
    """
    kept, sites = _split_draws(draws, site, chain, draw, value)
    values = _values(kept, sites).select(F.struct("s", "x").alias("at"), *SPREAD)
    halves = kept.filter("half IS NOT NULL").withColumn("at", F.struct("s", "x"))
    wide = checkpoint(halves.join(values, "at").select("s", "c", "half", "t", "h", *SPREAD))
    per = checkpoint(wide.groupBy("s", "c", "half").agg(F.max("h").alias("h"), *[f(k).alias(f"{n}_{k}") for k in SPREAD for n, f in (("m", F.avg), ("v", F.var_samp))]))
    h = F.max("h")
    ratio = lambda k: F.sqrt(((h - 1) / h * F.avg(f"v_{k}") + F.var_samp(f"m_{k}")) / F.nullif(F.avg(f"v_{k}"), F.lit(0.0)))
    r = per.groupBy("s").agg(*[F.coalesce(ratio(k), F.lit(float("nan"))).alias(k) for k in ("bulk", "fold")])
    r = r.select("s", F.when(F.isnan("bulk") | F.isnan("fold"), F.col("bulk")).otherwise(F.greatest("bulk", "fold")).alias("r_hat"))
    spread = per.groupBy("s").agg(h.alias("h"), F.count(F.lit(1)).alias("k"), F.array(*[F.struct(F.lit(k).alias("kind"), F.var_samp(f"m_{k}").alias("between")) for k in SIZED]).alias("e"))
    spread = checkpoint(spread.select("s", "h", "k", F.explode("e").alias("e")).select("s", "h", "k", "e.kind", "e.between"))
    centred = wide.drop("fold").join(per.select("s", "c", "half", *[f"m_{k}" for k in SIZED]), ["s", "c", "half"])
    packed = _packed(centred, block)
    rows, products, found, first, last = packed, None, None, 0, 1
    while not rows.isEmpty():
        now = _products(rows, first, last, block)
        products = now if products is None else checkpoint(products.join(left, "s", "left_semi").unionByName(now))
        sized = checkpoint(_sizes(products, spread))
        left = checkpoint(sized.filter("NOT ended").select("s").distinct())
        done = sized.join(left, "s", "left_anti")
        found = done if found is None else found.unionByName(done)
        if left.isEmpty():
            break
        rows, first, last = packed.join(left, "s", "left_semi"), last, 2 * last
    names = [F.col("s")[c].alias(c) for c in site]
    none = F.lit(float("nan"))
    if found is None:
        return sites.select(*names, none.alias("r_hat"), none.alias("ess_bulk"), none.alias("ess_tail")).orderBy(*site)
    of = {k: F.max(F.when(F.col("kind") == k, F.col("ess"))) for k in SIZED}
    ess = found.groupBy("s").agg(of["bulk"].alias("ess_bulk"), F.when(F.isnan(of["low"]) | F.isnan(of["high"]), none).otherwise(F.least(of["low"], of["high"])).alias("ess_tail"))
    out = sites.join(r, "s", "left").join(ess, "s", "left").select(*names, *[F.coalesce(c, none).alias(c) for c in ("r_hat", "ess_bulk", "ess_tail")])
    return out.orderBy(F.isnan("r_hat"), F.desc("r_hat"), *site)
