"""Proper scoring rules and point errors. Gaussian ones are SQL text (no shuffle); the rest aggregates over draws, levels or steps."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions import mathx
from ..lineage import checkpoint

#: Distances held at a time, and draws of a block.
PAIR_CELLS, DRAWS = 2_000_000, 2048
#: Squared distances below this part of the vectors' squared lengths are computed from differences.
CLOSE = 1e-4
#: Groups whose resamples a task adds up at a time.
HELD_GROUPS = 64


def crps_gaussian(y: str, mean: str, sd: str) -> str:
    z = f"((({y}) - ({mean})) / ({sd}))"
    return f"(({sd}) * ({z} * (2 * {mathx.cdf(z)} - 1) + 2 * {mathx.pdf(z)} - {mathx.number(1 / math.sqrt(math.pi))}))"


def log_score_gaussian(y: str, mean: str, sd: str) -> str:
    return f"(-{mathx.logpdf(y, mean, sd)})"


def crps_samples(draws: DataFrame, by: list[str], value: str, y: str) -> DataFrame:
    """The energy form with all S * S pairs in the denominator, by the identity over sorted draws: no pairs are formed."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(value))
    size = F.count("*").over(Window.partitionBy(*by))
    rows = draws.withColumns({"__r": rank, "__s": size})
    spread = F.sum((2 * F.col("__r") - F.col("__s") - 1) * F.col(value)) / (F.max("__s") * F.max("__s"))
    return rows.groupBy(*by).agg((F.avg(F.abs(F.col(value) - F.col(y))) - spread).alias("crps"))


def log_score_samples(draws: DataFrame, by: list[str], value: str, y: str) -> DataFrame:
    moments = draws.groupBy(*by).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.max(y).alias("y"))
    return moments.select(*by, mathx.col(log_score_gaussian("y", "m", "s")).alias("log_score"))


def energy_score(paths: DataFrame, by: list[str], path: str, y: str, block: int = DRAWS) -> DataFrame:
    """Whole paths (arrays): mean distance to the outcome less half the mean distance of all pairs.

    A group's draws are dealt by hash into blocks of about ``block``; each pair of blocks is a task's work of its own and sends one partial sum, so that no task holds a group.
    The work grows with the square of a group's draws, which is the definition's own, the rows sent with their number times that of blocks.
    """
    x = F.col(path).cast("array<double>")
    away = F.sqrt(F.aggregate(F.zip_with(x, F.col(y).cast("array<double>"), lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda t, v: t + v))
    rows = paths.select(*by, x.alias("__x"), away.alias("__away"))
    sizes = checkpoint(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.avg("__away").alias("__first")))
    blocks = F.ceil(F.col("__n") / F.lit(block))
    key = F.struct(*by)
    named = sizes.select(key.alias("__key"), blocks.alias("__blocks"))
    dealt = rows.select(key.alias("__key"), "__x").join(named, "__key").withColumn("__own", F.pmod(F.xxhash64("__x"), F.col("__blocks")))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1), lambda o: F.struct(F.least("__own", o).alias("i"), F.greatest("__own", o).alias("j")))
    tiles = dealt.select("__key", "__own", "__x", F.explode(pair).alias("__t")).select("__key", "__own", "__x", "__t.i", "__t.j")

    def run(table: pa.Table) -> pa.Table:
        lists = table.column("__x").combine_chunks()
        x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
        own, i, j = table.column("__own").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        total = distances(x, x) if i == j else 2 * distances(x[own == i], x[own == j])
        kind = pa.struct([f.with_nullable(True) for f in table.schema.field("__key").type])
        return pa.table([pa.array([table.column("__key")[0].as_py()], kind), pa.array([total])], names=["__key", "__total"])

    sums = tiles.groupBy("__key", "i", "j").applyInArrow(run, f"__key {dealt.schema['__key'].dataType.simpleString()}, __total double").groupBy("__key").agg(F.sum("__total").alias("__total"))
    score = F.col("__first") - F.col("__total") / (2 * F.col("__n") * F.col("__n"))
    return sizes.withColumn("__key", key).join(sums, "__key").select(*by, score.alias("energy_score"))


def distances(a: np.ndarray, b: np.ndarray) -> float:
    """The sum of the distances between all rows of ``a`` and of ``b``, in runs of bounded memory."""
    if not len(a) or not len(b):
        return 0.0
    at_once, centre = max(1, PAIR_CELLS // len(b)), b.mean(axis=0)
    a, b = a - centre, b - centre
    own, other = (a * a).sum(axis=1), (b * b).sum(axis=1)
    total = 0.0
    for k in range(0, len(a), at_once):
        part = a[k : k + at_once]
        scale = own[k : k + at_once, None] + other
        square = np.maximum(scale - 2 * part @ b.T, 0)
        # Where the product cancels, as for repeated draws, the differences themselves are taken.
        r, c = np.nonzero(square < CLOSE * scale)
        for m in range(0, len(r), max(1, PAIR_CELLS // a.shape[1])):
            near = slice(m, m + max(1, PAIR_CELLS // a.shape[1]))
            square[r[near], c[near]] = ((part[r[near]] - b[c[near]]) ** 2).sum(axis=1)
        total += float(np.sqrt(square).sum())
    return total


def pinball(y: Column, q: Column, level: Column) -> Column:
    d = y - q
    return F.when(d >= 0, level * d).otherwise((level - 1) * d)


def crps_from_quantiles(quantiles: DataFrame, by: list[str], level: str, value: str, y: str) -> DataFrame:
    """Twice the trapezoid of the pinball loss over the levels, closed with 0 at levels 0 and 1."""
    w = Window.partitionBy(*by).orderBy(level)
    rows = quantiles.withColumn("__p", pinball(F.col(y), F.col(value), F.col(level)))
    before, at = F.coalesce(F.lag("__p").over(w), F.lit(0.0)), F.coalesce(F.lag(level).over(w), F.lit(0.0))
    last = F.lead(level).over(w).isNull()
    area = (F.col("__p") + before) / 2 * (F.col(level) - at) + F.when(last, F.col("__p") / 2 * (1 - F.col(level))).otherwise(0.0)
    return rows.withColumn("__a", area).groupBy(*by).agg((2 * F.sum("__a")).alias("crps"))


def pinball_by_level(quantiles: DataFrame, by: list[str], level: str, value: str, y: str) -> DataFrame:
    return quantiles.groupBy(*by, level).agg(F.avg(pinball(F.col(y), F.col(value), F.col(level))).alias("pinball"))


def rb_log_score(moments: DataFrame, by: list[str], y: str, mean: str, sd: str) -> DataFrame:
    """Minus the log of the mean density over draws, by a two-pass log-sum-exp."""
    rows = moments.withColumn("__l", mathx.col(mathx.logpdf(y, mean, sd)))
    top = F.max("__l").over(Window.partitionBy(*by))
    rows = rows.withColumn("__m", top)
    return rows.groupBy(*by).agg((-(F.max("__m") + F.ln(F.sum(F.exp(F.col("__l") - F.col("__m")))) - F.ln(F.count("*")))).alias("log_score"))


def point_errors(rows: DataFrame, by: list[str], y: str, point: str, naive_error: str | None = None) -> DataFrame:
    e = F.col(y) - F.col(point)
    more = [(F.avg(F.abs(e)) / F.max(naive_error)).alias("mase")] if naive_error else []
    return rows.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), *more)


def coverage(rows: DataFrame, by: list[str], y: str, low: str, high: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(F.col(y).between(F.col(low), F.col(high)).cast("double")).alias("coverage"))


def paired_bootstrap(scores: DataFrame, by: list[str], order: str, a: str, b: str, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """Over origins: mean difference, its 95% interval and a two-sided p.

    Each origin enters each resample as often as a Poisson draw of mean one says, which a generator seeded by (group, origin, seed) gives, so that groups have draws of their own and
    reruns agree. A task adds up what it has of all resamples; one aggregate joins the tasks' sums, and no task holds a group. The counts' sum varies about the
    number of origins, which the means allow for; a resample without any origin, likely with very few of them alone, is left out. Rows without a difference take no part.
    """
    key = F.struct(*by)
    rows = scores.select(key.alias("__key"), F.xxhash64(key, F.col(order), F.lit(seed)).alias("__seed"), (F.col(a) - F.col(b)).cast("double").alias("__d")).filter(F.col("__d").isNotNull() & ~F.isnan("__d"))

    def run(batches):
        sums: dict = {}
        for batch in batches:
            for k, s, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                weight = np.random.Generator(np.random.Philox(key=s & (1 << 64) - 1)).poisson(1.0, resamples)
                held = sums.setdefault(tuple(k.values()), (k, np.zeros((2, resamples))))[1]
                held += (weight, weight * d)
            while len(sums) > HELD_GROUPS:
                yield partial(*sums.pop(next(iter(sums))))
        for k, held in sums.values():
            yield partial(k, held)

    def partial(k: dict, held: np.ndarray) -> pa.RecordBatch:
        at = np.arange(resamples, dtype=np.int32)
        return pa.RecordBatch.from_arrays([pa.array([k] * resamples, kind), pa.array(at), pa.array(held[0]), pa.array(held[1])], ["__key", "__r", "__w", "__s"])

    kind = pa.struct([f.with_nullable(True) for f in to_arrow_type(rows.schema["__key"].dataType)])
    spread = rows.mapInArrow(run, f"__key {rows.schema['__key'].dataType.simpleString()}, __r int, __w double, __s double")
    means = spread.groupBy("__key", "__r").agg((F.sum("__s") / F.nullif(F.sum("__w"), F.lit(0.0))).alias("__m")).filter("__m IS NOT NULL")
    share = lambda c: F.avg(c.cast("double"))
    m = F.col("__m")
    found = means.groupBy("__key").agg(F.percentile("__m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.least(F.lit(1.0), 2 * F.least(share(m > 0), share(m < 0))).alias("p_value"))
    whole = rows.groupBy("__key").agg(F.avg("__d").alias("difference"))
    return whole.join(found, "__key").select(*[F.col("__key")[c].alias(c) for c in by], "difference", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"), "p_value")
