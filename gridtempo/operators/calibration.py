"""Calibration: probability integral transforms, their histograms and distances from uniform, reliability and mixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import mathx


def pit_gaussian(y: str, mean: str, sd: str) -> str:
    return mathx.cdf(f"((({y}) - ({mean})) / ({sd}))")


def pit_samples(draws: DataFrame, by: list[str], value: str, y: str) -> DataFrame:
    """Randomised between ties by a hash of the group, so that reruns agree."""
    u = F.pmod(F.xxhash64(*by), F.lit(1 << 40)) / float(1 << 40)
    x, target = F.col(value), F.col(y)
    rows = draws.groupBy(*by).agg(F.avg((x < target).cast("double")).alias("below"), F.avg((x == target).cast("double")).alias("equal"), F.count("*").alias("s"))
    return rows.select(*by, (F.col("below") + u * (F.col("equal") + 1 / F.col("s"))).alias("pit"))


def rb_pit(moments: DataFrame, by: list[str], y: str, mean: str, sd: str) -> DataFrame:
    return moments.groupBy(*by).agg(F.avg(mathx.col(pit_gaussian(y, mean, sd))).alias("pit"))


def histogram(rows: DataFrame, by: list[str], value: str, bins: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Counts and densities of bins 1 to ``bins``; values are clipped, and the right edge is in the last bin. Empty bins are rows too."""
    x = F.least(F.greatest(F.col(value), F.lit(low)), F.lit(high))
    at = F.least(F.width_bucket(x, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).cast("int")
    counts = rows.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))
    every = rows.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins)))) if by else rows.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    full = every.join(counts, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))) * bins / (high - low))


def ecdf_difference(rows: DataFrame, by: list[str], pit: str) -> DataFrame:
    """The empirical distribution less the uniform one, at each value."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return rows.select(*by, F.col(pit).alias("x"), (F.row_number().over(w.orderBy(pit)) / F.count("*").over(w) - F.col(pit)).alias("difference"))


def ks_by(rows: DataFrame, by: list[str], pit: str) -> DataFrame:
    return ecdf_difference(rows, by, pit).groupBy(*by).agg(F.max(F.abs("difference")).alias("ks"), F.count("*").alias("n"))


def ks_band(n: int, alpha: float = 0.05) -> float:
    return mathx.kolmogorov_ppf(1 - alpha, n)


def reliability(quantiles: DataFrame, by: list[str], level: str, value: str, y: str) -> DataFrame:
    return quantiles.groupBy(*by, level).agg(F.avg((F.col(y) <= F.col(value)).cast("double")).alias("observed"))


def coverage_curve(rows: DataFrame, by: list[str], pit: str) -> DataFrame:
    levels = F.array(*[F.lit(k / 20) for k in range(1, 20)])
    each = rows.withColumn("nominal", F.explode(levels))
    return each.groupBy(*by, "nominal").agg(F.avg((F.abs(F.col(pit) - 0.5) <= F.col("nominal") / 2).cast("double")).alias("observed"))


def closeness(observed: Column, nominal: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(observed - nominal) / 0.15)


def mixture(moments: DataFrame, by: list[str], mean: str, sd: str, points: int = 512, pad: float = 5.0) -> DataFrame:
    """Density and distribution of the draws' mixture on an even grid of each group, from min(mean - pad sd) to max(mean + pad sd)."""
    ends = moments.groupBy(*by).agg(F.min(F.col(mean) - pad * F.col(sd)).alias("lo"), F.max(F.col(mean) + pad * F.col(sd)).alias("hi"))
    rows = moments.join(ends, by).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    rows = rows.withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (points - 1))
    z = f"((x - ({mean})) / ({sd}))"
    return rows.groupBy(*by, "k").agg(F.max("x").alias("x"), F.avg(mathx.col(f"{mathx.pdf(z)} / ({sd})")).alias("pdf"), F.avg(mathx.col(mathx.cdf(z))).alias("cdf"))


def quantile_band(moments: DataFrame, by: list[str], mean: str, sd: str, probabilities: list[float], points: int = 512) -> DataFrame:
    """Quantiles of the mixture by inverting its distribution on the grid."""
    curve = mixture(moments, by, mean, sd, points).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", "cdf", "x"))).alias("c"))
    rows = curve.withColumn("p", F.explode(F.array(*[F.lit(p) for p in probabilities])))
    xs, ys = F.transform("c", lambda c: c["cdf"]), F.transform("c", lambda c: c["x"])
    return rows.select(*by, "p", mathx.interpolated(F.col("p"), xs, ys).alias("quantile"))


def pit_from_quantiles(quantiles: DataFrame, by: list[str], level: str, value: str, y: str) -> DataFrame:
    """The level at the outcome by interpolation; 0 and 1 outside the known quantiles."""
    rows = quantiles.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), F.col(level).alias("l")))).alias("q"), F.max(y).alias("y"))
    xs, ys = F.transform("q", lambda q: q["v"]), F.transform("q", lambda q: q["l"])
    inside = mathx.interpolated(F.col("y"), xs, ys)
    return rows.select(*by, F.when(F.col("y") < F.get(xs, F.lit(0)), 0.0).when(F.col("y") > F.get(xs, F.size(xs) - 1), 1.0).otherwise(inside).alias("pit"))


def stratified(rows: DataFrame, stratum: str, pit: str) -> DataFrame:
    """Each stratum's own distances from uniform, strata in order of first appearance left to the caller."""
    return ks_by(rows, [stratum], pit)
