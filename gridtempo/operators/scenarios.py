"""Functionals of simulated paths: peaks, ramps, totals, stress, exceedance, alerts and the operations console."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def total(path: Column) -> Column:
    return F.aggregate(path, F.lit(0.0), lambda a, x: a + x.cast("double"))


def peak(path: Column, first: int = 1, length: int | None = None) -> Column:
    return F.array_max(F.slice(path, first, length) if length else path).cast("double")


def max_ramp(path: Column, absolute: bool = False) -> Column:
    n = F.size(path) - 1
    steps = F.zip_with(F.slice(path, F.lit(2), n), F.slice(path, F.lit(1), n), lambda b, a: b.cast("double") - a.cast("double"))
    return F.array_max(F.transform(steps, F.abs) if absolute else steps)


def stress_hours(path: Column, threshold: Column, hours_a_step: float = 0.5) -> Column:
    return F.size(F.filter(path, lambda x: x.cast("double") > threshold)) * hours_a_step


def alert(probability: Column) -> Column:
    return F.when(probability > 0.5, "red").when(probability > 0.15, "amber").otherwise("green")


def exceedance(paths: DataFrame, by: list[str], path: str, threshold: Column) -> DataFrame:
    rows = paths.withColumn("__p", peak(F.col(path)))
    return rows.groupBy(*by).agg(F.avg((F.col("__p") > threshold).cast("double")).alias("probability"))


def spikes(paths: DataFrame, by: list[str], path: str, thresholds: dict[str, float]) -> DataFrame:
    """The probability that the peak exceeds each of the named thresholds."""
    rows = paths.withColumn("__p", peak(F.col(path)))
    return rows.groupBy(*by).agg(*[F.avg((F.col("__p") > v).cast("double")).alias(n) for n, v in thresholds.items()])


def spread_of_total(paths: DataFrame, by: list[str], path: str) -> DataFrame:
    """The spread of day totals, and what it would be were the steps independent."""
    totals = paths.groupBy(*by).agg(F.stddev_pop(total(F.col(path))).alias("total_sd"))
    steps = paths.select(*by, F.posexplode(path).alias("step", "x")).groupBy(*by, "step").agg(F.var_pop(F.col("x").cast("double")).alias("v"))
    return totals.join(steps.groupBy(*by).agg(F.sqrt(F.sum("v")).alias("independent_sd")), by)


def marginal_quantiles(paths: DataFrame, by: list[str], path: str, probabilities: list[float]) -> DataFrame:
    rows = paths.select(*by, F.posexplode(path).alias("step", "x"))
    q = F.percentile(F.col("x").cast("double"), F.array(*[F.lit(p) for p in probabilities]))
    return rows.groupBy(*by, "step").agg(q.alias("q")).select(*by, "step", *[F.get("q", F.lit(k)).alias(f"p{round(100 * p)}") for k, p in enumerate(probabilities)])


def variance_split(moments: DataFrame, by: list[str], mean: str, variance: str) -> DataFrame:
    """Parameter uncertainty (variance over draws of the mean) and innovations (mean over draws of the variance)."""
    rows = moments.groupBy(*by).agg(F.var_pop(mean).alias("parameter"), F.avg(variance).alias("innovation"))
    return rows.withColumn("parameter_share", F.col("parameter") / (F.col("parameter") + F.col("innovation")))


def console(paths: DataFrame, by: list[str], path: str, threshold: Column) -> DataFrame:
    """One row for each origin: peak, its 90% interval, spike probability, stress, ramp, reserve and alert."""
    p = F.col(path)
    rows = paths.select(*by, peak(p).alias("peak"), max_ramp(p).alias("ramp"), stress_hours(p, threshold).alias("stress"), threshold.alias("threshold"))
    out = rows.groupBy(*by).agg(
        F.percentile("peak", 0.5).alias("peak_median"),
        F.percentile("peak", 0.05).alias("peak_p5"),
        F.percentile("peak", 0.95).alias("peak_p95"),
        F.avg((F.col("peak") > F.col("threshold")).cast("double")).alias("p_spike"),
        F.avg("stress").alias("stress_hours"),
        F.percentile("ramp", 0.9).alias("ramp_p90"),
        (F.percentile("peak", 0.99) - F.percentile("peak", 0.5)).alias("reserve_p99"),
    )
    return out.withColumn("alert", alert(F.col("p_spike")))


def shuffled_marginals(paths: DataFrame, by: list[str], draw: str, path: str) -> DataFrame:
    """The same marginals without dependence: at each step the draws are dealt anew, by hash order."""
    rows = paths.select(*by, draw, F.posexplode(path).alias("step", "x"))
    order = Window.partitionBy(*by, "step").orderBy(F.xxhash64(draw, F.col("step")), draw)
    dealt = rows.withColumn("new", F.row_number().over(order))
    return dealt.groupBy(*by, "new").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "x"))), lambda s: s["x"]).alias(path)).withColumnRenamed("new", draw)


def vintages(paths: DataFrame, by: list[str], lead: str, path: str) -> DataFrame:
    rows = paths.withColumn("__p", peak(F.col(path))).groupBy(*by, lead).agg(F.percentile("__p", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    return rows.select(*by, lead, *[F.get("q", F.lit(k)).alias(n) for k, n in enumerate(("p10", "p50", "p90"))])
