"""Reports over scores and series: scalers, bands, bias, screening, ablations, master tables, day selection, densities, set operations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scalers(rows: DataFrame, keys: list[str], columns: list[str], population: bool = False) -> DataFrame:
    """Rows (keys, column, loc, scale); a column without spread has scale 1."""
    spread = F.stddev_pop if population else F.stddev_samp
    wide = rows.groupBy(*keys).agg(*[F.struct(F.avg(c).alias("loc"), spread(c).alias("scale")).alias(c) for c in columns])
    each = wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c)["loc"].alias("loc"), F.col(c)["scale"].alias("scale")) for c in columns])).alias("s"))
    return each.select(*keys, "s.column", "s.loc", F.when(F.coalesce(F.col("s.scale"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("s.scale")).alias("scale"))


def standardised(rows: DataFrame, keys: list[str], column: str, population: bool = False) -> DataFrame:
    """The column less its series' mean, over its spread."""
    w = Window.partitionBy(*keys)
    spread = (F.stddev_pop if population else F.stddev_samp)(column).over(w)
    return rows.withColumn(f"{column}_z", (F.col(column) - F.avg(column).over(w)) / F.when(F.coalesce(spread, F.lit(0.0)) == 0, 1.0).otherwise(spread))


def restored(z: Column, loc: Column, scale: Column) -> Column:
    """A standardised value on its own scale again."""
    return z * scale + loc


def to_float32(frame: DataFrame) -> DataFrame:
    """All doubles, also in arrays, in single precision."""
    single = {"double": "float", "array<double>": "array<float>"}
    return frame.select(*[F.col(f"`{f.name}`").cast(single.get(f.dataType.simpleString(), f.dataType)).alias(f.name) for f in frame.schema])


def described(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, spread, least, quartiles and greatest, exactly."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("lo"), q.alias("q"), F.max(value).alias("hi"))
    return out.select(*by, "n", "mean", "sd", "lo", *[F.get("q", F.lit(k)).alias(f"q{k + 1}") for k in range(3)], "hi")


def pivot_moments(rows: DataFrame, by: list[str], column: str, values: list[str], value: str) -> DataFrame:
    """Mean and spread of a value, a column pair for each of the named values of another."""
    return rows.groupBy(*by).pivot(column, values).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def pivot_single(rows: DataFrame, by: list[Column], column: str, values: list[str], value: str) -> DataFrame:
    """The value of each cell, which is to have one; of several, the last in order."""
    return rows.groupBy(*by).pivot(column, values).agg(F.max(value))


def top_days(rows: DataFrame, ts: str, value: str, hours: tuple[int, int], n: int) -> DataFrame:
    """The n days of the highest mean within the hours, both included; ties go to the earlier day."""
    daily = rows.filter(F.hour(ts).between(*hours)).groupBy(F.to_date(ts).alias("day")).agg(F.avg(value).alias("mean"))
    return daily.orderBy(F.desc("mean"), "day").limit(n)


def mean_and_median(draws: DataFrame, by: list[str], step: str, x: str, y: str) -> DataFrame:
    """Errors of the draws' mean and of their median as point forecasts, and the gap between both."""
    rows = draws.groupBy(*by, step).agg(F.avg(x).alias("mean"), F.percentile(x, 0.5).alias("median"), F.max(y).alias("__y"))
    errors = {n: F.col(n) - F.col("__y") for n in ("mean", "median")}
    return rows.groupBy(*by).agg(*[F.avg(F.abs(e)).alias(f"{n}_mae") for n, e in errors.items()], *[F.sqrt(F.avg(e * e)).alias(f"{n}_rmse") for n, e in errors.items()], F.avg(F.abs(F.col("mean") - F.col("median"))).alias("gap"))


def covariance_ellipse(rows: DataFrame, by: list[str], x: str, y: str, spreads: float = 2.0) -> DataFrame:
    """Centre, axes (full lengths) and angle of the first axis in degrees (above -90, at most 90) of the ellipse of so many standard deviations."""
    m = rows.groupBy(*by).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.var_samp(x).alias("__a"), F.var_samp(y).alias("__c"), F.covar_samp(x, y).alias("__b"))
    a, b, c = F.col("__a"), F.col("__b"), F.col("__c")
    half = F.sqrt((a - c) * (a - c) / 4 + b * b)
    axes = {"width": (a + c) / 2 + half, "height": F.greatest((a + c) / 2 - half, F.lit(0.0))}
    return m.select(*by, "x", "y", *[(2 * spreads * F.sqrt(v)).alias(n) for n, v in axes.items()], F.degrees(F.atan2(2 * b, a - c) / 2).alias("angle"))


def cut(x: Column, edges: list[float], labels: list[str], right: bool = True) -> Column:
    """Bins closed on the right (or left); null outside."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels, strict=False))):
        inside = (x > low) & (x <= high) if right else (x >= low) & (x < high)
        out = F.when(inside, label).otherwise(out)
    return out


def bias_and_spread(rows: DataFrame, by: list[str], actual: str, forecast: str) -> DataFrame:
    e = F.col(forecast) - F.col(actual)
    return rows.groupBy(*by).agg(F.avg(e).alias("bias"), F.stddev_samp(e).alias("spread"), F.avg(F.abs(e)).alias("mae"))


def screening(rows: DataFrame, keys: list[str], target: str, variables: list[str]) -> DataFrame:
    """Absolute correlation of each variable with the target, strongest first within a series."""
    wide = rows.groupBy(*keys).agg(*[F.abs(F.corr(v, target)).alias(v) for v in variables])
    each = wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).alias("r")) for v in variables])).alias("e")).select(*keys, "e.variable", "e.r")
    return each.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("r"), "variable")))


def ols(rows: DataFrame, y: str, features: list[str], train: Column) -> DataFrame:
    """Errors on the rows not trained on, of a least-squares fit by MLlib's normal equations: one row (n, mae, rmse)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    clean = rows.withColumn("__train", train).dropna(subset=[y, *features])
    vectors = VectorAssembler(inputCols=features, outputCol="__x").transform(clean)
    model = LinearRegression(featuresCol="__x", labelCol=y, solver="normal", regParam=0.0).fit(vectors.filter("__train"))
    e = F.col("prediction") - F.col(y)
    return model.transform(vectors.filter("NOT __train")).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def master_table(scores: DataFrame, model: str, metrics: list[str]) -> DataFrame:
    """A row for each model from long rows (model, metric, value): means, and each metric's rank among models."""
    wide = scores.groupBy(model).pivot("metric", metrics).agg(F.avg("value"))
    return wide.withColumns({f"{m}_rank": F.rank().over(Window.partitionBy(F.lit(0)).orderBy(m)) for m in metrics})


def crossover(curves: DataFrame, step: str, a: str, b: str) -> DataFrame:
    """The first step from which model b scores below model a."""
    return curves.agg(F.min(F.when(F.col(b) < F.col(a), F.col(step))).alias("crossover"))


def picked_days(scores: DataFrame, by: list[str], day: str, score: str) -> DataFrame:
    """The best, typical (median rank) and worst day of each group; ties go to the earlier day."""
    w = Window.partitionBy(*by)
    rows = scores.withColumns({"r": F.row_number().over(w.orderBy(score, day)), "n": F.count("*").over(w)})
    kind = F.when(F.col("r") == 1, "best").when(F.col("r") == F.floor((F.col("n") + 1) / 2), "typical").when(F.col("r") == F.col("n"), "worst")
    return rows.withColumn("kind", kind).filter("kind IS NOT NULL").select(*by, "kind", day, score)


def histogram_2d(rows: DataFrame, x: str, y: str, x_step: float, y_step: float) -> DataFrame:
    return rows.groupBy(F.floor(F.col(x) / x_step).cast("int").alias("xb"), F.floor(F.col(y) / y_step).cast("int").alias("yb")).agg(F.count("*").alias("n"))


def kernel_density(draws: DataFrame, by: list[str], value: str, points: int = 32) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth on an even grid of each group, normalised to its peak."""
    moments = draws.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), (F.stddev_samp(value) * F.pow(F.count("*").cast("double"), F.lit(-0.2))).alias("h"))
    rows = draws.join(moments, by).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("__at", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (points - 1))
    z = (F.col("__at") - F.col(value)) / F.nullif(F.col("h"), F.lit(0.0))
    field = rows.groupBy(*by, "k").agg(F.max("__at").alias("x"), F.avg(F.exp(-0.5 * z * z) / F.nullif(F.col("h"), F.lit(0.0)) / math.sqrt(2 * math.pi)).alias("density"))
    return field.withColumn("relative", F.col("density") / F.max("density").over(Window.partitionBy(*by)))


def thinned(rows: DataFrame, draw: str, every: int) -> DataFrame:
    return rows.filter(F.pmod(F.col(draw), F.lit(every)) == 0)


def groups_of(rows: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """Even groups in order, the larger ones first."""
    return rows.withColumn("group", F.ntile(n).over(Window.partitionBy(*by).orderBy(order)))


def history_max(rows: DataFrame, keys: list[str], value: str, before: Column) -> DataFrame:
    return rows.filter(before).groupBy(*keys).agg(F.max(value).alias("hist_max"))


def best_by(rows: DataFrame, by: list[str], choice: str, score: str) -> DataFrame:
    """The choice of the lowest score; ties go to the smallest choice."""
    return rows.groupBy(*by).agg(F.min_by(choice, F.struct(score, choice)).alias("best"), F.min(score).alias("score"))
