"""Gates: one aggregate job for a whole frame, whose violations are collected (a row for each rule) and raised together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cleanse import bounds_for
from .timegrid import order


class GateError(ValueError):
    """A frame that breaks a gate's rules."""


def input_issues(frame: DataFrame, keys: list[str], columns: list[str], ts: str = "ts", seconds: int = 1800) -> DataFrame:
    """Rows (keys, column, nulls, out_of_bounds, stuck, off_grid) for each column."""
    step = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(order(keys, ts)).cast("timestamp"))
    rows = frame.withColumn("__step", step)
    aggregates = [F.count_if(F.col("__step") != seconds * 1_000_000).alias("off_grid")]
    for c in columns:
        x = F.col(c).cast("double")
        low, high = bounds_for(c) or (float("-inf"), float("inf"))
        aggregates.append(F.struct(F.count_if(x.isNull() | F.isnan(x)).alias("nulls"), F.count_if((x < low) | (x > high)).alias("out_of_bounds"), F.coalesce(F.stddev_pop(x) == 0, F.lit(False)).alias("stuck")).alias(c))
    wide = rows.groupBy(*keys).agg(*aggregates)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])).alias("e")
    return wide.select(*keys, "off_grid", each).select(*keys, "e.column", "e.s.nulls", "e.s.out_of_bounds", "e.s.stuck", "off_grid")


def check_inputs(frame: DataFrame, keys: list[str], columns: list[str], **how) -> None:
    bad = input_issues(frame, keys, columns, **how).filter("nulls > 0 OR out_of_bounds > 0 OR stuck OR off_grid > 0").limit(50).collect()
    if bad:
        raise GateError("; ".join(str(r.asDict()) for r in bad))


def check_schema(frame: DataFrame, schema: T.StructType, keys: list[str], ts: str = "ts", positive: str | None = None) -> None:
    """Columns and types first, then order, nulls and sign; the first broken rule is raised."""
    have = {f.name: f.dataType for f in frame.schema}
    for f in schema:
        if f.name not in have:
            raise GateError(f"column {f.name} is missing")
        if have[f.name] != f.dataType:
            raise GateError(f"column {f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    again = frame.groupBy(*keys, ts).count().filter("count > 1").limit(1)
    if not again.isEmpty():
        raise GateError("timestamps repeat")
    nulls = frame.agg(*[F.count_if(F.col(f.name).isNull()).alias(f.name) for f in schema]).first().asDict()
    for name, n in nulls.items():
        if n:
            raise GateError(f"column {name} has {n} nulls")
    if positive and not frame.filter(F.col(positive) <= 0).limit(1).isEmpty():
        raise GateError(f"column {positive} is not positive")


def sample_issues(draws: DataFrame, by: list[str], value: str, low: float, high: float, most_outside: float = 0.01) -> DataFrame:
    """Rows (by, median, outside, ok): the median lies within bounds and at most so much of the mass outside."""
    x = F.col(value)
    rows = draws.groupBy(*by).agg(F.percentile(value, 0.5).alias("median"), F.avg(((x < low) | (x > high)).cast("double")).alias("outside"))
    return rows.withColumn("ok", F.col("median").between(low, high) & (F.col("outside") <= most_outside))


def quantile_issues(quantiles: DataFrame, by: list[str], level: str, value: str, low: float, high: float) -> DataFrame:
    """Rows (by, crossings, outside, ok)."""
    step = F.col(value) - F.lag(value).over(order(by, level))
    rows = quantiles.withColumn("__step", step).groupBy(*by).agg(F.count_if(F.col("__step") < -1e-6).alias("crossings"), F.count_if(~F.col(value).between(low, high)).alias("outside"))
    return rows.withColumn("ok", (F.col("crossings") == 0) & (F.col("outside") == 0))


def check_forecast(issues: DataFrame) -> None:
    bad = issues.filter(~F.col("ok")).limit(50).collect()
    if bad:
        raise GateError("; ".join(str(r.asDict()) for r in bad))
