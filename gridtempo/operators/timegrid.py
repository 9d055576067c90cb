"""Readings on strict time grids. Every operator takes the key columns of a series, so that many series run in parallel.

Timestamps are without zone (TIMESTAMP_NTZ) and read as UTC unless an operator converts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HALF_HOUR = 1800


def floor_to(ts: Column, seconds: int) -> Column:
    """The start of the period of ``seconds`` that holds a timestamp."""
    return F.timestamp_seconds(F.floor(F.unix_micros(ts.cast("timestamp")) / (seconds * 1_000_000)) * seconds).cast("timestamp_ntz")


def period_end_resample(readings: DataFrame, keys: list[str], ts: str, value: str, seconds: int = HALF_HOUR, out: str = "demand_mw") -> DataFrame:
    """Means over periods closed on the right, (end - seconds, end], for whole-second stamps; ``ts`` becomes the period's start."""
    start = floor_to(F.col(ts) - F.expr("INTERVAL 1 SECOND"), seconds)
    return readings.groupBy(*keys, start.alias("ts")).agg(F.avg(value).alias(out))


def latest_revision(records: DataFrame, keys: list[str], changed: str, tie: str) -> DataFrame:
    """The last changed record for each key; equal times are settled by the largest ``tie``. Combined before the shuffle."""
    rest = [c for c in records.columns if c not in keys]
    best = records.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(changed, tie)).alias("r"))
    return best.select(*keys, "r.*")


def to_zone(ts: Column, source: str, target: str) -> Column:
    return F.convert_timezone(F.lit(source), F.lit(target), ts)


def grid(series: DataFrame, keys: list[str], ts: str = "ts", seconds: int = HALF_HOUR) -> DataFrame:
    """All period starts from the first to the last of each series, both included."""
    ends = series.groupBy(*keys).agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    return ends.select(*keys, F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {seconds} SECOND"))).alias(ts))


def align(series: DataFrame, keys: list[str], ts: str = "ts", seconds: int = HALF_HOUR) -> DataFrame:
    """The series on its strict grid; periods without a reading are null."""
    return grid(series, keys, ts, seconds).join(series, [*keys, ts], "left")


def index_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many rows the union, the intersection and the difference of two indexes have, in one pass over both."""
    sides = a.withColumn("__a", F.lit(1)).withColumn("__b", F.lit(0)).unionByName(b.withColumn("__a", F.lit(0)).withColumn("__b", F.lit(1)))
    rows = sides.groupBy(*a.columns).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"))
    n = rows.agg(F.count("*").alias("union"), F.count_if(F.col("__a") + F.col("__b") == 2).alias("intersect"), F.count_if(F.col("__a") > F.col("__b")).alias("except"))
    return n.select(F.explode(F.array(*[F.struct(F.lit(k).alias("op"), F.col(k).alias("n")) for k in ("union", "intersect", "except")])).alias("s")).select("s.*")


def grid_audit(series: DataFrame, keys: list[str], ts: str = "ts", seconds: int = HALF_HOUR) -> DataFrame:
    per = series.groupBy(*keys).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("present"), F.countDistinct(ts).alias("distinct_stamps"))
    span = (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 1_000_000
    expected = (F.floor(span / seconds) + 1).cast("long")
    return per.select(*keys, "first", "last", "present", expected.alias("expected"), (expected - F.col("distinct_stamps")).alias("missing"), (F.col("present") - F.col("distinct_stamps")).alias("duplicates"))


def missing_periods(series: DataFrame, keys: list[str], ts: str = "ts", seconds: int = HALF_HOUR) -> DataFrame:
    """Grid points without a reading."""
    return grid(series, keys, ts, seconds).join(series.select(*keys, ts), [*keys, ts], "left_anti")


def daily_resample(series: DataFrame, keys: list[str], value: str, ts: str = "ts") -> DataFrame:
    """Means by UTC day on a grid of days: an empty day is null."""
    daily = series.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.avg(value).alias("mean"))
    ends = daily.groupBy(*keys).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = ends.select(*keys, F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(daily, [*keys, "day"], "left")


def between_days(series: DataFrame, first: str, last: str, ts: str = "ts") -> DataFrame:
    return series.filter(F.to_date(ts).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def clock_profile(series: DataFrame, keys: list[str], value: str, zone: str, ts: str = "ts") -> DataFrame:
    """Median, first and last decile by local half hour."""
    local = to_zone(F.col(ts), "UTC", zone)
    hour = F.hour(local) + F.minute(local) / 60
    return series.groupBy(*keys, hour.alias("hour")).agg(F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.1).alias("q10"), F.percentile(value, 0.9).alias("q90"))


def order(keys: list[str], ts: str = "ts") -> Window:
    return Window.partitionBy(*keys).orderBy(ts)
