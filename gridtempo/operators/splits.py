"""Rolling origins, horizons and the season-blocked split."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def day_starts(grid: DataFrame, ts: str = "ts") -> DataFrame:
    return grid.filter((F.hour(ts) == 0) & (F.minute(ts) == 0))


def rolling_origins(grid: DataFrame, keys: list[str], hours: tuple[int, ...], scored: Column, horizon: int = 48, lag: int = 336, seconds: int = 1800, ts: str = "ts") -> DataFrame:
    """Clock times at which a forecast may be issued: the last step is to be scored, and the longest lag lies in the history (ends only)."""
    w = Window.partitionBy(*keys)
    rows = grid.withColumns({"__scored": scored, "__first": F.min(ts).over(w)})
    last = rows.filter("__scored").select(*keys, (F.col(ts) - F.make_dt_interval(secs=F.lit((horizon - 1) * seconds))).cast("timestamp_ntz").alias(ts)).distinct()
    right = F.hour(ts).isin(*hours) & (F.minute(ts) == 0) & ((F.col(ts) - F.make_dt_interval(secs=F.lit(lag * seconds))) >= F.col("__first"))
    return rows.filter(right).join(last, [*keys, ts], "left_semi").select(*keys, F.col(ts).alias("origin"))


def horizon(origins: DataFrame, keys: list[str], steps: int = 48, seconds: int = 1800) -> DataFrame:
    rows = origins.select(*keys, "origin", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    return rows.withColumn("ts", (F.col("origin") + F.make_dt_interval(secs=F.col("step") * seconds)).cast("timestamp_ntz"))


def balanced_permutation(n: int, seed: int) -> list[bool]:
    """For each of n months whether validation has the early window: half of them, rounded down, by a seeded permutation.

    Fixed values: the generator, its seed and the order of its calls decide the published splits.
    """
    early = np.zeros(n, dtype=bool)
    early[: n // 2] = True
    return np.random.default_rng(seed).permutation(early).tolist()


def season_split(days: DataFrame, eval_start: str, early: tuple[int, int], late: tuple[int, int], seed: int, day: str = "day") -> DataFrame:
    """Adds split: train before ``eval_start``; after it validation and test alternate between an early and a late window of each month.

    Months count if they have both the first early and the last late day. The month list goes to the driver: some twelve rows a year.
    """
    after = days.filter(F.col(day) >= F.lit(eval_start).cast("date"))
    month = F.trunc(day, "month").alias("month")
    whole = after.groupBy(month).agg(F.count_if(F.dayofmonth(day) == early[0]).alias("a"), F.count_if(F.dayofmonth(day) == late[1]).alias("b")).filter("a > 0 AND b > 0")
    months = [r[0] for r in whole.select("month").distinct().orderBy("month").collect()]
    flags = balanced_permutation(len(months), seed)
    table = days.sparkSession.createDataFrame(list(zip(months, flags, strict=True)), "month date, validation_early boolean")
    rows = days.withColumn("month", F.trunc(day, "month")).join(F.broadcast(table), "month", "left")
    in_early, in_late = F.dayofmonth(day).between(*early), F.dayofmonth(day).between(*late)
    flag = F.col("validation_early")
    label = (
        F.when(F.col(day) < F.lit(eval_start).cast("date"), "train")
        .when((in_early & flag) | (in_late & ~flag), "validation")
        .when((in_early & ~flag) | (in_late & flag), "test")
        .otherwise("none")
    )
    return rows.withColumn("split", F.coalesce(label, F.lit("none"))).drop("month", "validation_early")


def split_summary(labelled: DataFrame, ts: str, per_day: int) -> DataFrame:
    return labelled.groupBy("split").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"), F.round(F.count("*") / per_day, 1).alias("days"))


def check_order(labelled: DataFrame, ts: str) -> None:
    """All training rows come before all others that are scored."""
    r = labelled.agg(F.max(F.when(F.col("split") == "train", F.col(ts))).alias("a"), F.min(F.when(F.col("split").isin("validation", "test"), F.col(ts))).alias("b")).first()
    if r["a"] is not None and r["b"] is not None and r["a"] >= r["b"]:
        raise ValueError(f"training reaches {r['a']}, scoring begins {r['b']}")


