"""Long series in buckets give the rows of whole ones."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridtempo.operators import buckets, cleanse, features, timegrid

START = dt.datetime(2024, 3, 1, 11, 30)
DAY = 86_400


def long_series(spark, seed, n=900, strict=True):
    """Runs of missing values longer than a bucket, one series of one row, one without readings."""
    rng = random.Random(seed)
    rows = [("a", START + i * dt.timedelta(minutes=30), None if 100 < i < 260 or i < 3 or i > n - 60 or rng.random() < 0.2 else rng.gauss(20, 5)) for i in range(n)]
    rows += [("a", START + 400 * dt.timedelta(minutes=30) + dt.timedelta(minutes=7), 3.0)] * (not strict)
    rows += [("b", START, 1.0)] + [("c", START + i * dt.timedelta(minutes=30), None) for i in range(150)] + [(None, START + i * dt.timedelta(minutes=30), float(i % 7)) for i in range(120)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")


def same(one, two):
    got, want = (sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str) for df in (one.select(two.columns), two))
    assert len(got) == len(want) and got == want


@pytest.mark.parametrize("bucket", [2 * DAY, 5 * 3600])
@pytest.mark.parametrize(("edge", "limit"), [("both", None), ("forward", None), ("both", 2)])
def test_interpolation(spark, bucket, edge, limit):
    df = long_series(spark, 1, strict=False)
    same(cleanse.interpolate(df, ["k"], "v", "y", edge, limit, bucket=bucket), cleanse.interpolate(df, ["k"], "v", "y", edge, limit))
    two = df.withColumn("w", F.when(F.hour("ts") % 5 == 0, F.col("v")))
    edges = {"v": edge, "w": "forward"}
    same(cleanse.interpolate_all(two, ["k"], edges, limit, bucket=bucket), cleanse.interpolate_all(two, ["k"], edges, limit))


def test_screens_fills_and_means(spark):
    df = long_series(spark, 2)
    same(cleanse.hampel_flags(df, ["k"], "v", 48, 2.0, bucket=2 * DAY), cleanse.hampel_flags(df, ["k"], "v", 48, 2.0))
    same(cleanse.seasonal_fill(df, ["k"], "v", "y", (48, 96), bucket=2 * DAY), cleanse.seasonal_fill(df, ["k"], "v", "y", (48, 96)))
    means = lambda rows, by: rows.withColumns({"m": features.trailing_mean(F.col("v"), by, 96), "l": F.lag("v", 336).over(timegrid.order(by))})
    same(buckets.in_buckets(df, ["k"], 336, 0, 96, means), means(df, ["k"]))


def test_one_series_is_many_tasks(spark):
    """No window has the series alone for its key, but that over the table of buckets."""
    df = long_series(spark, 3).filter("k = 'a'")
    largest = buckets.in_buckets(df, ["k"], 48, 0, 96, lambda rows, by: rows.withColumn("n", F.count("*").over(buckets.Window.partitionBy(*by)))).agg(F.max("n")).first()[0]
    assert largest == 96 + 48


def test_empty(spark):
    df = long_series(spark, 4).limit(0)
    assert cleanse.seasonal_fill(df, ["k"], "v", "y", bucket=DAY).count() == 0 == cleanse.hampel_flags(df, ["k"], "v", bucket=DAY).count()
