"""Seasonal bases, the choice among candidates, single precision and one-off holidays."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridtempo.operators import features, forecasters, reports


@pytest.mark.parametrize(("rbf", "want"), [(0.995, "f1"), (0.98, "r"), (0.99, "f1"), (1.2, "f1")])
def test_another_family_must_win_by_the_margin(spark, rbf, want):
    rows = spark.createDataFrame([("f2", "fourier", 1.1), ("f1", "fourier", 1.0), ("r", "rbf", rbf)], "name string, family string, crps double")
    got = forecasters.chosen(rows, "name", "family", "fourier").filter("chosen").collect()
    assert [r.name for r in got] == [want]


def test_ties_go_to_the_smallest_name_and_one_family_needs_no_margin(spark):
    rows = spark.createDataFrame([("b", "rbf", 1.0), ("a", "rbf", 1.0)], "name string, family string, crps double")
    assert [r.name for r in forecasters.chosen(rows, "name", "family", "fourier").filter("chosen").collect()] == ["a"]


def test_bases_are_dispatched_and_unknown_ones_refused():
    assert len(features.seasonal("ts", "UTC")) == 2 * (features.DAILY + features.WEEKLY)
    assert len(features.seasonal("ts", "UTC", "rbf", 5, 4)) == 4 + 3
    with pytest.raises(ValueError, match="spline"):
        features.seasonal("ts", "UTC", "spline")


def test_the_design_takes_the_named_basis(spark):
    rows = spark.range(3).select(F.lit("a").alias("k"), (F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(mins=F.col("id") * 30)).cast("timestamp_ntz").alias("ts"), *[F.lit(1.0).alias(c) for c in ("temp", "dew", "dni", "dhi", "wind", "apptemp", "demand_mw")], F.lit(False).alias("is_holiday"))
    names = features.build_design(rows, ["k"], "UTC", basis="rbf").columns
    assert "day_rbf18" in names and "week_rbf10" in names and "cooling_sin1" in names and not [n for n in names if n.startswith("day_sin")]


def test_doubles_become_single_also_in_arrays(spark):
    row = spark.createDataFrame([(1, 0.1, [0.1, 2.0], "x")], "i int, d double, a array<double>, s string")
    out = reports.to_float32(row)
    assert [f.dataType.simpleString() for f in out.schema] == ["int", "float", "array<float>", "string"]
    assert out.first().d == pytest.approx(0.1, abs=1e-7) and out.first().d != 0.1


def test_one_off_days_are_holidays():
    assert dt.date(2022, 9, 22) in features.nsw_holidays(2022) and dt.date(2023, 9, 22) not in features.nsw_holidays(2023)
