import datetime as dt
import math

import brute_mcmc
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brute_ar import ar_errors_fit
from gridtempo.operators import cleanse, diagnostics, forecasters, innovations, models
from gridtempo.plans import queries

START = dt.datetime(2024, 1, 20)
PLACE = {"latitude": -33.87, "longitude": 151.21, "zone": "Australia/Sydney", "years": (2023, 2024)}


def frame(spark, values, minutes, name, start=START):
    rows = [("a", start + dt.timedelta(minutes=minutes * i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"k string, ts timestamp_ntz, {name} double")


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(0)
    demand = [float(v) for v in 5000 + rng.normal(size=96 * 4)]
    demand[7], demand[200] = None, 19000.0
    weather = [20.0 + i % 24 for i in range(24 * 9)]
    issued = [None] * 24 + weather[24:60] + [None] * 12 + weather[72:]
    actual = frame(spark, weather, 60, "temp").withColumn("dni", F.col("temp") * 100)
    forecast = frame(spark, issued, 60, "temp").withColumn("dni", F.col("temp"))
    out = cleanse.build_panel(frame(spark, demand, 30, "demand_mw"), actual, forecast, ["k"], ["temp", "dni"], **PLACE)
    return out, {r.ts: r for r in out.collect()}, demand, weather


def test_demand_is_filled_and_screened(panel):
    _, rows, demand, _ = panel
    at = sorted(rows)
    assert len(rows) == len(demand)
    assert rows[at[7]].demand_mw == pytest.approx((demand[6] + demand[8]) / 2) and rows[at[7]].demand_missing
    assert rows[at[200]].demand_mw == pytest.approx((demand[199] + demand[201]) / 2) and rows[at[200]].demand_outlier
    assert [i for i, t in enumerate(at) if rows[t].demand_imputed] == [7, 200]


def test_forecasts_fall_back_to_actuals_only_before_their_first_value(panel):
    _, rows, _, weather = panel
    at = sorted(rows)
    assert [rows[t].temp_fallback for t in at] == [i < 48 for i in range(len(at))]
    assert [rows[t].temp_fc for t in at[:48:2]] == weather[:24]
    # the twelve missing hours: eight are bridged from value to value, the rest from the eighth to the next value, on the same line
    a, b = weather[59], weather[72]
    assert rows[START + dt.timedelta(hours=64)].temp_fc == pytest.approx(a + (b - a) * 5 / 13)


def test_irradiance_is_zero_at_night_and_within_bounds(panel):
    _, rows, _, weather = panel
    noon, midnight = rows[START + dt.timedelta(hours=2)], rows[START + dt.timedelta(hours=14)]
    assert noon.dni == 1500.0 and midnight.dni == 0.0 and midnight.dni_fc == 0.0


def test_holidays_follow_the_local_day(panel):
    _, rows, _, _ = panel
    held = [t for t in sorted(rows) if rows[t].is_holiday]
    assert held[0] == dt.datetime(2024, 1, 25, 13) and held[-1] == dt.datetime(2024, 1, 26, 12, 30)


def test_the_report_counts_each_repair(panel):
    out, _, _, _ = panel
    got = {(r.column, r.repair): r.n for r in cleanse.panel_report(out, ["k"], ["temp", "dni"]).collect()}
    assert got == {("demand_mw", "missing"): 1, ("demand_mw", "outliers"): 1, ("demand_mw", "imputed"): 2, ("demand_mw", "unfilled"): 0, **{(f"{v}_fc", r): n for v in ("temp", "dni") for r, n in (("gaps", 36), ("from actuals", 48))}}


def test_demand_without_any_reading_is_an_error(spark, panel):
    cleanse.require_filled(panel[0])
    empty = frame(spark, [None, None], 30, "demand_mw")
    weather = frame(spark, [1.0], 60, "temp")
    with pytest.raises(ValueError, match="too long"):
        cleanse.require_filled(cleanse.build_panel(empty, weather, weather, ["k"], ["temp"], **PLACE))


def test_many_columns_are_interpolated_as_one_by_one(spark):
    rng = np.random.default_rng(1)
    values = [[float(v) if u > 0.6 else None for v, u in zip(rng.normal(size=60), rng.random(60), strict=True)] for _ in range(2)]
    df = spark.createDataFrame([("a", START + dt.timedelta(minutes=30 * i), x, y) for i, (x, y) in enumerate(zip(*values, strict=True))], "k string, ts timestamp_ntz, x double, y double")
    for limit in (None, 2):
        both = cleanse.interpolate_all(df, ["k"], {"x": "both", "y": "forward"}, limit).orderBy("ts").collect()
        x = cleanse.interpolate(df, ["k"], "x", "o", "both", limit).orderBy("ts").collect()
        y = cleanse.interpolate(df, ["k"], "y", "o", "forward", limit).orderBy("ts").collect()
        assert [(r.x, r.y) for r in both] == [(a.o, b.o) for a, b in zip(x, y, strict=True)]


def test_a_column_may_be_in_both_designs(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "ts": pd.date_range(START, periods=80, freq="30min"), "y": rng.normal(size=80), "one": 1.0, "s": rng.normal(size=80)}))
    r = innovations.fit(df, ["k"], "y", ["one", "s"], ["s"], draws=2, steps=20).first()
    assert len(r.beta) == 2 and len(r.gamma) == 1


def test_no_lag_spans_a_gap():
    rng = np.random.default_rng(3)
    n, e = 4000, np.zeros(4000)
    for t in range(2, n):
        e[t] = 0.6 * e[t - 1] + 0.2 * e[t - 2] + rng.normal()
    x = np.ones((n, 1))
    y = e + 5
    y[rng.random(n) < 0.15] = np.nan
    _, phi, sigma = ar_errors_fit(y, x, 2)
    assert phi == pytest.approx([0.6, 0.2], abs=0.06) and sigma == pytest.approx(1, abs=0.05)
    # a gap takes the three equations that it touches out of the structural model, and nothing else
    z, part = rng.normal(size=(30, 1)), y[:30].copy()
    part[:] = e[:30]
    part[10] = np.nan
    target = innovations.Target(part, x[:30], z)
    assert np.flatnonzero(target.whole == 0).tolist() == [8, 9, 10]
    t = rng.normal(size=target.size) * 0.3
    value, gradient = target(t)
    for i in range(target.size):
        step = np.zeros(target.size)
        step[i] = 1e-6
        assert (target(t + step)[0] - target(t - step)[0]) / 2e-6 == pytest.approx(gradient[i], abs=1e-4)


def test_any_order_is_carried(spark):
    phi, last = [0.4, 0.2, 0.1], [1.0, -2.0, 3.0]
    row = spark.createDataFrame([(phi, last)], "phi array<double>, last array<double>").select(innovations.carried_by(F.col("phi"), F.col("last"), 3, 5).alias("c")).first()
    assert row.c == pytest.approx(models.carry(np.array(phi), np.array(last[::-1]), 5).tolist())
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "ts": pd.date_range(START, periods=400, freq="30min"), "x": rng.normal(size=400), "y": rng.normal(size=400).cumsum() / 5})).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    model = forecasters.ArRegression(["k"], "y", ["x"], p=3, horizon=4).fit(df)
    origins = spark.createDataFrame([("a", START + dt.timedelta(hours=100))], "k string, origin timestamp_ntz")
    rows = model.forecast(df, origins).orderBy("step").collect()
    f = model.fitted.first()
    psi = models.impulse_response(np.array(f.phi), 4)
    assert len(f.phi) == 3 and [r.sd for r in rows] == pytest.approx([f.sigma * math.sqrt((psi[: h + 1] ** 2).sum()) for h in range(4)])


def test_covariances_match_numpy(spark):
    x = np.random.default_rng(5).normal(size=(200, 6)) @ np.random.default_rng(6).normal(size=(6, 6)) + 100
    mean, cov = diagnostics.moments(spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(7), "v")
    assert mean == pytest.approx(x.mean(0)) and cov == pytest.approx(np.cov(x, rowvar=False))


def test_repeated_draws_keep_the_neighbour_estimate_finite():
    p = np.repeat(np.random.default_rng(7).normal(size=(4, 2)), 10, axis=0)
    assert math.isfinite(brute_mcmc.knn_kl(p, p))


def test_a_sample_pit_lies_within_its_ties(spark, sf_dir):
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    d = queries.draws(t).groupBy("label", "step").agg(F.avg((F.col("x") < F.col("y")).cast("double")).alias("below"), F.avg((F.col("x") <= F.col("y")).cast("double")).alias("upto"), F.count("*").alias("n"))
    rows = queries.QUERIES["sample_pit"](spark, sf_dir).join(d, ["label", "step"]).collect()
    assert rows and all(r.below - 1e-6 <= r.pit <= r.upto + 1 / r.n + 1e-6 for r in rows)


def test_moments_of_the_structural_model_are_numbers(spark, sf_dir):
    rows = queries.QUERIES["innovations_moments"](spark, sf_dir).collect()
    assert rows and all(r.parameter >= 0 and r.innovation > 0 for r in rows)
