import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import brute_mcmc
from gridtempo.operators import autoregression, calibration, cleanse, diagnostics, features, gates, models, scenarios, scores, splits, timegrid

START = dt.datetime(2025, 6, 1)
HALF = dt.timedelta(minutes=30)


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, START + i * HALF, None if v is None or math.isnan(v) else float(v)) for i, v in enumerate(values)], "k string, ts timestamp_ntz, v double")


def column(df, name):
    return [r[name] for r in df.orderBy("ts").collect()]


def test_periods_are_closed_on_the_right(spark):
    stamps = [("a", dt.datetime(2024, 1, 1, 0, 30), 1.0), ("a", dt.datetime(2024, 1, 1, 0, 5), 3.0), ("a", dt.datetime(2024, 1, 1, 0, 0), 9.0), ("a", dt.datetime(2024, 1, 1, 0, 30, 1), 5.0)]
    got = {r.ts: r.demand_mw for r in timegrid.period_end_resample(spark.createDataFrame(stamps, "k string, t timestamp_ntz, v double"), ["k"], "t", "v").collect()}
    assert got == {dt.datetime(2023, 12, 31, 23, 30): 9.0, dt.datetime(2024, 1, 1): 2.0, dt.datetime(2024, 1, 1, 0, 30): 5.0}


def test_latest_revision_wins_and_ties_are_settled(spark):
    rows = [(1, START, 10, "x"), (1, START + HALF, 11, "y"), (1, START + HALF, 12, "z"), (2, START, 5, "w")]
    got = timegrid.latest_revision(spark.createDataFrame(rows, "k int, changed timestamp_ntz, id int, v string"), ["k"], "changed", "id").orderBy("k").collect()
    assert [r.v for r in got] == ["z", "w"]


def test_grid_has_every_period_and_audit_counts(spark):
    df = series(spark, [1, 2, 3, 4]).filter(F.col("v") != 3)
    assert column(timegrid.align(df, ["k"]), "v") == [1, 2, None, 4]
    r = timegrid.grid_audit(df.unionByName(df.filter("v = 1")), ["k"]).first()
    assert (r.present, r.expected, r.missing, r.duplicates) == (4, 4, 1, 1)


@pytest.mark.parametrize(("edge", "limit"), [("both", None), ("forward", None), ("both", 2)])
def test_interpolation_matches_pandas(spark, edge, limit):
    rng = np.random.default_rng(3)
    v = rng.normal(size=300)
    v[rng.random(300) < 0.3] = np.nan
    v[100:120] = v[:3] = v[-4:] = np.nan
    index = pd.date_range(START, periods=300, freq="30min")
    s = pd.Series(v, index)
    want = s.interpolate(method="time", limit=limit)
    if edge == "both" and limit is None:
        want = s.interpolate(method="time", limit_direction="both")
    got = column(cleanse.interpolate(series(spark, v), ["k"], "v", "y", edge="forward" if limit else edge, limit=limit), "y")
    np.testing.assert_allclose(np.array([np.nan if x is None else x for x in got]), want.to_numpy(), rtol=1e-12)


def test_hampel_flags_only_the_spike(spark):
    rng = np.random.default_rng(0)
    v = 100 + rng.normal(size=700)
    v[350] = 500
    s = pd.Series(v)
    median = s.rolling(336, center=True, min_periods=84).median()
    mad = (s - median).abs().rolling(336, center=True, min_periods=84).median()
    rows = cleanse.hampel_flags(series(spark, v), ["k"], "v").orderBy("ts").collect()
    np.testing.assert_allclose([r.rolling_median for r in rows], median, rtol=1e-12)
    np.testing.assert_allclose([r.rolling_mad for r in rows], mad, rtol=1e-9)
    assert [i for i, r in enumerate(rows) if r.is_outlier] == [350]


def test_seasonal_fill_takes_last_week_and_marks_what_was_missing(spark):
    v = np.arange(800, dtype=float) % 336
    v[500:520] = np.nan
    rows = cleanse.seasonal_fill(series(spark, v), ["k"], "v", "y").orderBy("ts").collect()
    assert [r.y for r in rows[503:518]] == [float((i - 336) % 336) for i in range(503, 518)]
    assert sum(r.y_imputed for r in rows) == 20


def test_sun_is_high_at_noon_and_low_at_night(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 12, 21, 2, 0),), (dt.datetime(2025, 12, 21, 14, 0),)], "ts timestamp_ntz")
    noon, night = (r[0] for r in df.orderBy("ts").select(cleanse.solar_elevation("ts", -33.87, 151.21)).collect())
    assert 78 < noon < 81 and night < -25


def test_gates_report_and_raise(spark):
    good = series(spark, [5, 6, 7, 8]).withColumnRenamed("v", "demand_mw")
    gates.check_inputs(good, ["k"], ["demand_mw"])
    for bad in ([5, None, 7, 8], [5, -50, 7, 8], [21, 21, 21, 21]):
        with pytest.raises(gates.GateError):
            gates.check_inputs(series(spark, bad).withColumnRenamed("v", "demand_mw"), ["k"], ["demand_mw"])
    with pytest.raises(gates.GateError):
        gates.check_inputs(good.filter("demand_mw <> 6"), ["k"], ["demand_mw"])
    schema = T.StructType([T.StructField("demand_mw", T.DoubleType())])
    gates.check_schema(good, schema, ["k"], positive="demand_mw")
    for bad in (good.drop("demand_mw"), good.withColumn("demand_mw", F.col("demand_mw").cast("float")), good.unionByName(good), good.withColumn("demand_mw", -F.col("demand_mw"))):
        with pytest.raises(gates.GateError):
            gates.check_schema(bad, schema, ["k"], positive="demand_mw")


def test_forecast_gates(spark):
    q = spark.createDataFrame([(0, 0.1, 1.0), (0, 0.5, 3.0), (0, 0.9, 2.0), (1, 0.1, 1.0), (1, 0.9, 2.0)], "step int, level double, v double")
    got = {r.step: r.ok for r in gates.quantile_issues(q, ["step"], "level", "v", 0, 10).collect()}
    assert got == {0: False, 1: True}
    with pytest.raises(gates.GateError):
        gates.check_forecast(gates.quantile_issues(q, ["step"], "level", "v", 0, 10))


def test_degree_days_and_bases(spark):
    df = spark.createDataFrame([(x,) for x in (10.0, 16.5, 18.0, 20.5, 25.0, None)], "t double")
    d = features.degree_days(F.col("t"))
    got = [(r.c, r.h) for r in df.select(d["cooling"].alias("c"), d["heating"].alias("h")).collect()]
    assert got == [(0, 6.5), (0, 0), (0, 0), (0, 0), (4.5, 0), (None, None)]
    r = spark.range(1).select(*[c.alias(n) for n, c in features.periodic_rbf(F.lit(0.0), 4, "x").items()]).first()
    assert len(r) == 3 and r[0] == 1.0 and r[1] == pytest.approx(math.exp(-0.5))


def test_holidays_follow_the_public_rules():
    h = features.nsw_holidays(2022)
    assert {dt.date(2022, 4, 15), dt.date(2022, 4, 18), dt.date(2022, 6, 13), dt.date(2022, 10, 3), dt.date(2022, 12, 27), dt.date(2022, 1, 3)} <= h
    assert features.easter_sunday(2024) == dt.date(2024, 3, 31) and features.easter_sunday(2000) == dt.date(2000, 4, 23)


def test_design_has_65_columns_and_does_not_leak(spark):
    rng = np.random.default_rng(1)
    v = 20 + rng.normal(size=800)

    def panel(values):
        extra = {c: F.col("v") for c in ("temp", "dew", "dni", "dhi", "wind", "apptemp")}
        return series(spark, values).withColumns(extra).withColumn("is_holiday", F.lit(False)).withColumnRenamed("v", "demand_mw")

    a = features.build_design(panel(v), ["k"], "Australia/Sydney")
    assert len(a.columns) == 2 + 65
    later = v.copy()
    later[400:] += 50
    b = features.build_design(panel(later), ["k"], "Australia/Sydney")
    rows = lambda d: [tuple(r) for r in d.orderBy("ts").limit(400).collect()]
    assert rows(a) == rows(b)


def test_season_split_is_balanced_disjoint_and_ordered(spark):
    days = spark.sql("SELECT explode(sequence(date'2024-06-01', date'2026-05-31')) AS day")
    out = splits.season_split(days, "2025-06-01", (8, 12), (19, 23), 20260613)
    n = {r.split: r.n for r in splits.split_summary(out, "day", 1).collect()}
    assert n["train"] == 365 and n["validation"] == n["test"] == 60
    splits.check_order(out, "day")
    with pytest.raises(ValueError):
        splits.check_order(out.withColumn("split", F.when(F.col("split") == "train", "test").otherwise("train")), "day")


def test_origins_need_history_and_a_scored_end(spark):
    df = series(spark, range(48 * 10))
    got = column(splits.rolling_origins(df, ["k"], (0, 12), F.col("v") >= 0).withColumnRenamed("origin", "ts"), "ts")
    assert got == [START + dt.timedelta(days=7), START + dt.timedelta(days=7.5), START + dt.timedelta(days=8), START + dt.timedelta(days=8.5), START + dt.timedelta(days=9)]


def test_sample_scores_match_their_definitions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2))
    y = [0.3, -1.2]
    df = spark.createDataFrame([(t, float(x[i, t]), y[t]) for t in range(2) for i in range(300)], "step int, x double, y double")
    got = {r.step: r.crps for r in scores.crps_samples(df, ["step"], "x", "y").collect()}
    for t in range(2):
        assert got[t] == pytest.approx(np.abs(x[:, t] - y[t]).mean() - 0.5 * np.abs(x[:, t, None] - x[None, :, t]).mean(), abs=1e-12)
    paths = spark.createDataFrame([(0, x[i].tolist(), y) for i in range(300)], "o int, path array<double>, y array<double>")
    want = np.sqrt(((x - y) ** 2).sum(1)).mean() - 0.5 * np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)).mean()
    assert scores.energy_score(paths, ["o"], "path", "y", block=64).first().energy_score == pytest.approx(want, abs=1e-12)


def test_gaussian_crps_is_the_limit_of_the_sample_form(spark):
    from gridtempo.functions import mathx

    draws = np.random.default_rng(0).normal(2, 3, 40000)
    df = spark.createDataFrame(pd.DataFrame({"g": 0, "x": draws, "y": 4.0}))
    sampled = scores.crps_samples(df, ["g"], "x", "y").first().crps
    exact = spark.range(1).select(mathx.col(scores.crps_gaussian("4.0D", "2.0D", "3.0D")).alias("c")).first().c
    assert sampled == pytest.approx(exact, rel=0.02)


def test_bootstrap_finds_a_difference_and_none(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"m": 0, "o": range(200), "a": a + 0.5, "b": a + rng.normal(size=200) * 0.1}))
    r = scores.paired_bootstrap(df, ["m"], "o", "a", "b", 2000).first()
    assert r.low < 0.5 < r.high and r.p_value == 0
    assert scores.paired_bootstrap(df.withColumn("a", F.col("b")), ["m"], "o", "a", "b", 500).first().p_value == 0


def test_pit_is_uniform_for_a_calibrated_forecast(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame({"pit": rng.random(5000)}))
    assert calibration.ks_by(df.withColumn("g", F.lit(1)), ["g"], "pit").first().ks < calibration.ks_band(5000, 0.001)
    h = calibration.histogram(df, [], "pit", 10)
    assert h.agg(F.sum("n")).first()[0] == 5000 and h.count() == 10


def test_ar2_errors_are_recovered(spark):
    rng = np.random.default_rng(5)
    n, e = 6000, np.zeros(6000)
    for t in range(2, n):
        e[t] = 0.5 * e[t - 1] + 0.3 * e[t - 2] + rng.normal() * 2
    x = rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "ts": pd.date_range(START, periods=n, freq="30min"), "x": x, "y": 3 + 2 * x + e}))
    r = autoregression.ar_regression(df, ["k"], "y", ["x"], 2).first()
    assert r.beta[1] == pytest.approx(2, abs=0.1) and r.phi == pytest.approx([0.5, 0.3], abs=0.05) and r.sigma == pytest.approx(2, abs=0.1)
    paths = models.ar_paths(autoregression.ar_regression(df, ["k"], "y", ["x"], 2), ["k"], 30, 4000, 1)
    psi = models.impulse_response(np.array(r.phi), 30)
    sd = paths.select(F.stddev_pop(F.get("path", F.lit(29)))).first()[0]
    assert sd == pytest.approx(r.sigma * math.sqrt((psi**2).sum()), rel=0.06)
    assert models.carry(np.array([0.5]), np.array([4.0]), 3).tolist() == [2.0, 1.0, 0.5]


def test_perturbation_errors_have_the_fitted_law(spark):
    model = spark.createDataFrame([("a", s, 0.8, 2.0) for s in range(48)], "k string, step int, rho double, sigma double")
    rows = models.perturbation_sample(model, ["k"], 3000, 1)
    r = rows.select(F.stddev(F.get("error", F.lit(40))).alias("s"), F.corr(F.get("error", F.lit(40)), F.get("error", F.lit(41))).alias("c")).first()
    assert r.s == pytest.approx(2, rel=0.06) and r.c == pytest.approx(0.8, abs=0.04)


def test_boosted_quantiles_beat_a_constant():
    rng = np.random.default_rng(0)
    x = rng.uniform(-2, 2, (3000, 2))
    y = np.sin(x[:, 0]) * 3 + rng.normal(size=3000)
    for level in (0.1, 0.9, None):
        base, forest = models.boosted_quantiles(x[:1500], y[:1500], level, held=(x[1500:2000], y[1500:2000]))
        assert 10 < len(forest) < models.TREES
        f = base + models.RATE * sum(models.tree_values(t, x[2000:]) for t in forest)
        loss = lambda p, q=level: np.mean((y[2000:] - p) ** 2) if q is None else np.mean(np.maximum(q * (y[2000:] - p), (q - 1) * (y[2000:] - p)))  # noqa: B023, E731
        assert loss(f) < 0.75 * loss(np.full(1000, base))


def test_nuts_and_vi_agree_with_the_conjugate_posterior():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(300), rng.normal(size=300)])
    y = x @ [1.0, -2.0] + 0.5 * rng.normal(size=300)
    target = models.LinearGaussian(x, y)
    m, low, trace = models.advi(target, 3, steps=800)
    draws, told = models.nuts(target, m, 400, 200, 1, low)
    ols = np.linalg.lstsq(x, y, rcond=None)[0]
    assert draws.mean(0)[:2] == pytest.approx(ols, abs=0.03) and m[:2] == pytest.approx(ols, abs=0.05)
    assert draws.std(0)[0] == pytest.approx(0.5 / math.sqrt(300), rel=0.3) and not told.diverging.any() and trace[-1] > trace[0]


def test_chain_summaries():
    rng = np.random.default_rng(0)
    good = rng.normal(size=(4, 1000))
    assert brute_mcmc.rank_r_hat(good) < 1.01 and 2500 < brute_mcmc.effective_size(good) < 6000
    assert brute_mcmc.rank_r_hat(good + np.arange(4)[:, None]) > 1.3
    sticky = np.cumsum(good, axis=1)
    assert brute_mcmc.effective_size(sticky) < 100


def test_divergences():
    rng = np.random.default_rng(0)
    p, q = rng.normal(size=(4000, 2)), rng.normal(size=(4000, 2)) + [1, 0]
    assert brute_mcmc.knn_kl(p, q) == pytest.approx(0.5, abs=0.1)
    eye = np.eye(2)
    assert diagnostics.gaussian_kl(np.zeros(2), eye, np.array([1.0, 0]), eye) == pytest.approx(0.5, abs=1e-6)
    with pytest.raises(ValueError):
        brute_mcmc.knn_kl(p[:3], q)


def test_path_functionals_and_console(spark):
    df = spark.createDataFrame([(0, i, [1.0, 5.0, 2.0 + i]) for i in range(4)], "o int, d int, path array<double>")
    p = F.col("path")
    r = df.orderBy("d").select(scenarios.max_ramp(p).alias("r"), scenarios.total(p).alias("t"), scenarios.stress_hours(p, F.lit(2.5)).alias("s")).collect()
    assert [(x.r, x.t, x.s) for x in r][0] == (4.0, 8.0, 0.5)
    c = scenarios.console(df, ["o"], "path", F.lit(4.9)).first()
    assert c.p_spike == 1.0 and c.alert == "red" and c.peak_median == 5.0
    a, b = (d.select(F.sum(scenarios.total(p))).first()[0] for d in (df, scenarios.shuffled_marginals(df, ["o"], "d", "path")))
    assert a == b


def test_unconstraining(spark):
    df = spark.createDataFrame([(0.25,)], "x double")
    r = df.select(diagnostics.to_unconstrained(F.col("x"), "unit_interval"), diagnostics.to_unconstrained(F.col("x"), "positive"), diagnostics.to_unconstrained(F.col("x"), "interval", 0, 1)).first()
    assert r[0] == pytest.approx(math.log(1 / 3)) and r[1] == pytest.approx(math.log(0.25)) and r[2] == pytest.approx(r[0])
    with pytest.raises(ValueError):
        diagnostics.to_unconstrained(F.col("x"), "simplex")
