"""Simulated paths belong to their series and origin; the boosting rate is the fitted one."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from gridtempo.operators import forecasters, models


def test_series_have_draws_of_their_own_and_reruns_agree(spark):
    model = spark.createDataFrame([("a", [0.5], 1.0), ("b", [0.5], 1.0)], "k string, phi array<double>, sigma double")
    first, second = ({(r.k, r.draw): r.path for r in models.ar_paths(model.repartition(n), ["k"], 6, 3, 1).collect()} for n in (1, 3))
    assert first == second and all(first["a", d] != first["b", d] for d in range(3))


def perturbation(spark):
    return spark.createDataFrame([(k, s, 0.8, 1.0) for k in "ab" for s in range(4)], "k string, step int, rho double, sigma double")


def test_series_and_names_have_errors_of_their_own(spark):
    draw = lambda *name: {(r.k, r.draw): r.error for r in models.perturbation_sample(perturbation(spark), ["k"], 2, 5, *name).collect()}
    one, other = draw(), draw("dew")
    assert one == draw() and one["a", 0] != one["b", 0] and one["a", 0] != other["a", 0]


def test_origins_have_paths_of_their_own(spark):
    t0 = dt.datetime(2024, 1, 1)
    half = dt.timedelta(minutes=30)
    panel = spark.createDataFrame([("a", t0 + i * half, 10.0) for i in range(20)], "k string, ts timestamp, temp double")
    origins = spark.createDataFrame([("a", t0), ("a", t0 + 8 * half)], "k string, origin timestamp")
    got = forecasters.perturbed(perturbation(spark), origins, panel, ["k"], "temp", 1.0, 5, steps=4).orderBy("ts")
    errors = np.array([r.temp for r in got.collect()]) - 10
    assert len(errors) == 8
    assert not np.allclose(np.abs(errors[:4]), np.abs(errors[4:]))
    assert got.agg(F.count("*")).first()[0] == 8


def test_predictions_use_the_fitted_rate(spark):
    rows = [("a", i, i / 100, 2.0 * (i / 100), i % 2 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, row long, x double, y double, train boolean")
    for rate in (0.1, 0.5):
        found = models.quantile_boost(df, ["k"], "y", ["x"], [0.5], "train", rate=rate, trees=60, least=20).collect()
        assert len(found) == 200 and np.mean([abs(r.value - r.y) for r in found]) < 0.3


def test_held_rows_stop_boosting_and_the_mean_has_a_head(spark):
    rng = np.random.default_rng(0)
    rows = [("a", i, float(x), float(3 * x + rng.exponential()), i % 3 == 0, i % 3 == 1) for i, x in enumerate(rng.uniform(0, 1, 900))]
    df = spark.createDataFrame(rows, "k string, row long, x double, y double, train boolean, held boolean")
    found = models.quantile_boost(df, ["k"], "y", ["x"], [0.1, 0.5], "train", "held", mean=True).collect()
    assert {r.row % 3 for r in found} == {2} and len(found) == 600
    low, middle = ([r for r in found if r.level == q] for q in (0.1, 0.5))
    assert 0.03 < np.mean([r.y < r.value for r in low]) < 0.2 and 0.4 < np.mean([r.y < r.value for r in middle]) < 0.6
    assert np.mean([r["mean"] for r in middle]) > np.mean([r.value for r in middle]) + 0.15


def test_heads_without_held_rows_grow_all_their_trees():
    x = np.arange(200.0)[:, None]
    base, forest = models.boosted_quantiles(x, x[:, 0], 0.5, trees=7)
    assert len(forest) == 7 and base == 99.5


def test_log_density_at_the_means_is_highest_near_the_mode(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=200)
    rows = spark.createDataFrame([("a", float(v), float(2 * v + rng.normal())) for v in x], "k string, x double, y double")
    target = models.regression_target(rows.toPandas(), "y", ["x"])
    points = {0: [0.0, 0.9, -0.8], 1: [0.5, -0.9, 0.5]}
    sites = ["beta_0", "beta_1", "log_sigma"]
    draws = [("a", c, d, s, v + (0.1 if d else -0.1)) for c, t in points.items() for d in range(2) for s, v in zip(sites, t, strict=True)]
    found = spark.createDataFrame(draws, "k string, chain int, draw int, site string, value double")
    got = {r.chain: r.log_density for r in models.log_density_at_means(found, rows, ["k"], "y", ["x"]).collect()}
    assert all(abs(got[c] - target(np.array(t))[0]) < 1e-9 for c, t in points.items()) and got[0] > got[1]
