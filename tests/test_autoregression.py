"""Fits from sums of products against fits over whole arrays; the likelihood across gaps against one multivariate normal."""

import numpy as np
import pandas as pd
import pytest
from brute_ar import ar_errors_fit, normal_log_likelihood
from pyspark.sql import functions as F

from gridtempo.operators import autoregression

START = pd.Timestamp("2024-03-01")


def series(n, phi, seed, level=0.0):
    rng = np.random.default_rng(seed)
    e = np.zeros(n)
    for i in range(n):
        e[i] = sum(f * e[i - 1 - k] for k, f in enumerate(phi) if i > k) + rng.normal()
    x = np.column_stack([rng.normal(size=n), np.sin(np.arange(n) / 7)])
    return level + x @ [2.0, -1.0] + e, x


def frame(spark, parts, gaps_as_rows=True):
    out = []
    for k, (y, x) in parts.items():
        pdf = pd.DataFrame({"k": k, "ts": START + pd.to_timedelta(30 * np.arange(len(y)), "min"), "y": y, "x0": x[:, 0], "x1": x[:, 1]})
        out.append(pdf if gaps_as_rows else pdf[np.isfinite(pdf["y"])])
    pdf = pd.concat(out).sample(frac=1, random_state=1)
    return spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))


@pytest.mark.parametrize("rows", [True, False])
@pytest.mark.parametrize("bucket", [7, 64, 4096])
def test_fit_equals_that_over_the_whole_array(spark, bucket, rows):
    rng = np.random.default_rng(3)
    parts = {}
    for k, level in (("a", 0.0), ("b", 1e6)):
        y, x = series(700, [0.5, 0.3], ord(k), level)
        y[rng.random(700) < 0.05] = np.nan
        y[300:420] = np.nan
        parts[k] = (y, x)
    found = {r.k: r for r in autoregression.ar_regression(frame(spark, parts, rows), ["k"], "y", ["x0", "x1"], 2, bucket=bucket).collect()}
    for k, (y, x) in parts.items():
        beta, phi, sigma = ar_errors_fit(y, np.column_stack([np.ones(len(y)), x]), 2)
        r = found[k]
        assert np.allclose(r.beta, beta, rtol=1e-6, atol=1e-5) and np.allclose(r.phi, phi, atol=1e-6) and r.sigma == pytest.approx(sigma, rel=1e-6)


@pytest.mark.parametrize("bucket", [5, 40, 4096])
def test_likelihood_equals_one_multivariate_normal(spark, bucket):
    rng = np.random.default_rng(4)
    whole, x = series(260, [0.6, 0.2], 1)
    holes, long = whole.copy(), whole.copy()
    holes[rng.random(260) < 0.4] = np.nan  # hardly ever as many readings in a row as the order
    holes[0] = np.nan
    long[30:200] = np.nan
    lone = np.where(np.arange(260) % 50 == 3, whole, np.nan)
    parts = {"whole": (whole, x), "holes": (holes, x), "long": (long, x), "lone": (lone, x)}
    points = [(k, i, [0.1, 1.9, -1.1], phi, 1.2) for k in parts for i, phi in enumerate([[0.5], [0.6, 0.2], [0.4, 0.1, 0.2]])]
    points = spark.createDataFrame(points, "k string, point int, beta array<double>, phi array<double>, sigma double")
    for rows in (True, False):
        found = autoregression.ar_log_likelihood(frame(spark, parts, rows), points, ["k"], "y", ["x0", "x1"], bucket=bucket).collect()
        assert len(found) == 12
        for r in found:
            y, _ = parts[r.k]
            e = y - 0.1 - x @ [1.9, -1.1]
            assert r.n == np.isfinite(y).sum()
            assert r.log_likelihood == pytest.approx(normal_log_likelihood(e, [[0.5], [0.6, 0.2], [0.4, 0.1, 0.2]][r.point], 1.2), abs=1e-7)


def test_odd_series_and_points(spark):
    y, x = series(60, [0.5], 2)
    never = np.where(np.arange(60) % 2 == 0, y, np.nan)
    df = frame(spark, {"a": (y, x), "never": (never, x)})
    found = {r.k: r for r in autoregression.ar_regression(df, ["k"], "y", ["x0"], 1).collect()}
    assert found["never"].beta is None and found["never"].phi is None and found["never"].sigma is None and found["a"].sigma > 0
    empty = df.limit(0)
    assert autoregression.ar_regression(empty, ["k"], "y", ["x0"], 1).count() == 0
    points = [("a", 0, [0.0, 2.0], [1.0], 1.0), ("a", 1, [0.0, 2.0], [0.5], 0.0), ("a", 2, None, [0.5], 1.0), ("a", 3, [0.0, 2.0], [0.5], 1.0), ("z", 0, [0.0, 2.0], [0.5], 1.0)]
    points = spark.createDataFrame(points, "k string, point int, beta array<double>, phi array<double>, sigma double")
    found = {(r.k, r.point): r.log_likelihood for r in autoregression.ar_log_likelihood(df, points, ["k"], "y", ["x0"]).collect()}
    assert found["a", 3] < 0 and all(found[k] is None for k in found if k != ("a", 3)) and len(found) == 5
    twice = df.unionByName(df)
    again = {(r.k, r.point): r.log_likelihood for r in autoregression.ar_log_likelihood(twice, points, ["k"], "y", ["x0"]).collect()}
    assert again["a", 3] == pytest.approx(found["a", 3], abs=1e-9)


def test_no_task_holds_a_series(spark):
    y, x = series(1000, [0.5], 5)
    df = frame(spark, {"a": (y, x)})
    sums = autoregression._placed(df, ["k"], "y", ["x0"], "ts", 1800, 50, 2).groupBy("k", "__bucket").count()
    assert sums.agg(F.max("count")).first()[0] == 52 and sums.count() in (21, 22)
    assert autoregression.lagged_products(df, ["k"], "y", ["x0"], 2, bucket=50).first().n == 998
