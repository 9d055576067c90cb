import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridtempo.operators import innovations, models, reports

H = 6


@pytest.fixture(scope="module")
def parts(spark):
    rng = np.random.default_rng(0)
    draws = [("a", 0, d, 0.7 + 0.02 * d, 0.2, -0.3, [1.0, 0.5, -0.2 * d], [0.1, 0.05 * d]) for d in range(4)]
    d = spark.createDataFrame(draws, "k string, chain int, draw int, phi1 double, phi2 double, gamma0 double, beta array<double>, gamma array<double>")
    x, z = rng.normal(size=(H, 3)), rng.normal(size=(H, 2))
    design = spark.createDataFrame([("a", 0, x.tolist(), z.tolist())], "k string, origin int, xs array<array<double>>, zs array<array<double>>")
    ends = spark.createDataFrame([("a", 0, 1.2, [1.0, 0.0, 0.0], 0.4, [0.0, 1.0, 0.0])], "k string, origin int, y1 double, x1 array<double>, y2 double, x2 array<double>")
    return draws, d, design, ends, x, z


def test_origin_residuals_are_outcome_less_regression(parts):
    draws, d, design, ends, *_ = parts
    for r in innovations.origin_residuals(d, ends, ["k"]).collect():
        assert (r.e1, r.e2) == pytest.approx((1.2 - 1.0, 0.4 - 0.5))


def test_moments_equal_the_recursion_and_the_simulation(parts):
    draws, d, design, ends, x, z = parts
    residuals = innovations.origin_residuals(d, ends, ["k"])
    got = {(r.draw, r.step): (r["mean"], r.variance) for r in innovations.horizon_moments(d, residuals, design, ["k"], H).collect()}
    for _, _, j, phi1, phi2, g0, beta, gamma in draws:
        rho = np.array([phi1 * (1 - phi2), phi2])
        psi = models.impulse_response(rho, H)
        carry = models.carry(rho, np.array([0.2, -0.1]), H)
        s2 = np.exp(2 * (g0 + z @ gamma))
        for h in range(H):
            want = x[h] @ beta + carry[h], sum(psi[h - i] ** 2 * s2[i] for i in range(h + 1))
            assert got[j, h] == pytest.approx(want)
    many = d.filter("draw = 0").drop("draw").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(2999))))
    paths = innovations.horizon_paths(many, innovations.origin_residuals(many, ends, ["k"]), design, ["k"], H, 1)
    for h in (0, 5):
        r = paths.agg(F.avg(F.get("path", F.lit(h))), F.var_pop(F.get("path", F.lit(h)))).first()
        mean, variance = got[0, h]
        assert r[0] == pytest.approx(mean, abs=4 * math.sqrt(variance / 3000)) and r[1] == pytest.approx(variance, rel=0.1)


def test_paths_do_not_depend_on_partitions(parts):
    _, d, design, ends, *_ = parts
    run = lambda n: sorted((r.draw, r.path) for r in innovations.horizon_paths(d.repartition(n), innovations.origin_residuals(d, ends, ["k"]), design, ["k"], H, 1).collect())
    assert run(1) == run(5)


def test_the_gradient_is_that_of_the_density():
    rng = np.random.default_rng(1)
    target = innovations.Target(rng.normal(size=50), rng.normal(size=(50, 3)), rng.normal(size=(50, 2)))
    t = rng.normal(size=target.size) * 0.3
    _, g = target(t)
    for i in range(target.size):
        step = np.zeros(target.size)
        step[i] = 1e-6
        assert g[i] == pytest.approx((target(t + step)[0] - target(t - step)[0]) / 2e-6, rel=1e-4, abs=1e-4)


@pytest.mark.parametrize("chains", [0, 2])
def test_fits_recover_planted_values(spark, chains):
    rng = np.random.default_rng(2)
    n, r1, r2 = 1500, 0.6 * 0.8, 0.2
    x = rng.normal(size=n)
    e = np.zeros(n)
    for t in range(2, n):
        e[t] = r1 * e[t - 1] + r2 * e[t - 2] + rng.normal() * 0.5
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "ts": range(n), "y": 1.5 * x + e, "x": x, "z": rng.normal(size=n)}))
    found = innovations.fit(df, ["k"], "y", ["x"], ["z"], draws=100, chains=chains, warmup=80, steps=400)
    r = found.agg(F.avg("phi1"), F.avg("phi2"), F.avg(F.get("beta", F.lit(0))), F.avg(F.exp("gamma0"))).first()
    assert r[0] == pytest.approx(0.6, abs=0.12) and r[1] == pytest.approx(0.2, abs=0.1) and r[2] == pytest.approx(1.5, abs=0.05) and r[3] == pytest.approx(0.5, abs=0.05)
    sites = {s.site for s in innovations.long_draws(found, ["k"]).select("site").distinct().collect()}
    assert sites == {"phi1", "phi2", "gamma0", "beta[0]", "gamma[0]"}


def test_scalers_and_cuts(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 5.0)], "k string, x double, c double")
    got = {r["column"]: (r["loc"], r["scale"]) for r in reports.scalers(df, ["k"], ["x", "c"], population=True).collect()}
    assert got == {"x": (2.0, 1.0), "c": (5.0, 1.0)}
    v = spark.createDataFrame([(x,) for x in (-5.0, 10.0, 10.1, 45.0, 46.0)], "x double")
    assert [r[0] for r in v.select(reports.cut(F.col("x"), [-5, 10, 45], ["p", "q"])).collect()] == [None, "p", "q", "q", None]
    assert [r[0] for r in v.select(reports.cut(F.col("x"), [-5, 10, 45], ["p", "q"], right=False)).collect()] == ["p", "q", "q", None, None]
