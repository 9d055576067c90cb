import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtempo.functions import mathx


def test_normal_functions_match_the_error_function(spark):
    z = [-9.0, -7.2, -3.0, -0.5, 0.0, 0.3, 2.5, 7.5, 9.0]
    rows = spark.createDataFrame([(x,) for x in z], "z double").select("z", mathx.col(mathx.cdf("z")).alias("c"), mathx.col(mathx.pdf("z")).alias("p")).collect()
    for r in rows:
        assert r.c == pytest.approx(0.5 * math.erfc(-r.z / math.sqrt(2)), abs=1e-15)
        assert r.p == pytest.approx(math.exp(-r.z * r.z / 2) / math.sqrt(2 * math.pi), abs=1e-16)


def test_quantile_inverts_the_distribution(spark):
    p = [1e-10, 0.01, 0.2, 0.5, 0.77, 0.999, 1 - 1e-9]
    rows = spark.createDataFrame([(x,) for x in p], "p double").select("p", mathx.col(mathx.ppf("p")).alias("q")).withColumn("back", mathx.col(mathx.cdf("q"))).collect()
    assert all(r.back == pytest.approx(r.p, abs=1e-14) for r in rows)
    edge = spark.sql("SELECT 0.0D AS p UNION ALL SELECT 1.0D").select(mathx.col(mathx.ppf("p")).alias("q")).collect()
    assert [r.q for r in edge] == [None, None]


def test_interpolation_clamps_like_numpy(spark):
    xs, ys, at = [0.0, 1.0, 3.0], [10.0, 20.0, 0.0], [-1.0, 0.0, 0.5, 1.0, 2.0, 3.0, 9.0]
    df = spark.createDataFrame([(a, xs, ys) for a in at], "a double, xs array<double>, ys array<double>")
    got = [r.v for r in df.select(mathx.interpolated(F.col("a"), F.col("xs"), F.col("ys")).alias("v")).collect()]
    assert got == pytest.approx(np.interp(at, xs, ys).tolist())


def test_logsumexp_does_not_overflow(spark):
    v = spark.createDataFrame([([1000.0, 1001.0],)], "v array<double>").select(mathx.logsumexp(F.col("v")).alias("x")).first().x
    assert v == pytest.approx(1001 + math.log1p(math.exp(-1)))


@pytest.mark.parametrize(("n", "critical"), [(1, 0.975), (5, 0.56328), (10, 0.40925), (20, 0.29408), (100, 0.13403)])
def test_kolmogorov_critical_values(n, critical):
    assert mathx.kolmogorov_ppf(0.95, n) == pytest.approx(critical, abs=6e-6)
