"""Resamples by seeded counts against resamples drawn with replacement."""

import numpy as np
import pytest

from gridtempo.operators import scores


def test_intervals_agree_with_drawing_with_replacement(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(0.2, 1, 180), "b": rng.normal(-0.05, 1, 150), None: rng.normal(0, 3, 120)}
    rows = [(g, i, float(x), 0.0) for g, d in groups.items() for i, x in enumerate(d)] + [("a", 999, None, 1.0)]
    df = spark.createDataFrame(rows, "g string, o int, x double, y double")
    got = {r.g: r for r in scores.paired_bootstrap(df.repartition(5), ["g"], "o", "x", "y", 4000).collect()}
    assert set(got) == set(groups)
    for g, d in groups.items():
        means = d[rng.integers(0, len(d), (4000, len(d)))].mean(axis=1)
        sd = means.std()
        assert got[g].difference == pytest.approx(d.mean())
        assert [got[g].low, got[g].high] == pytest.approx(np.quantile(means, [0.025, 0.975]).tolist(), abs=0.2 * sd)
        assert got[g].p_value == pytest.approx(min(1, 2 * min((means > 0).mean(), (means < 0).mean())), abs=0.05)
    again = {r.g: r for r in scores.paired_bootstrap(df.repartition(2), ["g"], "o", "x", "y", 4000).collect()}
    assert all([again[g].low, again[g].high] == pytest.approx([r.low, r.high], rel=1e-12) for g, r in got.items())


def test_groups_of_the_same_numbers_get_draws_of_their_own(spark):
    d = np.random.default_rng(2).normal(size=60)
    df = spark.createDataFrame([(g, i, float(x), 0.0) for g in "ab" for i, x in enumerate(d)], "g string, o int, x double, y double")
    one, two = scores.paired_bootstrap(df, ["g"], "o", "x", "y", 500).collect()
    assert one.difference == pytest.approx(two.difference) and one.low != two.low
    assert scores.paired_bootstrap(df.limit(0), ["g"], "o", "x", "y", 10).count() == 0
