"""Neighbours by cells against all pairs, with copies, hot cells and tiny tiles; the energy score by tiles of pairs."""

import brute_mcmc
import numpy as np
import pytest

from gridtempo.operators import neighbours, scores


def draws(seed, n=240):
    rng = np.random.default_rng(seed)
    out = []
    for g, dims in (("a", 3), ("b", 3), (None, 3)):
        p, q = rng.normal(size=(n, dims)), rng.normal(size=(n // 2, dims)) * 2 + 1
        p[: n // 3] = p[0]  # a third of the draws are copies, and lie in one cell
        q[: n // 6] = p[0]
        out += [(g, 0, p), (g, 1, q)]
    return out


@pytest.mark.parametrize(("count", "tile"), [(1, 2048), (9, 2048), (40, 25)])
def test_estimates_equal_all_pairs(spark, count, tile):
    told = draws(1)
    rows = [(g, s, x.tolist()) for g, s, xs in told for x in xs] + [("few", 0, [0.0, 0.0, 0.0])]
    got = {r.g: r.kl for r in neighbours.knn_kl(spark.createDataFrame(rows, "g string, s int, v array<double>"), ["g"], "s", "v", 5, count, tile).collect()}
    assert got.pop("few") is None
    assert got == {g: pytest.approx(brute_mcmc.knn_kl(told[i][2], told[i + 1][2]), rel=1e-9) for i, g in enumerate(["a", "b", None]) for i in [2 * i]}


def test_cells_out_of_reach_are_not_visited(spark):
    """Two clusters far apart: no query meets the other one's vectors."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(200, 2)), rng.normal(size=(200, 2)) + 1000])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "tid long, v array<double>").selectExpr("tid", "'g' AS g", "0 AS side", "v")
    visited = []
    whole = neighbours._met
    try:
        neighbours._met = lambda queries, *rest: (visited.append(queries), whole(queries, *rest))[1]
        got = neighbours.neighbour_distances(rows.withColumnRenamed("tid", "qid"), rows, 3, x[[0, 399]]).collect()
    finally:
        neighbours._met = whole
    want = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), axis=1)[:, 2]
    assert [r.distance for r in sorted(got)] == pytest.approx(want.tolist())
    assert [v.count() for v in visited] == [400, 0]


def test_energy_by_tiles_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 5)) * 1e-3 + 50
    x[:50] = x[0]
    y = x[7] + 1
    rows = [(g, v.tolist(), y.tolist()) for g, n in (("a", 150), (None, 1)) for v in x[:n]]
    df = spark.createDataFrame(rows, "g string, path array<double>, y array<double>")
    for block in (2048, 20):
        got = {r.g: r.energy_score for r in scores.energy_score(df, ["g"], "path", "y", block).collect()}
        pairs = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)).mean()
        assert got == {"a": pytest.approx(np.sqrt(((x - y) ** 2).sum(1)).mean() - pairs / 2, rel=1e-11), None: pytest.approx(np.linalg.norm(x[0] - y), rel=1e-11)}
