"""Centroid clustering held against a plain k-means in Python integers, and the defined results."""

import hashlib
import math
import random

import numpy as np
import pytest

from gridtempo.llm import centroids


def brute(rows, k, dims, rounds, scale=64):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [list(v) for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        where = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            own = [v for (_, v), w in zip(kept, where, strict=True) if w == j]
            if own:
                cents[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted((str(i), near(v)[1], near(v)[0]) for i, v in kept), cents


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_with_hot_copies_and_broken_rows(spark, seed):
    rng = random.Random(seed)
    one = [float(np.float32(rng.gauss(0, 1))) for _ in range(6)]
    rows = [(i, one if i % 3 == 0 else [float(np.float32(rng.gauss(0, 1) * (1 + d))) for d in range(6)]) for i in range(200)]
    rows += [(300, None), (301, [1.0] * 5), (302, [1.0] * 5 + [None]), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (305, []), (None, [0.5] * 6), rows[1], rows[1]]
    found, cents = centroids.cluster(table(spark, rows), k=5, dims=6)
    want, want_cents = brute(rows, 5, 6, 3)
    assert sorted((str(r.id), r.cluster, r.distance) for r in found.collect()) == want
    assert cents.tolist() == want_cents
    told = centroids.report(found, cents).collect()
    assert {r.inertia for r in told} == {sum(w[2] for w in want)}
    for r in told:
        assert r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, want_cents[r.cluster])).encode()).hexdigest()


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    found, cents = centroids.cluster(table(spark, [(i, [0.25, 0.5]) for i in range(9)]), k=4, dims=2)
    assert {(r.cluster, r.distance) for r in found.collect()} == {(0, 0)} and cents.tolist() == [[16, 32]] * 4


def test_few_none_and_clashing_columns(spark):
    rows = table(spark, [(1, [0.1, 0.2]), (2, [3.0, 4.0])]).selectExpr("*", "'x' AS id", "'x' AS v", "'x' AS cluster", "'x' AS h")
    assert sorted((r.id, r.distance) for r in centroids.cluster(rows, k=16, dims=2)[0].collect()) == [(1, 0), (2, 0)]
    assert centroids.report(*centroids.cluster(rows.limit(0), dims=2)).count() == 0
    big = centroids.cluster(table(spark, [(1, [3e38, -3e38]), (2, [0.0, 0.0])]), k=1, dims=2)[0].collect()
    assert all(r.distance < 2**63 for r in big)


def test_partial_sums_never_change_the_result():
    rng = np.random.default_rng(3)
    x, c = rng.integers(-50, 50, (500, 64)), rng.integers(-50, 50, (16, 64))
    order = np.argsort(-x.var(axis=0))
    where, best = centroids.assign(x, c, order)
    full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (where == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
