"""Layers against a plain longest-chain search, with tiny blocks so that parts, slabs and rounds all occur; measures by hand."""

import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pytest

from gridtempo.llm import pareto


def brute_layers(points):
    """By peeling: undominated points are layer 1, and so on."""
    left, layer, out = np.unique(np.array(points), axis=0), 1, {}
    while len(left):
        below = (left[:, None] <= left[None]).all(axis=2) & (left[:, None] < left[None]).any(axis=2)
        top = ~below.any(axis=0)
        out |= {tuple(p): layer for p in left[top].tolist()}
        left, layer = left[~top], layer + 1
    return out


def some_points(seed, n, width, anti=False):
    rng = random.Random(seed)
    rows = [[rng.randrange(width) for _ in range(4)] for _ in range(n)]
    if anti:
        rows = [[a, 3 * width - a - b - c, b, c] for a, b, c, _ in rows]
    return rows


@pytest.mark.parametrize(("seed", "width", "anti"), [(1, 4, False), (2, 30, False), (3, 1000, False), (4, 30, True)])
def test_chains_equal_peeling(seed, width, anti):
    points = np.unique(np.array(some_points(seed, 600, width, anti)), axis=0)
    want = brute_layers(points)
    for most in (24, 3):
        got = pareto.chains(points, most)
        assert [min(want[tuple(p)], most + 1) for p in points.tolist()] == got.tolist()


@pytest.mark.parametrize(("seed", "width", "anti", "most", "block"), [(5, 6, False, 24, 60), (6, 40, False, 24, 50), (7, 40, True, 24, 40), (8, 9, False, 3, 40), (9, 40, False, 24, 10_000)])
def test_groups_beyond_a_block_equal_peeling(spark, seed, width, anti, most, block):
    """One group holds most rows, others few."""
    groups = {"g": some_points(seed, 500, width, anti), "t": some_points(seed + 100, 45, width, anti), "one": [[1, 1, 1, 1]]}
    rows = [(k, *p) for k, ps in groups.items() for p in {tuple(p) for p in ps}]
    table = spark.createDataFrame(rows, "s string, a long, b long, c long, d long")
    got = {tuple(r) for r in pareto.dominance_layers(table, "s", list("abcd"), most, block).collect()}
    assert got == {(k, *p, layer) for k, ps in groups.items() for p, layer in brute_layers(ps).items() if layer <= most}


DAY = dt.datetime(2024, 3, 1)
LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp"
SALES, ITEMS = "sale_id long, client_id long, sold_at timestamp", "item_id long, name string, kind string, price double"


def shop(spark, lines, sales, items):
    clash = {c: pareto.F.lit("x") for c in ("c", "d", "i", "n", "x1", "sold", "days", "layer", "__scope")}
    return [spark.createDataFrame(*t).withColumns(clash) for t in ((lines, LINES), (sales, SALES), (items, ITEMS))]


def test_measures_skip_lines_that_lack_an_input(spark):
    lines = [
        (1, 1, 7, 3, 2, 10.0, 0.05, "", DAY + dt.timedelta(days=4)),
        (1, 1, 7, 3, 2, 10.0, 0.05, "", DAY + dt.timedelta(days=4)),
        (2, 1, 7, 3, 9, None, 0.10, "", DAY),
        (None, 1, 7, 3, None, 5.0, None, "", DAY),
        (1, 2, 7, 4, 1, float("nan"), None, "", None),
        (1, 2, 8, 4, 3, 5.0, 0.0, "", DAY - dt.timedelta(days=3)),
        (1, 3, None, 4, 1, 5.0, 0.0, "", DAY),
        (1, 3, 9, 4, 1, 5.0, 0.0, "", DAY),
    ]
    got = {(r.item_id, r.vendor_id): tuple(r)[2:] for r in pareto.offers(*shop(spark, lines, [(1, 1, DAY + dt.timedelta(hours=23)), (2, 1, None), (None, 1, DAY)], [(7, "a", "k", 5.0), (8, "b", None, 0.001)])).collect()}
    assert got == {
        (7, 3): ("k", (1000 * 95 * 2) // (500 * 4), (5 + 5 + 10) // 3, 4, 9),
        (7, 4): ("k", None, None, None, 1),
        (8, 4): (None, None, 0, -3, 3),
        (9, 4): (None, None, 0, 0, 1),
    }


def test_layers_types_ties_and_nulls(spark):
    rng = random.Random(4)
    rows = [(i, i % 7, rng.choice(["a", "a", "b", None]), *[rng.choice([None, *range(4)]) for _ in range(4)]) for i in range(300)]
    offered = spark.createDataFrame(rows, "item_id long, vendor_id long, part_type string, price long, discount long, delay long, quantity long")
    vector = lambda r: tuple(math.inf if x is None else s * x for x, s in zip(r[3:7], (1, -1, 1, -1), strict=True))
    same, whole = Counter(map(vector, rows)), brute_layers([vector(r) for r in rows])
    typed = {t: brute_layers([vector(r) for r in rows if r[2] == t]) for t in ("a", "b", None)}
    want = {r[0]: (typed[r[2]][vector(r)], whole[vector(r)], same[vector(r)]) for r in rows}
    for most, block in ((24, 32_768), (2, 20)):
        got = {r.item_id: (r.type_layer, r.global_layer, r.n_equal) for r in pareto.layered(offered, most, block).collect()}
        assert got == {i: (t if t <= most else 0, g if g <= most else 0, n) for i, (t, g, n) in want.items()}


def test_empty_tables(spark):
    assert pareto.layered(pareto.offers(*shop(spark, [], [], []))).count() == 0
