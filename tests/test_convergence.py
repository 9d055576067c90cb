"""R-hat and effective sizes over spread chains, against chains held whole."""

import math

import brute_mcmc
import numpy as np
import pytest

from gridtempo.operators import convergence


def chains(kind, n, m=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(m, n))
    if kind == "sticky":
        for t in range(1, n):
            x[:, t] = 0.95 * x[:, t - 1] + x[:, t]
    if kind == "apart":
        x += np.arange(m)[:, None]
    if kind == "tied":
        x = np.round(x)
    if kind == "trend":
        x += np.linspace(0, 8, n)
    if kind == "same":
        x[:] = 1.0
    return x


KINDS = [("good", 400), ("sticky", 301), ("apart", 101), ("tied", 64), ("trend", 150), ("good", 5), ("same", 40)]


@pytest.mark.parametrize("block", [8, 4096])
def test_equals_whole_chains(spark, block):
    """Blocks of 8 draws: many tasks for a chain, and several rounds for those that stay correlated."""
    rows = []
    for s, (kind, n) in enumerate(KINDS):
        rows += [(f"{kind}{s}", s, c, 10 * t, float(v)) for c, chain in enumerate(chains(kind, n, seed=s)) for t, v in enumerate(chain)]
    got = convergence.mcmc_summary(spark.createDataFrame(rows, "name string, k int, c int, d long, x double").repartition(3), ["name", "k"], "c", "d", "x", block).collect()
    assert len(got) == len(KINDS)
    for r in got:
        want = brute_mcmc.summary(chains(*KINDS[r.k], seed=r.k))
        assert [r.r_hat, r.ess_bulk, r.ess_tail] == pytest.approx(want, rel=1e-7, nan_ok=True), r.name
    order = [-math.inf if math.isnan(r.r_hat) else r.r_hat for r in got]
    assert order == sorted(order, reverse=True)


def test_draws_that_a_chain_lacks_are_left_out(spark):
    x = chains("good", 60)
    rows = [("s", c, t, float(v)) for c, chain in enumerate(x) for t, v in enumerate(chain) if (c, t) not in {(0, 3), (1, 59)}]
    rows += [("s", 0, 3, None), ("s", 1, 59, float("nan")), ("few", 0, 0, 1.0), ("few", 0, 1, 2.0), ("bare", 0, 0, None)]
    got = {r.s: r for r in convergence.mcmc_summary(spark.createDataFrame(rows, "s string, c int, d int, x double"), ["s"], "c", "d", "x", 16).collect()}
    want = brute_mcmc.summary(np.delete(x, [3, 59], axis=1))
    assert [got["s"].r_hat, got["s"].ess_bulk, got["s"].ess_tail] == pytest.approx(want, rel=1e-7)
    assert all(math.isnan(v) for n in ("few", "bare") for v in tuple(got[n])[1:])


def test_no_rows(spark):
    assert convergence.mcmc_summary(spark.createDataFrame([], "s string, c int, d int, x double"), ["s"], "c", "d", "x").count() == 0


def test_a_block_of_draws_is_one_row(spark, monkeypatch):
    """Blocks are what rounds of lags send: four chains of two halves of 320 draws in blocks of 16."""
    draws = [("s", c, t, float(v)) for c, chain in enumerate(chains("good", 640)) for t, v in enumerate(chain)]
    seen, whole = [], convergence._packed
    monkeypatch.setattr(convergence, "_packed", lambda rows, block: (kept := whole(rows, block), seen.append(kept))[0])
    convergence.mcmc_summary(spark.createDataFrame(draws, "s string, c int, d int, x double"), ["s"], "c", "d", "x", 16).collect()
    assert seen[0].count() == 4 * 2 * 20
