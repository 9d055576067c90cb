"""The structural model: a regression whose errors follow an AR(2) with a log-linear innovation scale.

Fits run as numerical code, one series a task; what follows from the draws (residuals at origins, moments, paths, variance split) is over rows of
draws, so that draws and origins spread over tasks. Draws are rows (keys, draw, phi1, phi2, gamma0, beta array, gamma array).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import advi, impulse_response, nuts

LOG_SIGMA = (-8.0, 3.0)


def coefficients(phi1: Column, phi2: Column) -> tuple[Column, Column]:
    """Partial autocorrelations to AR(2) coefficients; stationary whenever both lie inside (-1, 1)."""
    return phi1 * (1 - phi2), phi2


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def weights(rho1: Column, rho2: Column, horizon: int) -> Column:
    """The impulse response as an array: 1, rho1, then the recursion."""
    return F.aggregate(F.sequence(F.lit(2), F.lit(horizon - 1)), F.array(F.lit(1.0), rho1.cast("double")), lambda a, _: F.concat(a, F.array(rho1 * F.element_at(a, -1) + rho2 * F.element_at(a, -2)))) if horizon > 2 else F.slice(F.array(F.lit(1.0), rho1.cast("double")), 1, horizon)


def carried(rho1: Column, rho2: Column, last: Column, before: Column, horizon: int) -> Column:
    """Expected errors ahead from the last two, as an array."""
    start = F.array(before.cast("double"), last.cast("double"))
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, lambda a, _: F.concat(a, F.array(rho1 * F.element_at(a, -1) + rho2 * F.element_at(a, -2))))
    return F.slice(grown, 3, horizon)


def carried_by(phi: Column, last: Column, order: int, horizon: int) -> Column:
    """Values ahead of an autoregression of any order as an array; ``last``: the most recent ``order`` values, oldest first."""
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), last, lambda a, _: F.concat(a, F.array(dot(phi, F.reverse(F.slice(a, -order, order))))))
    return F.slice(grown, order + 1, horizon)


def origin_residuals(draws: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, origin, draw, e1, e2): residuals one and two steps before each origin.

    ``rows``: (keys, origin, y1, x1, y2, x2), the outcomes and designs of those two steps. Each origin meets every draw of its series.
    """
    both = rows.join(draws, keys)
    return both.select(*keys, "origin", "draw", (F.col("y1") - dot(F.col("x1"), F.col("beta"))).alias("e1"), (F.col("y2") - dot(F.col("x2"), F.col("beta"))).alias("e2"))


def horizon_moments(draws: DataFrame, residuals: DataFrame, design: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """Rows (keys, origin, draw, step, mean, variance), without simulation.

    ``design``: one row for each origin with arrays over steps, xs (array of x arrays) and zs. The mean is the regression plus the carried
    errors; the variance at a step sums squared weights times the scales up to it.
    """
    rho1, rho2 = coefficients(F.col("phi1"), F.col("phi2"))
    rows = residuals.join(draws, [*keys, "draw"]).join(design, [*keys, "origin"])
    rows = rows.withColumns({"carry": carried(rho1, rho2, F.col("e1"), F.col("e2"), horizon), "psi": weights(rho1, rho2, horizon)})
    scale = F.transform("zs", lambda z: F.exp(2 * F.least(F.greatest(F.col("gamma0") + dot(z, F.col("gamma")), F.lit(LOG_SIGMA[0])), F.lit(LOG_SIGMA[1]))))
    rows = rows.withColumns({"s2": scale, "reg": F.transform("xs", lambda x: dot(x, F.col("beta")))})
    each = rows.select(*keys, "origin", "draw", "carry", "psi", "s2", "reg", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("step"))
    upto = F.slice("s2", F.lit(1), F.col("step") + 1)
    back = F.reverse(F.slice("psi", F.lit(1), F.col("step") + 1))
    variance = F.aggregate(F.zip_with(back, upto, lambda p, s: p * p * s), F.lit(0.0), lambda a, x: a + x)
    return each.select(*keys, "origin", "draw", "step", (F.get("reg", F.col("step")) + F.get("carry", F.col("step"))).alias("mean"), variance.alias("variance"))


def horizon_paths(draws: DataFrame, residuals: DataFrame, design: DataFrame, keys: list[str], horizon: int, seed: int) -> DataFrame:
    """Rows (keys, origin, draw, path): one simulated path for each draw, seeded by its content, not by its task."""
    rows = residuals.join(draws, [*keys, "draw"]).join(design, [*keys, "origin"])
    rows = rows.withColumn("__seed", F.pmod(F.xxhash64(*keys, "origin", "draw", F.lit(seed)), F.lit(1 << 62)))
    kept = [*keys, "origin", "draw"]

    def run(batches):
        for pdf in batches:
            paths = []
            for r in pdf.itertuples(index=False):
                rho = np.array([r.phi1 * (1 - r.phi2), r.phi2])
                psi = impulse_response(rho, horizon)
                x, z = np.stack(r.xs).astype(float), np.stack(r.zs).astype(float)
                sigma = np.exp(np.clip(r.gamma0 + z @ np.asarray(r.gamma), *LOG_SIGMA))
                shocks = sigma * np.random.default_rng(r.seed).standard_normal(horizon)
                past, carry = [r.e1, r.e2], []
                for _ in range(horizon):
                    carry.append(rho[0] * past[0] + rho[1] * past[1])
                    past = [carry[-1], past[0]]
                noise = np.array([psi[: h + 1][::-1] @ shocks[: h + 1] for h in range(horizon)])
                paths.append((x @ np.asarray(r.beta) + carry + noise).tolist())
            yield pdf[kept].assign(path=paths)

    chosen = rows.select(*kept, "e1", "e2", "phi1", "phi2", "gamma0", "beta", "gamma", "xs", "zs", F.col("__seed").alias("seed"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema if f.name in kept)
    return chosen.mapInPandas(run, f"{schema}, path array<double>")


class Target:
    """Log density and gradient over (logit phi1, logit of (phi2+1)/2, beta, gamma0, gamma): phi1 ~ Beta(8, 2), phi2 ~ U(-1, 1), normal rest.

    Rows are on a strict grid. A row with a missing value takes no part, nor do the innovations of the two rows after it, so that no lag spans a gap.
    """

    def __init__(self, y: np.ndarray, x: np.ndarray, z: np.ndarray, prior: float = 2.0):
        seen = np.isfinite(y) & np.isfinite(x).all(axis=1) & np.isfinite(z).all(axis=1)
        self.y, self.x, self.z, self.prior = np.where(seen, y, 0.0), np.where(seen[:, None], x, 0.0), np.where(seen[:, None], z, 0.0), prior
        self.whole, self.start = (seen[2:] & seen[1:-1] & seen[:-2]).astype(float), seen[:2].astype(float)
        self.size = 3 + x.shape[1] + z.shape[1]

    def split(self, t: np.ndarray):
        p = self.x.shape[1]
        a, b = 1 / (1 + math.exp(-np.clip(t[0], -30, 30))), 2 / (1 + math.exp(-np.clip(t[1], -30, 30))) - 1
        return a, b, t[2 : 2 + p], t[2 + p], t[3 + p :]

    def __call__(self, t: np.ndarray) -> tuple[float, np.ndarray]:
        phi1, phi2, beta, g0, gamma = self.split(t)
        r1, r2 = phi1 * (1 - phi2), phi2
        e = self.y - self.x @ beta
        u = e[2:] - r1 * e[1:-1] - r2 * e[:-2]
        raw = g0 + self.z[2:] @ gamma
        ls = np.clip(raw, *LOG_SIGMA)
        inv = np.exp(-2 * ls) * self.whole
        w = u * inv
        free = (raw > LOG_SIGMA[0]) & (raw < LOG_SIGMA[1])
        value = -0.5 * (u * w).sum() - (ls * self.whole).sum() - 0.5 * (self.start * e[:2] ** 2).sum()
        dls = (u * w - self.whole) * free
        de = np.zeros(len(e))
        de[2:] -= w
        de[1:-1] += r1 * w
        de[:-2] += r2 * w
        de[:2] -= self.start * e[:2]
        d1, d2 = (w * e[1:-1]).sum(), (w * e[:-2]).sum()
        dphi1, dphi2 = d1 * (1 - phi2), d2 - d1 * phi1
        # priors and the Jacobians of both transforms
        value += 8 * math.log(phi1) + 2 * math.log1p(-phi1) + math.log1p(phi2) + math.log1p(-phi2)
        rest = t[2:]
        value -= 0.5 * rest @ rest / self.prior**2
        grad = np.concatenate([[dphi1 * phi1 * (1 - phi1) + 8 * (1 - phi1) - 2 * phi1, dphi2 * (1 - phi2**2) / 2 - phi2], -self.x.T @ de, [dls.sum()], self.z[2:].T @ dls])
        grad[2:] -= rest / self.prior**2
        return float(value), grad


def fit(rows: DataFrame, keys: list[str], y: str, x: list[str], z: list[str], draws: int = 200, chains: int = 0, warmup: int = 150, steps: int = 500, seed: int = 1, ts: str = "ts") -> DataFrame:
    """Rows (keys, chain, draw, phi1, phi2, gamma0, beta, gamma): of a full-rank normal approximation, or of NUTS chains started and scaled by it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        target = Target(pdf[y].to_numpy(float), pdf[x].to_numpy(float), pdf[z].to_numpy(float))
        m, low, _ = advi(target, target.size, steps=steps, seed=seed)
        rng = np.random.default_rng(seed)
        found = []
        if chains:
            for c in range(chains):
                sample, _ = nuts(target, m + low @ rng.standard_normal(target.size), draws, warmup, seed + c, low)
                found += [(c, d, t) for d, t in enumerate(sample)]
        else:
            found = [(0, d, m + low @ rng.standard_normal(target.size)) for d in range(draws)]
        out = []
        for c, d, t in found:
            a, b, beta, g0, gamma = target.split(t)
            out.append([*pdf[keys].iloc[0], c, d, a, b, float(g0), beta.tolist(), gamma.tolist()])
        return pd.DataFrame(out, columns=[*keys, "chain", "draw", "phi1", "phi2", "gamma0", "beta", "gamma"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    return rows.select(*dict.fromkeys([*keys, ts, y, *x, *z])).groupBy(*keys).applyInPandas(run, f"{schema}, chain int, draw int, phi1 double, phi2 double, gamma0 double, beta array<double>, gamma array<double>")


def long_draws(draws: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, chain, draw, site, value), vector sites as name[k]."""
    sites = [F.struct(F.lit(s).alias("site"), F.col(s).alias("value")) for s in ("phi1", "phi2", "gamma0")]

    def elements(name: str) -> Column:
        return F.transform(F.col(name), lambda v, k: F.struct(F.concat(F.lit(f"{name}["), k.cast("string"), F.lit("]")).alias("site"), v.alias("value")))

    vectors = [elements("beta"), elements("gamma")]
    return draws.select(*keys, "chain", "draw", F.explode(F.concat(F.array(*sites), *vectors)).alias("s")).select(*keys, "chain", "draw", "s.site", "s.value")


def scale_by_hour(draws: DataFrame, rows: DataFrame, keys: list[str], z: list[str], hour: Column, y_scale: float = 1.0) -> DataFrame:
    """The innovation scale by hour: mean over draws and rows of exp(gamma0 + z gamma)."""
    compact = rows.groupBy(*keys, hour.alias("hour"), F.array(*z).alias("zv")).agg(F.count("*").alias("n"))
    both = compact.join(draws.select(*keys, "gamma0", "gamma"), keys)
    s = F.exp(F.least(F.greatest(F.col("gamma0") + dot(F.col("zv"), F.col("gamma")), F.lit(LOG_SIGMA[0])), F.lit(LOG_SIGMA[1])))
    return both.groupBy(*keys, "hour").agg((F.sum(s * F.col("n")) / F.sum("n") * y_scale).alias("scale"))
