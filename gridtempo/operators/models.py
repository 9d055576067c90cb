"""Forecasters: seasonal naive, AR(2) innovations, perturbed weather, boosted quantiles, VI and NUTS.

Fits are numerical code over one series each (``applyInPandas``), so that many series fit in parallel; forecasts are joins and expressions.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .features import half_hour_of_day, half_hour_of_week
from .timegrid import order


def seasonal_naive(series: DataFrame, keys: list[str], value: str, season: int = 336, ts: str = "ts") -> DataFrame:
    """Last season's value, and the spread of its errors by half hour of the week, of a series on a strict grid."""
    rows = series.withColumn("mean", F.lag(value, season).over(order(keys, ts))).withColumn("how", half_hour_of_week(F.col(ts)))
    errors = rows.groupBy(*keys, "how").agg(F.stddev_samp(F.col(value) - F.col("mean")).alias("sd"))
    return rows.join(errors, [*keys, "how"], "left").select(*keys, ts, value, "mean", "sd")


def autocorrelation(series: DataFrame, keys: list[str], value: str, lags: list[int], ts: str = "ts") -> DataFrame:
    """Correlation of a series with itself so many rows before; negative lags look ahead."""
    rows = series.withColumns({f"__{k}": F.lag(value, k).over(order(keys, ts)) if k >= 0 else F.lead(value, -k).over(order(keys, ts)) for k in lags})
    wide = rows.groupBy(*keys).agg(*[F.corr(F.when(F.col(f"__{k}").isNotNull(), F.col(value)), f"__{k}").alias(f"c{k}") for k in lags])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"c{k}").alias("r")) for k in lags])).alias("e")
    return wide.select(*keys, each).select(*keys, "e.lag", "e.r")


def cross_correlation(rows: DataFrame, keys: list[str], x: str, y: str, lags: list[int], ts: str = "ts") -> DataFrame:
    """Correlation of x with y so many rows before; null pairs drop out."""
    w = order(keys, ts)
    shifted = rows.withColumns({f"__{i}": F.lag(y, k).over(w) if k >= 0 else F.lead(y, -k).over(w) for i, k in enumerate(lags)})
    wide = shifted.groupBy(*keys).agg(*[F.corr(F.when(F.col(f"__{i}").isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(f"__{i}"))).alias(f"c{i}") for i in range(len(lags))])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"c{i}").alias("r")) for i, k in enumerate(lags)])).alias("e")
    return wide.select(*keys, each).select(*keys, "e.lag", "e.r")


def perturbation_fit(pairs: DataFrame, keys: list[str], actual: str, forecast: str, steps: int = 48, ts: str = "ts", genuine_only: bool = True) -> DataFrame:
    """AR(1) error model of a weather forecast: rho, and for each step of the day a spread smoothed over five steps.

    Rows whose forecast merely repeats the actual are left out unless asked for.
    """
    rows = pairs.filter(F.col(actual).isNotNull() & F.col(forecast).isNotNull())
    if genuine_only:
        rows = rows.filter(F.col(actual) != F.col(forecast))
    rows = rows.withColumn("e", F.col(forecast) - F.col(actual)).withColumn("before", F.lag("e").over(order(keys, ts)))
    rho = rows.groupBy(*keys).agg(F.corr(F.when(F.col("before").isNotNull(), F.col("e")), "before").alias("rho"))
    spread = rows.groupBy(*keys, half_hour_of_day(F.col(ts)).alias("step")).agg(F.stddev_samp("e").alias("s"))
    every = rho.select(*keys, "rho", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step")).join(spread, [*keys, "step"], "left")
    w, back = Window.partitionBy(*keys).orderBy("step"), Window.partitionBy(*keys).orderBy(F.desc("step"))
    up_to_here = (Window.unboundedPreceding, 0)
    filled = F.coalesce(F.last("s", ignorenulls=True).over(w.rowsBetween(*up_to_here)), F.last("s", ignorenulls=True).over(back.rowsBetween(*up_to_here)))
    return every.withColumn("__f", filled).withColumn("sigma", F.avg("__f").over(w.rowsBetween(-2, 2))).select(*keys, "step", "rho", "sigma")


def content_rng(seed: int, *parts) -> np.random.Generator:
    """A generator that depends on the seed and on what it is for, not on task or order."""
    return np.random.default_rng(int.from_bytes(hashlib.blake2b("\x1f".join(str(x) for x in (seed, *parts)).encode(), digest_size=16).digest()))


def perturbation_sample(model: DataFrame, keys: list[str], draws: int, seed: int, name: str = "") -> DataFrame:
    """Rows (keys, draw, error array): e0 = s0 z0, e_i = rho e_{i-1} + s_i sqrt(1 - rho^2) z_i; each key and ``name`` has draws of its own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        rho, sigma = float(pdf["rho"].iloc[0]), pdf["sigma"].to_numpy(dtype=float)
        z = content_rng(seed, name, *pdf[keys].iloc[0]).standard_normal((draws, len(sigma)))
        e = np.empty_like(z)
        e[:, 0] = sigma[0] * z[:, 0]
        for i in range(1, len(sigma)):
            e[:, i] = rho * e[:, i - 1] + sigma[i] * math.sqrt(max(0.0, 1 - rho * rho)) * z[:, i]
        out = pd.DataFrame({"draw": range(draws), "error": list(e)})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in model.schema if f.name in keys)
    return model.groupBy(*keys).applyInPandas(run, f"{schema}, draw int, error array<double>")


def impulse_response(phi: np.ndarray, horizon: int) -> np.ndarray:
    psi = np.zeros(horizon)
    psi[0] = 1.0
    for h in range(1, horizon):
        psi[h] = sum(phi[k] * psi[h - 1 - k] for k in range(min(len(phi), h)))
    return psi


def carry(phi: np.ndarray, last: np.ndarray, horizon: int) -> np.ndarray:
    """The expected errors ahead, from the last ones (most recent first)."""
    past, out = list(last), []
    for _ in range(horizon):
        e = float(sum(f * v for f, v in zip(phi, past, strict=False)))
        past.insert(0, e)
        out.append(e)
    return np.array(out)


def ar_paths(model: DataFrame, keys: list[str], horizon: int, draws: int, seed: int, mean: Column | None = None) -> DataFrame:
    """Rows (keys, draw, path): simulated errors ahead, of innovations phi and sigma; each series has draws of its own."""

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                psi = impulse_response(np.asarray(row.phi), horizon)
                eps = content_rng(seed, *(getattr(row, k) for k in keys)).standard_normal((draws, horizon)) * row.sigma
                weights = np.array([[psi[h - j] if h >= j else 0.0 for j in range(horizon)] for h in range(horizon)])
                out = pd.DataFrame({"draw": range(draws), "path": list(eps @ weights.T)})
                for k in reversed(keys):
                    out.insert(0, k, getattr(row, k))
                yield out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in model.schema if f.name in keys)
    return model.select(*keys, "phi", "sigma").mapInPandas(run, f"{schema}, draw int, path array<double>")


# Settings of the boosted heads, and the levels of the quantile ones.
TREES, RATE, LEAVES, LEAST, SHARE, PATIENCE = 2000, 0.04, 63, 40, 0.9, 50
LEVELS = (0.025, 0.05, 0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 0.95, 0.975)


def head_loss(y: np.ndarray, f: np.ndarray, level: float | None) -> float:
    """Mean pinball loss, or squared loss without a level."""
    r = y - f
    return float(np.mean(r * r) if level is None else np.mean(np.maximum(level * r, (level - 1) * r)))


def _best_split(coded: np.ndarray, sizes: list[int], at: np.ndarray, g: np.ndarray, columns: np.ndarray, least: int) -> tuple[float, tuple[int, int] | None]:
    """The (column, bin) that gains most in squared gradients, with at least ``least`` rows on either side."""
    best, split = 1e-12, None
    total, size = g[at].sum(), len(at)
    for j in columns if size >= 2 * least else ():
        n = np.bincount(coded[at, j], minlength=sizes[j] + 1).cumsum()[:-1]
        s = np.bincount(coded[at, j], weights=g[at], minlength=sizes[j] + 1).cumsum()[:-1]
        ok = (n >= least) & (size - n >= least)
        gain = np.where(ok, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(size - n, 1) - total**2 / size, -np.inf)
        if len(gain) and gain.max() > best:
            best, split = float(gain.max()), (int(j), int(gain.argmax()))
    return best, split


def boosted_quantiles(x: np.ndarray, y: np.ndarray, level: float | None, trees: int = TREES, rate: float = RATE, leaves: int = LEAVES, bins: int = 32, least: int = LEAST, share: float = SHARE, patience: int = PATIENCE, held: tuple[np.ndarray, np.ndarray] | None = None, seed: int = 0) -> tuple[float, list]:
    """Histogram gradient boosting for the pinball loss (squared loss if ``level`` is None): base value and trees of (feature, cut, ...).

    Trees grow best leaf first, each on a ``share`` of rows and of columns drawn anew. With ``held`` rows, boosting ends once their loss hasn't
    improved for ``patience`` trees, and the trees after the best are left out; without, all ``trees`` are grown.
    """
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    coded, sizes = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1), [len(c) for c in cuts]
    base = float(np.mean(y) if level is None else np.quantile(y, level))
    f, forest = np.full(len(y), base), []
    ahead, best, kept = None if held is None else np.full(len(held[1]), base), math.inf, 0

    def grown(rows: np.ndarray, g: np.ndarray, columns: np.ndarray):
        nodes: list[list] = [[rows, None]]
        queue: list[tuple] = []

        def offer(k: int) -> None:
            gain, split = _best_split(coded, sizes, nodes[k][0], g, columns, least)
            if split is not None:
                heapq.heappush(queue, (-gain, k, split))

        offer(0)
        for _ in range(leaves - 1):
            if not queue:
                break
            _, k, (j, c) = heapq.heappop(queue)
            at = nodes[k][0]
            go = coded[at, j] <= c
            nodes[k][1] = (j, float(cuts[j][c]), len(nodes), len(nodes) + 1)
            nodes.extend([[at[go], None], [at[~go], None]])
            offer(len(nodes) - 2)
            offer(len(nodes) - 1)

        def tree(k: int):
            at, split = nodes[k]
            if split is None:
                r = y[at] - f[at]
                return float(np.mean(r) if level is None else np.quantile(r, level))
            return split[0], split[1], tree(split[2]), tree(split[3])

        return tree(0)

    for _ in range(trees):
        g = (y - f) if level is None else np.where(y > f, level, level - 1.0)
        rows = np.sort(rng.choice(len(y), max(1, round(share * len(y))), replace=False))
        columns = np.sort(rng.choice(x.shape[1], max(1, round(share * x.shape[1])), replace=False))
        forest.append(grown(rows, g, columns))
        f = f + rate * tree_values(forest[-1], x)
        if held is not None:
            ahead = ahead + rate * tree_values(forest[-1], held[0])
            loss = head_loss(held[1], ahead, level)
            if loss < best:
                best, kept = loss, len(forest)
            elif len(forest) - kept >= patience:
                break
    return base, forest if held is None else forest[:kept]


def tree_values(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, cut, left, right = tree
    go = x[:, j] <= cut
    out = np.empty(len(x))
    out[go], out[~go] = tree_values(left, x[go]), tree_values(right, x[~go])
    return out


def quantile_boost(rows: DataFrame, keys: list[str], y: str, features: list[str], levels: list[float], train: str, held: str | None = None, mean: bool = False, **how) -> DataFrame:
    """Rows (keys, row, y, level, value) for the rows neither trained on nor held for early stopping; with ``mean`` also a squared-loss head's ``mean``.

    Each (series, head) is a task. Heads that cross are sorted.
    """
    levels_ = [F.lit(q).cast("double") for q in levels] + ([F.lit(None).cast("double")] if mean else [])
    heads = rows.withColumn("level", F.explode(F.array(*levels_)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        level = pdf["level"].iloc[0]
        kept = pdf[held].astype(bool) if held else pd.Series(False, index=pdf.index)
        fit, stop, rest = pdf[pdf[train] & ~kept], pdf[kept], pdf[~pdf[train] & ~kept].copy()
        numbers = lambda d: (d[features].to_numpy(dtype=float), d[y].to_numpy(dtype=float))
        base, forest = boosted_quantiles(*numbers(fit), None if pd.isna(level) else float(level), held=numbers(stop) if len(stop) else None, **how)
        x = rest[features].to_numpy(dtype=float)
        rest["value"] = base + how.get("rate", RATE) * sum((tree_values(t, x) for t in forest), np.zeros(len(x)))
        return rest[[*keys, "row", y, "level", "value"]]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in [*keys])
    kind = rows.schema[y].dataType.simpleString()
    out = heads.groupBy(*keys, "level").applyInPandas(run, f"{schema}, row long, {y} {kind}, level double, value double")
    known = F.col("level").isNotNull()
    sets = out.groupBy(*keys, "row", y).agg(F.array_sort(F.collect_list("level")).alias("ls"), F.array_sort(F.collect_list(F.when(known, F.col("value")))).alias("vs"), F.max(F.when(~known, F.col("value"))).alias("mean"))
    return sets.select(*keys, "row", y, F.explode(F.arrays_zip("ls", "vs")).alias("q"), "mean").select(*keys, "row", y, F.col("q.ls").alias("level"), F.col("q.vs").alias("value"), *(["mean"] if mean else []))


def log_density_at_means(found: DataFrame, rows: DataFrame, keys: list[str], y: str, features: list[str]) -> DataFrame:
    """Rows (keys, chain, log_density): a regression's joint log density at the means of each chain's draws (keys, chain, draw, site, value).

    Chains that agree on a mode have like values. ``rows`` are those that were fitted on.
    """
    sites = [*[f"beta_{k}" for k in range(len(features) + 1)], "log_sigma"]
    means = found.groupBy(*keys, "chain", "site").agg(F.avg("value").alias("m"))
    means = means.groupBy(*keys, "chain").agg(F.map_from_entries(F.collect_list(F.struct("site", "m"))).alias("at"))
    points = means.groupBy(*keys).agg(F.collect_list(F.struct("chain", F.array(*[F.col("at")[s] for s in sites]).alias("t"))).alias("points"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=[*keys, "chain", "log_density"])
        target = regression_target(left, y, features)
        out = pd.DataFrame([(p["chain"], target(np.asarray(p["t"], dtype=float))[0]) for p in right["points"].iloc[0]], columns=["chain", "log_density"])
        for k in reversed(keys):
            out.insert(0, k, left[k].iloc[0])
        return out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    return rows.select(*keys, y, *features).groupBy(*keys).cogroup(points.groupBy(*keys)).applyInPandas(run, f"{schema}, chain int, log_density double")


class LinearGaussian:
    """log density of (beta, log sigma) given rows, with normal priors, and its gradient: what VI and NUTS below sample."""

    def __init__(self, x: np.ndarray, y: np.ndarray, prior: float = 10.0):
        self.x, self.y, self.prior = x, y, prior
        self.size = x.shape[1] + 1

    def __call__(self, t: np.ndarray) -> tuple[float, np.ndarray]:
        beta, log_s = t[:-1], float(np.clip(t[-1], -8, 8))
        r = self.y - self.x @ beta
        inv = math.exp(-2 * log_s)
        value = -0.5 * inv * r @ r - len(r) * log_s - 0.5 * t @ t / self.prior**2
        grad = np.append(inv * self.x.T @ r, inv * r @ r - len(r)) - t / self.prior**2
        return float(value), grad


def advi(target, size: int, steps: int = 600, particles: int = 8, rate: float = 0.05, seed: int = 0) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Full-rank Gaussian approximation by reparameterised gradients and Adam: mean, Cholesky factor, trace of the bound."""
    rng = np.random.default_rng(seed)
    m, low = np.zeros(size), 0.1 * np.eye(size)
    moment = [np.zeros(size), np.zeros(size), np.zeros((size, size)), np.zeros((size, size))]
    trace = []
    for t in range(1, steps + 1):
        z = rng.standard_normal((particles, size))
        gm, gl, bound = np.zeros(size), np.zeros((size, size)), 0.0
        for e in z:
            v, g = target(m + low @ e)
            gm, gl, bound = gm + g / particles, gl + np.outer(g, e) / particles, bound + v / particles
        diagonal = np.diag(low)
        trace.append(bound + np.log(np.abs(diagonal)).sum() + 0.5 * size * (1 + math.log(2 * math.pi)))
        gl = np.tril(gl) + np.diag(1 / diagonal)
        norm = math.sqrt((gm**2).sum() + (gl**2).sum())
        gm, gl = gm / max(1.0, norm), gl / max(1.0, norm)
        step = rate * 0.5 ** (4 * t / steps)
        for k, (g, value) in enumerate(((gm, m), (gl, low))):
            a, b = moment[2 * k], moment[2 * k + 1]
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            value += step * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        low[np.diag_indices(size)] = np.maximum(np.abs(np.diag(low)), 1e-6)
    return m, low, trace


def nuts(target, start: np.ndarray, draws: int, warmup: int, seed: int, scale: np.ndarray | None = None, max_depth: int = 8) -> tuple[np.ndarray, pd.DataFrame]:
    """The no-U-turn sampler with dual averaging of the step; ``scale`` is a Cholesky factor of the posterior's covariance (a warm start)."""
    rng, n = np.random.default_rng(seed), len(start)
    scale = np.eye(n) if scale is None else scale

    def density(u):
        v, g = target(scale @ u)
        return v, scale.T @ g

    u = np.linalg.solve(scale, start)
    eps, mu, h_bar, log_bar = 0.1, math.log(1.0), 0.0, 0.0
    out, told = np.empty((draws, n)), []
    v, g = density(u)
    for i in range(warmup + draws):
        r = rng.standard_normal(n)
        joint = v - 0.5 * r @ r
        log_slice = joint - rng.exponential()
        minus = plus = (u, r, g)
        size, go, accepted, tried, diverged, depth = 1, True, 0.0, 0, False, 0

        def leap(state, direction):
            q, p, grad = state
            p = p + 0.5 * direction * eps * grad
            q = q + direction * eps * p
            value, grad = density(q)
            return (q, p + 0.5 * direction * eps * grad, grad), value

        def build(state, direction, level):
            nonlocal accepted, tried, diverged
            if level == 0:
                new, value = leap(state, direction)
                energy = value - 0.5 * new[1] @ new[1]
                ok = energy > log_slice - 1000
                diverged |= not ok
                accepted += min(1.0, math.exp(min(0.0, energy - joint)))
                tried += 1
                return new, new, (new[0], value, new[2]), int(energy >= log_slice), ok
            a, b, pick, k, fine = build(state, direction, level - 1)
            if fine:
                far = b if direction > 0 else a
                c, d, pick2, k2, fine = build(far, direction, level - 1)
                a, b = (a, d) if direction > 0 else (c, b)
                if k + k2 and rng.uniform() < k2 / (k + k2):
                    pick = pick2
                k += k2
                fine = fine and _straight(a, b)
            return a, b, pick, k, fine

        while go and depth < max_depth:
            direction = 1 if rng.uniform() < 0.5 else -1
            if direction > 0:
                _, plus, pick, k, fine = build(plus, 1, depth)
            else:
                minus, _, pick, k, fine = build(minus, -1, depth)
            if fine and rng.uniform() < min(1.0, k / size):
                u, v, g = pick
            size += k
            go = fine and _straight(minus, plus)
            depth += 1
        if i < warmup:
            t = i + 1
            h_bar += (0.8 - accepted / max(tried, 1) - h_bar) / (t + 10)
            log_eps = mu - math.sqrt(t) / 0.05 * h_bar
            log_bar += t**-0.75 * (log_eps - log_bar)
            eps = math.exp(log_eps if t < warmup else log_bar)
        else:
            out[i - warmup] = scale @ u
            told.append((diverged, -joint, tried))
    return out, pd.DataFrame(told, columns=["diverging", "energy", "num_steps"])


def _straight(a, b) -> bool:
    d = b[0] - a[0]
    return d @ a[1] >= 0 and d @ b[1] >= 0


def regression_target(pdf: pd.DataFrame, y: str, features: list[str]) -> LinearGaussian:
    """Of the standardised values, with a constant first."""
    v = pdf[y].to_numpy(dtype=float)
    return LinearGaussian(np.column_stack([np.ones(len(pdf)), pdf[features].to_numpy(dtype=float)]), (v - v.mean()) / (v.std() or 1.0))


def bayes_regression(rows: DataFrame, keys: list[str], y: str, features: list[str], chains: int = 4, draws: int = 200, warmup: int = 200, seed: int = 1) -> DataFrame:
    """Rows (keys, chain, draw, site, value): a VI fit of each series starts and scales its NUTS chains, one task for each chain."""
    each = rows.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        target = regression_target(pdf, y, features)
        m, low, _ = advi(target, target.size, seed=seed)
        chain = int(pdf["chain"].iloc[0])
        start = m + low @ np.random.default_rng([seed, chain]).standard_normal(target.size)
        found, _ = nuts(target, start, draws, warmup, seed + chain, low)
        out = pd.DataFrame({"chain": chain, "draw": np.repeat(np.arange(draws), target.size), "site": np.tile([*[f"beta_{k}" for k in range(target.size - 1)], "log_sigma"], draws), "value": found.reshape(-1)})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    return each.select(*keys, "chain", y, *features).groupBy(*keys, "chain").applyInPandas(run, f"{schema}, chain int, draw int, site string, value double")
