"""Regression with autoregressive errors over series of any length: fits from sums of products, and the exact likelihood across gaps.

A series on a grid of ``step`` seconds is cut into buckets of ``bucket`` steps, each a task's work; a time without a row, or with a missing value in it, is a gap.
Of rows with the same time the greatest (by its numbers in order, gaps least) counts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timegrid import HALF_HOUR

BUCKET, MERGED = 4096, 256


def _schema(rows: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)


def _placed(rows: DataFrame, keys: list[str], y: str, features: list[str], ts: str, step: int, bucket: int, before: int) -> DataFrame:
    """Rows (keys, __bucket, __at, __z) with z the observation and its features; those up to ``before`` steps before a bucket are copied to it."""
    at = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(step * 1_000_000))
    of = lambda i: F.floor(i / F.lit(bucket)).cast("long")
    z = F.array(*[F.col(c).cast("double") for c in [y, *features]])
    return rows.select(*keys, F.explode(F.sequence(of(at), of(at + before))).alias("__bucket"), at.cast("long").alias("__at"), z.alias("__z"))


def _dense(pdf: pd.DataFrame, bucket: int, before: int, width: int) -> np.ndarray:
    """The bucket's rows and those before it as a matrix on the grid; gaps are rows of NaN."""
    z = np.full((bucket + before, width), np.nan)
    if len(pdf):
        values = np.array([np.asarray(v, dtype=float) for v in pdf["__z"]])
        at = pdf["__at"].to_numpy()
        by = np.lexsort((*np.where(np.isfinite(values), values, -np.inf).T[::-1], at))
        z[at[by] - (pdf["__bucket"].to_numpy()[0] * bucket - before)] = values[by]
    z[~np.isfinite(z).all(axis=1)] = np.nan
    return z


def _merged(parts: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and centred products of several parts together."""
    n = parts["n"].to_numpy(dtype=float)
    means, products = np.stack(parts["mean"].to_list()), np.stack(parts["products"].to_list())
    mean = n @ means / max(n.sum(), 1.0)
    off = means - mean
    return int(n.sum()), mean, products.sum(axis=0) + ((off * n[:, None]).T @ off).ravel()


def lagged_products(rows: DataFrame, keys: list[str], y: str, features: list[str], p: int, ts: str = "ts", step: int = HALF_HOUR, bucket: int = BUCKET) -> DataFrame:
    """Rows (keys, n, mean, products): sums over all equations of a row stacked with the ``p`` rows before it, centred at their means.

    An equation counts if its row and the ``p`` before have no missing value. Parts of a series are merged by ``MERGED`` buckets, then altogether, by the rule for
    centred products, so that no large level of a column costs digits. What is merged at the end has ((features + 1) (p + 1))^2 numbers for each ``bucket * MERGED`` rows.
    """
    width = len(features) + 1
    fields = "n long, mean array<double>, products array<double>"

    def part(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z = _dense(pdf, bucket, p, width)
        u = np.concatenate([z[p - a : p - a + bucket] for a in range(p + 1)], axis=1)
        u = u[np.isfinite(u).all(axis=1)]
        mean = u.mean(axis=0) if len(u) else np.zeros(u.shape[1])
        c = u - mean
        return pd.DataFrame([[*key[:-1], key[-1] // MERGED, len(u), mean, (c.T @ c).ravel()]], columns=[*keys, "__group", "n", "mean", "products"])

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, *_merged(pdf)]], columns=[*named, "n", "mean", "products"])

    placed = _placed(rows, keys, y, features, ts, step, bucket, p)
    found = placed.groupBy(*keys, "__bucket").applyInPandas(part, f"{_schema(rows, keys)}, __group long, {fields}")
    named = [*keys, "__group"]
    found = found.groupBy(*named).applyInPandas(merge, f"{_schema(rows, keys)}, __group long, {fields}")
    named = keys
    return found.drop("__group").groupBy(*keys).applyInPandas(merge, f"{_schema(rows, keys)}, {fields}")


def _solved(w: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Least squares from sums of products, scaled to unit diagonal; directions without variation get nothing."""
    s = np.sqrt(np.maximum(np.diag(w), 0.0))
    s = np.where(s > 0, s, 1.0)
    return np.linalg.lstsq(w / np.outer(s, s), r / s, rcond=1e-12)[0] / s


def fit_from_products(n: int, mean: np.ndarray, products: np.ndarray, p: int, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """Beta (constant first), phi and innovation spread by iterated generalised least squares on :func:`lagged_products`."""
    d = len(mean) // (p + 1)
    m = products.reshape(p + 1, d, p + 1, d).transpose(0, 2, 1, 3)
    means = mean.reshape(p + 1, d)
    centre, scale = means[0], np.sqrt(np.maximum(np.diag(m[0, 0]), 0.0) / n)
    scale = np.where(scale > 0, scale, 1.0)
    off = (means - centre) / scale
    g = np.empty((p + 1, p + 1, d + 1, d + 1))
    for a in range(p + 1):
        for b in range(p + 1):
            g[a, b, :d, :d] = m[a, b] / np.outer(scale, scale) + n * np.outer(off[a], off[b])
            g[a, b, :d, d], g[a, b, d, :d], g[a, b, d, d] = n * off[a], n * off[b], n
    phi = np.zeros(p)
    for _ in range(rounds):
        c = np.concatenate([[1.0], -phi])
        w = np.einsum("a,b,abij->ij", c, c, g)
        beta = _solved(w[1:, 1:], w[1:, 0])
        e = np.concatenate([[1.0], -beta])
        by_lag = np.einsum("i,j,abij->ab", e, e, g)
        new = _solved(by_lag[1:, 1:], by_lag[1:, 0]) if p else phi
        done = not p or np.abs(new - phi).max() < 1e-9
        phi = new
        if done:
            break
    c = np.concatenate([[1.0], -phi])
    residual = c @ (g[:, 0, :, d] @ e) / n
    sigma = math.sqrt(max(0.0, c @ by_lag @ c / n - residual**2))
    slopes = scale[0] * beta[:-1] / scale[1:]
    level = centre[0] + scale[0] * beta[-1] - slopes @ centre[1:]
    return np.concatenate([[level], slopes]), phi, float(scale[0] * sigma)


def ar_regression(rows: DataFrame, keys: list[str], y: str, features: list[str], p: int, ts: str = "ts", step: int = HALF_HOUR, bucket: int = BUCKET) -> DataFrame:
    """One row for each series: beta (constant first), phi, sigma of a regression with AR(p) errors; null where no equation is whole.

    The rows are met once; each round of the fit is a solve of the size of the design, not a pass.
    """

    def solve(batches):
        for pdf in batches:
            fits = [fit_from_products(r.n, np.asarray(r.mean), np.asarray(r.products), p) if r.n else (None, None, None) for r in pdf.itertuples(index=False)]
            out = pdf[keys].copy()
            for i, name in enumerate(("beta", "phi", "sigma")):
                out[name] = pd.Series([f[i] for f in fits], index=out.index, dtype=object if i < 2 else float)
            yield out

    sums = lagged_products(rows, keys, y, features, p, ts, step, bucket)
    return sums.mapInPandas(solve, f"{_schema(rows, keys)}, beta array<double>, phi array<double>, sigma double")


# The state holds the last errors, most recent first. A stretch of time is an element (a, b, c, eta, j) whose composition is associative.


def _companion(phi: np.ndarray) -> np.ndarray:
    t = np.eye(len(phi), k=-1)
    t[0] = phi
    return t


def stationary_spread(phi: np.ndarray, sigma: float) -> np.ndarray | None:
    """Covariance of the state long after the start, by doubling; none if the process isn't stationary."""
    t = _companion(phi)
    if np.abs(np.linalg.eigvals(t)).max() >= 1:
        return None
    c = np.zeros_like(t)
    c[0, 0] = sigma * sigma
    for _ in range(200):
        more = t @ c @ t.T
        c, t = c + more, t @ t
        if np.abs(more).max() <= 1e-17 * np.abs(c).max():
            break
    return c


def _unseen(phi: np.ndarray, sigma: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Transition and added spread of ``n`` steps without a reading, by doubling."""
    a, c = np.eye(len(phi)), np.zeros((len(phi), len(phi)))
    t, q = _companion(phi), np.zeros_like(c)
    q[0, 0] = sigma * sigma
    while n:
        if n & 1:
            a, c = t @ a, t @ c @ t.T + q
        t, q, n = t @ t, t @ q @ t.T + q, n >> 1
    return a, c


def _stepped(m: np.ndarray, s: np.ndarray, t: np.ndarray, q: float, e: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One step of the filter; the reading's log density, zero for a gap."""
    m, s = t @ m, t @ s @ t.T
    s[0, 0] += q
    if not math.isfinite(e):
        return m, s, 0.0
    v, off = s[0, 0], e - m[0]
    gain = s[:, 0] / v
    m, s = m + gain * off, s - np.outer(gain, s[0])
    s[0], s[:, 0], m[0] = 0.0, 0.0, e
    return m, s, -0.5 * (math.log(2 * math.pi * v) + off * off / v)


def _runs(e: np.ndarray, p: int) -> np.ndarray:
    """For each row, whether it and the p - 1 rows before it (of the bucket) are readings, so that the state is known."""
    seen = np.isfinite(e)
    known = seen.copy()
    for k in range(1, p):
        known[k:] &= seen[:-k]
        known[:k] = False
    return known


def _element(e: np.ndarray, phi: np.ndarray, sigma: float) -> tuple[np.ndarray, ...]:
    """A bucket as an element; after the last place where the state is known, what came before doesn't matter."""
    p, t, q = len(phi), _companion(phi), sigma * sigma
    known = np.flatnonzero(_runs(e, p))
    zero = np.zeros((p, p))
    if len(known):
        r = known[-1]
        m, s = e[r - p + 1 : r + 1][::-1].copy(), zero.copy()
        for v in e[r + 1 :]:
            m, s, _ = _stepped(m, s, t, q, v)
        return zero, m, s, np.zeros(p), zero
    noise = zero.copy()
    noise[0, 0] = q
    a, b, c, eta, j = np.eye(p), np.zeros(p), zero, np.zeros(p), zero
    for v in e:
        if math.isfinite(v):
            aj, bj, cj, ej, jj = t.copy(), np.zeros(p), zero, phi * v / q, np.outer(phi, phi) / q
            aj[0], bj[0] = 0.0, v
        else:
            aj, bj, cj, ej, jj = t, np.zeros(p), noise, np.zeros(p), zero
        inner = np.linalg.inv(np.eye(p) + c @ jj)
        a, b, c, eta, j = aj @ inner @ a, aj @ inner @ (b + c @ ej) + bj, aj @ inner @ c @ aj.T + cj, a.T @ inner.T @ (ej - jj @ b) + eta, a.T @ inner.T @ jj @ a + j
    return a, b, c, eta, j


def _bucket_density(e: np.ndarray, phi: np.ndarray, sigma: float, m: np.ndarray, s: np.ndarray) -> float:
    """Log density of a bucket's readings given the state before it: at once where the state is known, step by step elsewhere."""
    p, t, q = len(phi), _companion(phi), sigma * sigma
    known = _runs(e, p)
    easy = np.isfinite(e)
    easy[1:] &= known[:-1]
    easy[0] = False
    total, i = 0.0, np.flatnonzero(easy)
    if len(i):
        off = e[i] - sum(phi[k] * e[i - 1 - k] for k in range(p))
        total -= 0.5 * (len(i) * math.log(2 * math.pi * q) + float(off @ off) / q)
    for i in np.flatnonzero(~easy):
        if i and known[i - 1]:
            m, s = e[i - p : i][::-1].copy(), np.zeros((p, p))
        m, s, more = _stepped(m, s, t, q, e[i])
        total += more
    return total


def ar_log_likelihood(rows: DataFrame, points: DataFrame, keys: list[str], y: str, features: list[str], ts: str = "ts", step: int = HALF_HOUR, bucket: int = BUCKET) -> DataFrame:
    """Rows (keys, point, n, log_likelihood): the exact Gaussian log likelihood of regressions with AR errors, gaps left open, at ``points`` (keys, point, beta, phi, sigma).

    Points of a series may differ in order; a series or bucket meets all its points at once, so they should be few. The state starts from its stationary
    distribution; the result is null for a point without one (or with a null in it, or sigma 0). Each bucket is summed up as one element (:func:`_element`), one task
    carries the state over a series' elements, and then each bucket has its density given the state before it. Buckets without rows are skipped in one step.
    """
    width = len(features) + 1
    state = "a array<double>, b array<double>, c array<double>, eta array<double>, j array<double>"
    schema = _schema(rows, keys)
    given = F.struct("point", "beta", "phi", "sigma")
    sets = points.groupBy(*keys).agg(F.collect_list(given).alias("points"))
    placed = _placed(rows, keys, y, features, ts, step, bucket, 0)
    on = [*keys, "__bucket"]
    asked = placed.select(*on).distinct().join(sets, keys).select(*on, F.explode("points").alias("__p")).select(*[F.col(c).alias(c) for c in on], "__p.*")

    def errors(z: np.ndarray, beta) -> np.ndarray:
        return z[:, 0] - beta[0] - z[:, 1:] @ np.asarray(beta[1:], dtype=float)

    def sound(r) -> bool:
        whole = r.beta is not None and r.phi is not None and len(r.phi) > 0 and np.isfinite(np.concatenate([r.beta, r.phi])).all()
        return bool(whole and r.sigma is not None and r.sigma > 0 and stationary_spread(np.asarray(r.phi), r.sigma) is not None)

    def elements(key: tuple, pdf: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        z, out = _dense(pdf, bucket, 0, width), []
        for r in at.itertuples(index=False):
            if sound(r):
                parts = _element(errors(z, r.beta), np.asarray(r.phi), r.sigma)
                out.append([*key, r.point, r.beta, r.phi, r.sigma, *[x.ravel() for x in parts]])
        return pd.DataFrame(out, columns=[*on, "point", "beta", "phi", "sigma", "a", "b", "c", "eta", "j"])

    def carried(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, last, m, s = [], None, None, None
        for r in pdf.rename(columns={"__bucket": "bucket"}).sort_values("bucket").itertuples(index=False):
            phi = np.asarray(r.phi)
            p = len(phi)
            if last is None:
                m, s = np.zeros(p), stationary_spread(phi, r.sigma)
            elif r.bucket - last > 1:
                a, c = _unseen(phi, r.sigma, int(r.bucket - last - 1) * bucket)
                m, s = a @ m, a @ s @ a.T + c
            last = r.bucket
            out.append([*key[:-1], last, r.point, r.beta, r.phi, r.sigma, m, s.ravel()])
            a, c, j = (np.asarray(x).reshape(p, p) for x in (r.a, r.c, r.j))
            inner = np.linalg.inv(np.eye(p) + s @ j)
            m, s = a @ inner @ (m + s @ np.asarray(r.eta)) + np.asarray(r.b), a @ inner @ s @ a.T + c
        return pd.DataFrame(out, columns=[*on, "point", "beta", "phi", "sigma", "m", "s"])

    def density(key: tuple, pdf: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        z, out = _dense(pdf, bucket, 0, width), []
        for r in at.itertuples(index=False):
            p = len(r.phi)
            e = errors(z, r.beta)
            out.append([*key[:-1], r.point, int(np.isfinite(e).sum()), _bucket_density(e, np.asarray(r.phi), r.sigma, np.asarray(r.m), np.asarray(r.s).reshape(p, p))])
        return pd.DataFrame(out, columns=[*keys, "point", "n", "l"])

    kind = points.schema["point"].dataType.simpleString()
    fit = f"point {kind}, beta array<double>, phi array<double>, sigma double"
    told = placed.groupBy(*on).cogroup(asked.groupBy(*on)).applyInPandas(elements, f"{schema}, __bucket long, {fit}, {state}")
    before = told.groupBy(*keys, "point").applyInPandas(carried, f"{schema}, __bucket long, {fit}, m array<double>, s array<double>")
    each = placed.groupBy(*on).cogroup(before.groupBy(*on)).applyInPandas(density, f"{schema}, point {kind}, n long, l double")
    sums = each.groupBy(*keys, "point").agg(F.sum("n").alias("n"), F.sum("l").alias("log_likelihood"))
    return points.select(*keys, "point").join(sums, [*keys, "point"], "left")


def akaike(n_parameters: Column, log_likelihood: Column) -> Column:
    return 2.0 * n_parameters - 2.0 * log_likelihood
