"""Regression with AR errors over whole arrays, and the density of a series as one multivariate normal."""

import math

import numpy as np


def ar_errors_fit(y: np.ndarray, x: np.ndarray, p: int, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """Regression with AR(p) errors by iterated generalised least squares: beta, phi, innovation spread.

    Rows are on a strict grid. An equation counts if its row and the ``p`` rows before it have no missing value, so that no lag spans a gap.
    """
    seen = np.isfinite(y) & np.isfinite(x).all(axis=1)
    y, x = np.where(seen, y, 0.0), np.where(seen[:, None], x, 0.0)
    whole = np.logical_and.reduce([seen[p - k : len(y) - k] for k in range(p + 1)])
    phi = np.zeros(p)
    for _ in range(rounds):
        ys = y[p:] - sum(phi[k] * y[p - 1 - k : len(y) - 1 - k] for k in range(p))
        xs = x[p:] - sum(phi[k] * x[p - 1 - k : len(x) - 1 - k] for k in range(p))
        beta = np.linalg.lstsq(xs[whole], ys[whole], rcond=None)[0]
        e = y - x @ beta
        lagged = np.stack([e[p - 1 - k : len(e) - 1 - k] for k in range(p)], axis=1)[whole]
        new = np.linalg.lstsq(lagged, e[p:][whole], rcond=None)[0]
        done = np.abs(new - phi).max() < 1e-9
        phi = new
        if done:
            break
    return beta, phi, float((e[p:][whole] - lagged @ phi).std(ddof=0))


def normal_log_likelihood(e: np.ndarray, phi: np.ndarray, sigma: float) -> float:
    """Log density of the finite errors, by the autocovariances of the process far into its impulse response."""
    psi = np.zeros(4000)
    psi[0] = 1.0
    for h in range(1, len(psi)):
        psi[h] = sum(f * psi[h - 1 - k] for k, f in enumerate(phi) if h > k)
    at = np.flatnonzero(np.isfinite(e))
    apart = np.abs(at[:, None] - at[None])
    cov = sigma**2 * np.array([psi[: len(psi) - k] @ psi[k:] if k < len(psi) else 0.0 for k in range(apart.max() + 1)])[apart]
    _, det = np.linalg.slogdet(cov)
    return float(-0.5 * (len(at) * math.log(2 * math.pi) + det + e[at] @ np.linalg.solve(cov, e[at])))
