"""R-hat, effective sizes and neighbour estimates of draws held whole in NumPy, for comparison."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd


def ranks_to_normal(x: np.ndarray) -> np.ndarray:
    flat = pd.Series(x.reshape(-1)).rank(method="average").to_numpy()
    p = (flat - 0.375) / (len(flat) + 0.25)
    inverse = NormalDist().inv_cdf
    return np.array([inverse(v) for v in p]).reshape(x.shape)


def split(x: np.ndarray) -> np.ndarray:
    half = x.shape[1] // 2
    return np.concatenate([x[:, :half], x[:, x.shape[1] - half :]])


def _r_hat(x: np.ndarray) -> float:
    n = x.shape[1]
    within = x.var(axis=1, ddof=1).mean()
    between = n * x.mean(axis=1).var(ddof=1)
    return float(np.sqrt(((n - 1) / n * within + between / n) / within)) if within > 0 else math.nan


def rank_r_hat(x: np.ndarray) -> float:
    """The larger of rank-normalised split R-hat and that of folded draws (Vehtari et al. 2021)."""
    s = split(x)
    return max(_r_hat(ranks_to_normal(s)), _r_hat(ranks_to_normal(np.abs(s - np.median(s)))))


def effective_size(x: np.ndarray) -> float:
    """By Geyer's initial monotone sequence over split chains."""
    m, n = x.shape
    centred = x - x.mean(axis=1, keepdims=True)
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(centred, size, axis=1)
    acov = np.fft.irfft(f * np.conj(f), size, axis=1)[:, :n] / n
    within = acov[:, 0].mean() * n / (n - 1)
    plus = within * (n - 1) / n + (x.mean(axis=1).var(ddof=1) if m > 1 else 0.0)
    if plus <= 0:
        return math.nan
    rho = 1 - (within - acov.mean(axis=0)) / plus
    rho[0] = 1.0
    pairs = rho[: n - n % 2].reshape(-1, 2).sum(axis=1)
    negative = np.flatnonzero(pairs < 0)
    pairs = np.minimum.accumulate(pairs[: negative[0]] if len(negative) else pairs)
    tau = max(-1 + 2 * pairs.sum(), 1 / math.log10(m * n))
    return float(m * n / tau)


def summary(x: np.ndarray) -> tuple[float, float, float]:
    """r_hat, ess_bulk and ess_tail of a row for each chain."""
    low, high = np.quantile(x, [0.05, 0.95])
    tail = min(effective_size(split((x <= low).astype(float))), effective_size(split((x <= high).astype(float))))
    return rank_r_hat(x), effective_size(ranks_to_normal(split(x))), tail


def knn_kl(p: np.ndarray, q: np.ndarray, k: int = 5, chunk: int = 512) -> float:
    """The k-nearest-neighbour estimate of Wang, Kulkarni and Verdu. Repeated draws have distance zero, which counts as the smallest double."""
    if len(p) <= k or len(q) < k:
        raise ValueError("too few draws")

    def distance(a: np.ndarray, b: np.ndarray, nth: int) -> np.ndarray:
        out = [np.partition(np.sqrt(np.maximum(((a[i : i + chunk, None, :] - b[None, :, :]) ** 2).sum(-1), 0)), nth, axis=1)[:, nth] for i in range(0, len(a), chunk)]
        return np.concatenate(out)

    own, other = distance(p, p, k), distance(p, q, k - 1)
    own, other = np.maximum(own, np.finfo(float).tiny), np.maximum(other, np.finfo(float).tiny)
    return float(p.shape[1] * np.mean(np.log(other / own)) + math.log(len(q) / (len(p) - 1)))
