"""Special functions as SQL text, so that they stay in generated code and can be checked against another SQL engine.

Each takes and gives a SQL expression; :func:`col` turns one into a Column.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Hart's rational approximation of the normal distribution function, as published by West (2005).
_CDF_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_CDF_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
# Coefficients of Wichura's algorithm AS 241 (1988), highest power first.
_PPF_MIDDLE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
_PPF_NEAR = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
_PPF_FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
)
SQRT_2PI = math.sqrt(2 * math.pi)


def col(sql: str) -> Column:
    return F.expr(sql)


def number(x: float) -> str:
    """A double literal both engines read alike."""
    return f"CAST('{x!r}' AS DOUBLE)"


def _horner(x: str, coefficients) -> str:
    out = number(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {number(c)})"
    return out


def pdf(z: str) -> str:
    return f"(exp(-0.5 * ({z}) * ({z})) / {number(SQRT_2PI)})"


def cdf(z: str) -> str:
    a = f"abs({z})"
    e = f"exp(-0.5 * ({z}) * ({z}))"
    near = f"{e} * {_horner(a, _CDF_TOP)} / {_horner(a, _CDF_BOTTOM)}"
    far = f"{e} / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + {number(0.65)}))))) / {number(SQRT_2PI)}"
    tail = f"CASE WHEN {a} < {number(7.07106781186547)} THEN {near} ELSE {far} END"
    return f"(CASE WHEN ({z}) > 0 THEN 1 - ({tail}) ELSE {tail} END)"


def logpdf(y: str, mean: str, sd: str) -> str:
    return f"(-0.5 * (({y}) - ({mean})) * (({y}) - ({mean})) / (({sd}) * ({sd})) - ln({sd}) - {number(math.log(SQRT_2PI))})"


def ppf(p: str) -> str:
    """The normal quantile, null outside (0, 1)."""
    q = f"(({p}) - 0.5)"
    r = f"({number(0.180625)} - {q} * {q})"
    s = f"sqrt(-ln(least({p}, 1 - ({p}))))"
    middle = f"{q} * {_horner(r, _PPF_MIDDLE[0])} / {_horner(r, _PPF_MIDDLE[1])}"
    n, f = f"({s} - {number(1.6)})", f"({s} - 5)"
    near = f"{_horner(n, _PPF_NEAR[0])} / {_horner(n, _PPF_NEAR[1])}"
    far = f"{_horner(f, _PPF_FAR[0])} / {_horner(f, _PPF_FAR[1])}"
    tail = f"CASE WHEN {s} <= 5 THEN {near} ELSE {far} END"
    return f"(CASE WHEN ({p}) <= 0 OR ({p}) >= 1 THEN NULL WHEN abs({q}) <= {number(0.425)} THEN {middle} WHEN {q} < 0 THEN -({tail}) ELSE {tail} END)"


def interpolated(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise linear lookup of x in sorted knots, clamped at both ends, as numpy's interp."""
    k = F.size(F.filter(xs, lambda v: v <= x))
    at = F.greatest(F.lit(1), F.least(k, F.size(xs) - 1))
    x0, x1, y0, y1 = F.get(xs, at - 1), F.get(xs, at), F.get(ys, at - 1), F.get(ys, at)
    inner = y0 + (x - x0) / F.nullif(x1 - x0, F.lit(0.0)) * (y1 - y0)
    return F.when(k == 0, F.get(ys, F.lit(0))).when(k >= F.size(xs), F.get(ys, F.size(ys) - 1)).otherwise(F.coalesce(inner, y1))


def logsumexp(values: Column) -> Column:
    """Of an array of doubles."""
    top = F.array_max(values)
    return top + F.ln(F.aggregate(values, F.lit(0.0), lambda a, v: a + F.exp(v - top)))


def kolmogorov_cdf(n: int, d: float) -> float:
    """P(D_n < d) exactly, by Marsaglia, Tsang and Wang's matrix power."""
    if d <= 0:
        return 0.0
    if d >= 1:
        return 1.0
    k = int(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    lower = np.subtract.outer(np.arange(m), np.arange(m)) + 1  # i - j + 1
    a = (lower >= 0).astype(float)
    powers = h ** np.arange(1, m + 1)
    a[:, 0] -= powers
    a[m - 1, :] -= powers[::-1]
    if 2 * h > 1:
        a[m - 1, 0] += (2 * h - 1) ** m
    a *= np.exp([-math.lgamma(i + 1) for i in range(m + 1)])[np.maximum(lower, 0)]
    q, e, power, out, oe = a.copy(), 0, n, np.eye(m), 0
    while power:
        if power & 1:
            out, oe = out @ q, oe + e
            if out[k - 1, k - 1] > 1e140:
                out, oe = out * 1e-140, oe + 140
        q, e = q @ q, 2 * e
        if q[k - 1, k - 1] > 1e140:
            q, e = q * 1e-140, e + 140
        power >>= 1
    value = out[k - 1, k - 1]
    log = math.log(value) + oe * math.log(10) + math.lgamma(n + 1) - n * math.log(n) if value > 0 else -math.inf
    return min(1.0, math.exp(log))


def kolmogorov_ppf(p: float, n: int) -> float:
    """The critical distance: the smallest d with P(D_n < d) >= p, by bisection."""
    lo, hi = 0.5 / n, min(1.0, math.sqrt(math.log(2 / (1 - p)) / (2 * n)) + 1e-9)  # no value beyond this has so small a tail
    for _ in range(45):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if kolmogorov_cdf(n, mid) < p else (lo, mid)
    return (lo + hi) / 2
