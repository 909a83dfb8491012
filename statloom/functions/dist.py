"""Probability distributions as vectorised column functions for small result frames.

Textbook algorithms on numpy/math: Lentz continued fractions for the incomplete beta and
gamma functions, bisection for quantiles, AS 241 for the normal quantile.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
_TINY = 1e-300


def _finite(*xs) -> bool:
    return all(x is not None and math.isfinite(x) for x in xs)


# ---------------------------------------------------------------- scalar functions


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 100_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / (d if abs(d) > _TINY else _TINY)
            c = 1 + num / c
            c = c if abs(c) > _TINY else _TINY
            step = c * d
            h *= step
        if abs(step - 1) < 1e-15:
            break
    return min(max(front * h / a, 0.0), 1.0)


def gamma_sf(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(1.0 - total * scale, 0.0)
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def norm_sf(z: float) -> float:
    return norm_cdf(-z)


def t_sf(t: float, df: float) -> float:
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def f_sf(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2, x / 2)


def _bisect(cdf: Callable[[float], float], p: float, lo: float, hi: float) -> float:
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def beta_ppf(p: float, a: float, b: float) -> float:
    return _bisect(lambda x: beta_inc(a, b, x), p, 0.0, 1.0)


def t_ppf(p: float, df: float) -> float:
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_ppf(1 - p, df)
    hi = 2.0
    while t_sf(hi, df) > 1 - p:
        hi *= 2
    return _bisect(lambda t: 1 - t_sf(t, df), p, 0.0, hi)


# Coefficients of the normal quantile, algorithm AS 241 (Wichura 1988).
_CENTRE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
     45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867,
     39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
_MIDDLE = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
     1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590,
     0.0151986665636164571966, 0.000547593808499534494600, 0.00000000105075007164441684324),
)
_FAR = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
     0.0265321895265761230930, 0.00124266094738807843860, 0.0000271155556874348757815,
     0.000000201033439929228813265),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
     0.000786869131145613259100, 0.0000184631831751005468180, 0.000000142151175831644588870,
     0.00000000000000204426310338993978564),
)


def _ratio(coefs, x):
    top, bottom = 0.0, 0.0
    for a in reversed(coefs[0]):
        top = top * x + a
    for b in reversed(coefs[1]):
        bottom = bottom * x + b
    return top / bottom


def norm_ppf(p: float) -> float:
    if not 0 < p < 1:
        return -math.inf if p == 0 else math.inf if p == 1 else NAN
    q = p - 0.5
    if abs(q) <= 0.425:
        return q * _ratio(_CENTRE, 0.180625 - q * q)
    r = math.sqrt(-math.log(min(p, 1 - p)))
    z = _ratio(_MIDDLE, r - 1.6) if r <= 5 else _ratio(_FAR, r - 5)
    return math.copysign(z, q)


def norm_ppf_array(p: np.ndarray) -> np.ndarray:
    """The normal quantile of a whole array."""
    with np.errstate(all="ignore"):
        q = p - 0.5
        r = np.sqrt(-np.log(np.minimum(p, 1 - p)))
        tail = np.where(r <= 5, _ratio(_MIDDLE, r - 1.6), _ratio(_FAR, r - 5))
        return np.where(np.abs(q) <= 0.425, q * _ratio(_CENTRE, 0.180625 - q * q), np.sign(q) * tail)


def binom_tail(k: int, n: int, p: float = 0.5) -> float:
    """P(X >= k) for X ~ Binomial(n, p)."""
    if k <= 0:
        return 1.0
    return 0.0 if k > n else beta_inc(k, n - k + 1, p)


def sign_p(k: float, n: float, side: str) -> float:
    """Exact binomial p-value against one half."""
    if n == 0:
        return 1.0
    up, down = binom_tail(int(k), int(n)), 1 - binom_tail(int(k) + 1, int(n))
    if side == "greater":
        return up
    return down if side == "less" else min(1.0, 2 * min(up, down))


def fisher_p(a: float, b: float, c: float, d: float) -> float:
    """Two-sided Fisher exact test: all tables at most as likely as the observed one."""
    a, b, c, d = (int(v) for v in (a, b, c, d))
    r1, c1, n = a + b, a + c, a + b + c + d
    ks = np.arange(max(0, r1 + c1 - n), min(r1, c1) + 1)
    lg = np.frompyfunc(math.lgamma, 1, 1)

    def log_choose(m, k):
        return (lg(m + 1.0) - lg(k + 1.0) - lg(m - k + 1.0)).astype(float)

    logp = log_choose(np.float64(r1), ks) + log_choose(np.float64(n - r1), c1 - ks)
    logp -= np.log(np.exp(logp - logp.max()).sum()) + logp.max()
    return float(min(1.0, np.exp(logp[logp <= logp[ks == a][0] + 1e-7]).sum()))


def kolmogorov_sf(x: float) -> float:
    if x < 0.04:
        return 1.0
    total = 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 101))
    return min(max(total, 0.0), 1.0)


def ks_p(d: float, n1: float, n2: float, side: str) -> float:
    """Two-sample Kolmogorov-Smirnov: exact by lattice paths for small samples, else the limit law."""
    n1, n2 = int(n1), int(n2)
    if n1 * n2 <= 250_000:
        # Probability that a random path from (0,0) to (n1,n2) stays below the observed distance.
        i = np.arange(n2 + 1) / n2
        inside = np.zeros(n2 + 1)
        for a in range(n1 + 1):
            gap = a / n1 - i
            gap = np.abs(gap) if side == "two-sided" else gap if side == "greater" else -gap
            ok = gap < d - 1e-12
            if a == 0:
                inside = np.where(np.cumprod(ok) > 0, 1.0, 0.0)
                continue
            nxt = np.zeros(n2 + 1)
            left = 0.0
            for j in range(n2 + 1):
                steps = a + j
                left = (inside[j] * a + left * j) / steps if ok[j] else 0.0
                nxt[j] = left
            inside = nxt
        return float(min(max(1 - inside[n2], 0.0), 1.0))
    en = n1 * n2 / (n1 + n2)
    return kolmogorov_sf(math.sqrt(en) * d) if side == "two-sided" else math.exp(-2 * en * d * d)


def _side_p(upper: float, lower: float, side: str, ties_at: float = 0.0) -> float:
    if side == "greater":
        return upper
    return lower if side == "less" else min(1.0, 2 * min(upper, lower))


def mannwhitney_p(u: float, n1: float, n2: float, ties: float, side: str) -> float:
    """Exact for small untied samples, otherwise normal with tie and continuity correction."""
    n1, n2 = int(n1), int(n2)
    if ties == 0 and min(n1, n2) <= 8 and n1 * n2 <= 100_000:
        counts = np.zeros(n1 * n2 + 1)
        counts[0] = 1.0
        for j in range(1, n1 + 1):  # Gaussian binomial coefficient, factor by factor
            up = np.zeros_like(counts)
            up[:] = counts
            k = n2 + j
            if k <= n1 * n2:
                up[k:] -= counts[:-k]
            for s in range(j, len(up)):
                up[s] += up[s - j]
            counts = up
        probs = counts / counts.sum()
        k = int(round(u))
        return _side_p(float(probs[k:].sum()), float(probs[: k + 1].sum()), side)
    n = n1 + n2
    sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
    if sd == 0:
        return NAN
    mean = n1 * n2 / 2
    if side == "two-sided":
        return min(1.0, 2 * norm_sf((max(u, n1 * n2 - u) - mean - 0.5) / sd))
    return norm_sf(((u if side == "greater" else n1 * n2 - u) - mean - 0.5) / sd)


def wilcoxon_p(t_plus: float, n: float, ties: float, zeros: float, side: str) -> float:
    n = int(n)
    if n == 0:
        return NAN
    if n <= 50 and ties == 0 and zeros == 0:
        counts = np.zeros(n * (n + 1) // 2 + 1)
        counts[0] = 1.0
        for j in range(1, n + 1):
            counts[j:] = counts[j:] + counts[:-j]
        probs = counts / counts.sum()
        k = int(round(t_plus))
        return _side_p(float(probs[k:].sum()), float(probs[: k + 1].sum()), side)
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    if sd == 0:
        return NAN
    z = (t_plus - n * (n + 1) / 4) / sd
    return norm_sf(z) if side == "greater" else norm_cdf(z) if side == "less" else 2 * norm_sf(abs(z))


def kendall_p(con_minus_dis: float, dis: float, n: float, var: float, ties: float) -> float:
    n = int(n)
    total = n * (n - 1) // 2
    if ties == 0 and n <= 33:
        counts = np.zeros(total + 1)
        counts[0] = 1.0
        for j in range(2, n + 1):
            run = np.cumsum(counts)
            run[j:] = run[j:] - run[:-j]
            counts = run / j
        c = int(min(dis, total - dis))
        return float(min(1.0, 2 * counts[: c + 1].sum()))
    return 2 * norm_sf(abs(con_minus_dis) / math.sqrt(var)) if var > 0 else NAN


# Case 3 of D'Agostino & Stephens (1986) for the Anderson-Darling statistic,
# significance levels and critical points before the sample-size correction.
ANDERSON_LEVELS = (0.15, 0.10, 0.05, 0.025, 0.01)
ANDERSON_POINTS = (0.561, 0.631, 0.752, 0.873, 1.035)


def anderson_critical(n: float, alpha: float) -> float:
    i = min(range(5), key=lambda k: abs(ANDERSON_LEVELS[k] - alpha))
    return round(ANDERSON_POINTS[i] / (1 + 0.75 / n + 2.25 / (n * n)), 3)


def anderson_p(a2: float, n: float) -> float:
    """Interpolated between the tabulated levels, clipped at both ends."""
    points = [p / (1 + 0.75 / n + 2.25 / (n * n)) for p in ANDERSON_POINTS]
    return float(np.interp(a2, points, ANDERSON_LEVELS))


def shapiro(x: np.ndarray) -> tuple[float, float]:
    """Shapiro-Wilk W and p-value by Royston's approximation (AS R94, 1995)."""
    x = np.sort(np.asarray(x, dtype=float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return NAN, NAN
    m = np.array([norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ssq = float(m @ m)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        u = 1 / math.sqrt(n)
        c = m / math.sqrt(ssq)
        last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, c[-1]], u)
        a = np.empty(n)
        if n > 5:
            prev = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, c[-2]], u)
            phi = (ssq - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * prev**2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[1], a[-2] = -prev, prev
        else:
            phi = (ssq - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
        a[0], a[-1] = -last, last
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(1 - w) if w < 1 else -math.inf
    if n <= 11:
        gamma = 0.459 * n - 2.273
        if y >= gamma:
            return w, 1e-99
        y = -math.log(gamma - y)
        mean = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sd = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        ln = math.log(n)
        mean = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln)
        sd = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return w, norm_sf((y - mean) / sd)


# ---------------------------------------------------------------- column functions


def column_function(scalar: Callable[..., float], *fixed) -> Callable[..., Column]:
    """Lift a scalar function to columns; a missing or non-finite input gives NULL."""

    def lifted(*cols) -> Column:
        @F.pandas_udf("double")
        def apply(*parts: pd.Series) -> pd.Series:
            out = [
                scalar(*row, *fixed) if _finite(*row) else NAN for row in zip(*(p.tolist() for p in parts))
            ]
            return pd.Series(out, dtype="float64")

        res = apply(*[(c if isinstance(c, Column) else F.lit(c)).cast("double") for c in cols])
        return F.when(~F.isnan(res), res)

    return lifted


def sided_t_p(t: Column, df: Column, side: str = "two-sided") -> Column:
    upper = column_function(t_sf)
    if side == "two-sided":
        p = 2 * upper(F.abs(t), df)
        return F.when(p > 1, 1.0).otherwise(p)
    return upper(t if side == "greater" else -t, df)


def normal_quantile(p: Column) -> Column:
    @F.pandas_udf("double")
    def apply(part: pd.Series) -> pd.Series:
        return pd.Series(norm_ppf_array(part.to_numpy(float)))

    return apply(p.cast("double"))


t_quantile = column_function(t_ppf)
f_tail = column_function(f_sf)
chi2_tail = column_function(chi2_sf)
beta_quantile = column_function(beta_ppf)
normal_cdf = column_function(norm_cdf)
normal_tail = column_function(norm_sf)
