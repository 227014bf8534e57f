"""Statistics of short series and of test statistics, on the driver.

Row-scale statistics are Spark aggregates; what is here works on one value per
period or per group, and on a handful of sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import exp, isfinite, lgamma, log, sqrt
from typing import NamedTuple

import numpy as np


def quantile(values: Sequence[float], q: float) -> float | None:
    """Linear interpolation at (n - 1) q; None without values."""
    return float(np.quantile(values, min(1.0, max(0.0, q)))) if len(values) else None


def mean(values: Sequence[float]) -> float | None:
    return float(np.mean(values)) if len(values) else None


def stdev(values: Sequence[float]) -> float:
    """Sample deviation; 0 below two values."""
    return float(np.std(values, ddof=1)) if len(values) > 1 else 0.0


def median(values: Sequence[float]) -> float | None:
    return quantile(values, 0.5)


def mad(values: Sequence[float]) -> float:
    """Median distance from the median, unscaled."""
    if not len(values):
        return 0.0
    x = np.asarray(values, float)
    return float(np.median(np.abs(x - np.median(x))))


def concentration(values: Sequence[float], top_n: int = 3) -> dict | None:
    """What grouping.concentration gives, for values of few groups; None without a positive total."""
    v = sorted((max(x, 0.0) for x in values), reverse=True)
    k, total = len(v), sum(v)
    if total <= 0:
        return None
    top_n = min(top_n, max(k - 1, 1))
    top, hhi = sum(v[:top_n]) / total, sum((x / total) ** 2 for x in v)
    return {"groups": k, "top_n": top_n, "top_share": top * 100, "hhi": hhi, "hhi_normalised": (hhi - 1 / k) / (1 - 1 / k) if k > 1 else 1.0, "baseline": top_n / k * 100, "multiple": top / (top_n / k)}


def pct_change(new: float | None, old: float | None) -> float | None:
    """Change against the size of old, in percent; None where old is (almost) nothing."""
    if new is None or old is None or abs(old) < 1e-12:
        return None
    return (new - old) / abs(old) * 100


def incomplete_beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(1 - x, b, a)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for part in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + part * d
            c = 1 + part / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def t_p_value(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    if df <= 0 or not isfinite(t):
        return 0.0 if df > 0 else 1.0
    return incomplete_beta(df / (df + t * t), df / 2, 0.5)


def f_p_value(f: float, d1: float, d2: float) -> float:
    """Upper-tail p of F."""
    if d1 <= 0 or d2 <= 0 or f <= 0:
        return 1.0
    return incomplete_beta(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if isfinite(f) else 0.0


def r_p_value(r: float, n: int) -> float:
    """Two-sided p of a correlation of n pairs."""
    if n < 3:
        return 1.0
    return 0.0 if abs(r) >= 1 else t_p_value(r * sqrt((n - 2) / (1 - r * r)), n - 2)


class Line(NamedTuple):
    slope: float
    intercept: float
    r2: float
    residual_std: float
    p_value: float


def linear_fit(y: Sequence[float]) -> Line:
    """Least squares of y on 0, 1, 2, ..."""
    v = np.asarray(y, float)
    n = len(v)
    x = np.arange(n) - (n - 1) / 2
    sxx, centred = float((x * x).sum()), v - v.mean()
    slope = float((x * centred).sum() / sxx) if sxx else 0.0
    residual = centred - slope * x
    sse, syy = float((residual**2).sum()), float((centred**2).sum())
    spread = sqrt(sse / (n - 2)) if n > 2 else 0.0
    r2 = max(0.0, 1 - sse / syy) if syy > 0 else 0.0
    if n <= 2 or sxx == 0:
        p = 1.0
    elif spread < 1e-12 * max(1.0, float(np.abs(v).max())):
        p = 0.0 if slope else 1.0
    else:
        p = t_p_value(slope / (spread / sqrt(sxx)), n - 2)
    return Line(slope, float(v.mean() - slope * (n - 1) / 2) if n else 0.0, r2, spread, p)


def mann_kendall(y: Sequence[float]) -> float:
    """Kendall's tau of y against its order."""
    v = np.asarray(y, float)
    n = len(v)
    return float(np.sign(v[None, :] - v[:, None])[np.triu_indices(n, 1)].sum() / (n * (n - 1) / 2)) if n > 1 else 0.0


def anova_f(values: Sequence[float], groups: Sequence[int]) -> tuple[float, float]:
    """One-way F and its p; groups with one value carry no spread."""
    v, g = np.asarray(values, float), np.asarray(groups)
    names = np.unique(g)
    k, n = len(names), len(v)
    if k < 2 or n <= k:
        return 0.0, 1.0
    between = sum((g == x).sum() * (v[g == x].mean() - v.mean()) ** 2 for x in names)
    within = sum(((v[g == x] - v[g == x].mean()) ** 2).sum() for x in names)
    if within <= 1e-300:
        return (float("inf"), 0.0) if between > 0 else (0.0, 1.0)
    f = float((between / (k - 1)) / (within / (n - k)))
    return f, f_p_value(f, k - 1, n - k)
