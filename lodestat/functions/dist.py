"""Distribution functions in plain Python, usable on the driver and inside UDFs.

Tails come from the regularised incomplete beta and gamma functions (continued fractions and series); quantiles by bisection on the
monotone CDF, so they need no starting value.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

_NORMAL = NormalDist()


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_upper(x: float) -> float:
    """P(Z > x), accurate in the far tail."""
    return 0.5 * math.erfc(x / math.sqrt(2))


def normal_quantile(p: float, mean: float = 0.0, sd: float = 1.0) -> float:
    return mean + sd * _NORMAL.inv_cdf(p)


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Continued fraction, evaluated forwards with scaled convergents.
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 2000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def gamma_lower(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return front * total
    return 1.0 - _gamma_upper(a, x, front)


def _gamma_upper(a: float, x: float, front: float) -> float:
    b, c = x + 1 - a, 1e300
    d = 1 / b
    f = d
    for i in range(1, 2000):
        top = -i * (i - a)
        b += 2
        d, c = 1 / (top * d + b), b + top / c
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def chi2_upper(x: float, df: float) -> float:
    a, y = df / 2, x / 2
    if y <= 0:
        return 1.0
    if y < a + 1:
        return 1 - gamma_lower(a, y)
    return _gamma_upper(a, y, math.exp(a * math.log(y) - y - math.lgamma(a)))


def t_upper(x: float, df: float) -> float:
    """P(T > x)"""
    tail = 0.5 * beta_cdf(df / (df + x * x), df / 2, 0.5)
    return tail if x >= 0 else 1 - tail


def t_two_sided(x: float, df: float) -> float:
    return beta_cdf(df / (df + x * x), df / 2, 0.5)


def bisect(cdf: Callable[[float], float], p: float, lo: float, hi: float) -> float:
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def t_quantile(p: float, df: float) -> float:
    hi = 2.0
    while 1 - t_upper(hi, df) < max(p, 1 - p):
        hi *= 2
    return bisect(lambda x: 1 - t_upper(x, df), p, -hi, hi)


def chi2_quantile(p: float, df: float) -> float:
    hi = df + 10
    while 1 - chi2_upper(hi, df) < p:
        hi *= 2
    return bisect(lambda x: 1 - chi2_upper(x, df), p, 0.0, hi)


def beta_quantile(p: float, a: float, b: float) -> float:
    return bisect(lambda x: beta_cdf(x, a, b), p, 0.0, 1.0)
