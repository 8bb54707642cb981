"""Distribution functions of whole numpy arrays, for tails and quantiles of unbounded tables."""

from __future__ import annotations

import math

import numpy as np

#: Coefficients of the rational approximations of the normal quantile (algorithm AS 241, double precision), lowest power first.
CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _ratio(x: np.ndarray, tables) -> np.ndarray:
    top, bottom = (np.polynomial.polynomial.polyval(x, t) for t in tables)
    return top / bottom


def normal_quantile(p: np.ndarray, mean: float = 0.0, sd: float = 1.0) -> np.ndarray:
    """Infinite at 0 and 1, NaN outside."""
    p = np.asarray(p, float)
    q = p - 0.5
    small = np.minimum(p, 1 - p)
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.sqrt(-np.log(np.where(small > 0, small, np.nan)))
        far = np.where(r <= 5, _ratio(r - 1.6, MIDDLE), _ratio(r - 5, TAIL))
    z = np.where(np.abs(q) <= 0.425, q * _ratio(0.180625 - q * q, CENTRE), np.copysign(far, q))
    z = np.where(p == 0, -np.inf, np.where(p == 1, np.inf, z))
    return mean + sd * z


def beta_cdf(x: np.ndarray, a: float | np.ndarray, b: float | np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function of each x; a and b: numbers, or one for each x."""
    x = np.asarray(x, float)
    y = np.clip(np.nan_to_num(x, nan=0.5), 0.0, 1.0)
    turned = y > (a + 1) / (a + b + 2)
    part = _beta_part(np.where(turned, 1 - y, y), np.where(turned, b, a), np.where(turned, a, b))
    return np.where(np.isnan(x), np.nan, np.where(turned, 1 - part, part))


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with beta_cdf(x, a, b) = p for each a and b: Newton steps, halved intervals where those leave the bracket."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    low, high, x = np.zeros(len(a)), np.ones(len(a)), a / (a + b)
    front = _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b)
    left = np.arange(len(a))
    for _ in range(200):
        if not len(left):
            break
        at, u, w = x[left], a[left], b[left]
        miss = beta_cdf(at, u, w) - p
        high[left], low[left] = np.where(miss >= 0, at, high[left]), np.where(miss < 0, at, low[left])
        with np.errstate(all="ignore"):
            new = at - miss / np.exp(front[left] + (u - 1) * np.log(at) + (w - 1) * np.log1p(-at))
        new = np.where((new > low[left]) & (new < high[left]), new, (low[left] + high[left]) / 2)
        x[left] = new
        left = left[np.abs(new - at) > 1e-9 * at]
    return x


_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def _beta_part(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    inside = (x > 0) & (x < 1)
    z = np.where(inside, x, 0.5)
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(z) + b * np.log1p(-z)) / a
    tiny = 1e-300
    away = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    c, d = np.ones_like(z), 1 / away(1.0 - (a + b) * z / (a + 1))
    f = d.copy()
    for m in range(1, 2000 + int(4 * math.sqrt(np.max(a + b, initial=0)))):
        for top in (m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / away(1 + top * d), away(1 + top / c)
            f *= c * d
        if (np.abs(c * d - 1) < 1e-15).all():
            break
    return np.where(inside, front * f, (x >= 1).astype(float))


def t_two_sided(x: np.ndarray, df: float) -> np.ndarray:
    """P(|T| > |x|)"""
    x = np.asarray(x, float)
    return beta_cdf(df / (df + x * x), df / 2, 0.5)
