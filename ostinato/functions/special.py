"""Tail probabilities that Spark SQL has no function for (numpy and stdlib only)."""

from __future__ import annotations

import math

import numpy as np


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for coefficient in (even, odd):
            d = 1.0 + coefficient * d
            c = 1.0 + coefficient / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            step = c * d
            value *= step
        if abs(step - 1.0) < 1e-15:
            break
    return value


def regularized_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def f_survival(f: float, dfn: float, dfd: float) -> float:
    """P(F > f) for dfn, dfd degrees of freedom."""
    if math.isnan(f):
        return math.nan
    if f <= 0.0:
        return 1.0
    if math.isinf(f):
        return 0.0
    return regularized_beta(dfd / 2.0, dfn / 2.0, dfd / (dfd + dfn * f))


def two_sided_normal(z: np.ndarray) -> np.ndarray:
    """2 * P(Z > z), element by element."""
    return np.array([math.erfc(v / math.sqrt(2.0)) for v in np.ravel(z)]).reshape(np.shape(z))
