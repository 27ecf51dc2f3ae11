"""Quantiles of Student's t, from the incomplete beta function."""

from __future__ import annotations

import math

EPSILON = 1e-16


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated from the front; converges fast for x < (a + 1) / (a + b + 2)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            c = 1.0 + step / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < EPSILON * 8:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _fraction(a, b, x) / a
    return 1.0 - front * _fraction(b, a, 1.0 - x) / b


def t_share(t: float, freedom: float) -> float:
    """Share of Student's t with ``freedom`` degrees that lies below ``t``."""
    tail = incomplete_beta(freedom / 2.0, 0.5, freedom / (freedom + t * t)) / 2.0
    return 1.0 - tail if t > 0 else tail


def t_quantile(share: float, freedom: float) -> float:
    """Value below which ``share`` of Student's t with ``freedom`` degrees lies, by halving."""
    if not 0.0 < share < 1.0 or freedom <= 0:
        raise ValueError("a share between 0 and 1 and positive degrees of freedom are needed")
    if share < 0.5:
        return -t_quantile(1.0 - share, freedom)
    low, high = 0.0, 1.0
    while t_share(high, freedom) < share:
        low, high = high, high * 2.0
    while (middle := (low + high) / 2.0) not in (low, high):
        if t_share(middle, freedom) < share:
            low = middle
        else:
            high = middle
    return high
