"""Tail probabilities and quantiles of the t, F and chi-squared distributions, from the regularised incomplete beta and gamma functions."""

from __future__ import annotations

import math

_TINY, _EPS, _STEPS = 1e-300, 1e-16, 100_000


def _continued(terms, start: float) -> float:
    """Modified Lentz evaluation of start + a1/(b1 + a2/(b2 + ...))."""
    f = start or _TINY
    c, d = f, 0.0
    for a, b in terms:
        d = b + a * d or _TINY
        c = b + a / c or _TINY
        d = 1 / d
        f *= c * d
        if abs(c * d - 1) < _EPS:
            break
    return f


def beta_inc(a: float, b: float, x: float) -> float:
    """I_x(a, b)."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)

    def terms():
        yield 1.0, 1.0
        for m in range(1, _STEPS):
            k = m // 2
            top = k * (b - k) * x if m % 2 == 0 else -(a + k) * (a + b + k) * x
            yield top / ((a + 2 * k - 1) * (a + 2 * k) if m % 2 == 0 else (a + 2 * k) * (a + 2 * k + 1)), 1.0

    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    return front / a * _continued(terms(), 0.0)


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * _EPS:
            k += 1
            term *= x / k
            total += term
        return 1 - front * total

    def terms():
        yield 1.0, x + 1 - a
        for k in range(1, _STEPS):
            yield -k * (k - a), x + 2 * k + 1 - a

    return front * _continued(terms(), 0.0)


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def f_sf(x: float, d1: float, d2: float) -> float:
    if math.isnan(x):
        return math.nan
    return 0.0 if math.isinf(x) else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def t_cdf(x: float, df: float) -> float:
    tail = beta_inc(df / 2, 0.5, df / (df + x * x)) / 2
    return 1 - tail if x > 0 else tail


def t_quantile(p: float, df: float) -> float:
    """The value under which a t variable lies with probability p; NaN if df is not positive."""
    if df <= 0 or not 0 < p < 1:
        return math.nan
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 1.0
    while t_cdf(high, df) < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if t_cdf(middle, df) < p else (low, middle)
    return (low + high) / 2
