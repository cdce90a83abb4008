"""Tail probabilities of the t and F distributions, for the few rows a fitted model has."""

from __future__ import annotations

import math


# From here on Stirling's series gives differences of log gamma values without cancellation.
LARGE = 100.0
MOST_STEPS = 10_000


def _stirling_rest(z: float) -> float:
    return (1.0 / 12.0 - (1.0 / 360.0 - 1.0 / (1260.0 * z * z)) / (z * z)) / z


def _log_gamma_step(a: float, b: float) -> float:
    """lgamma(a + b) - lgamma(a)."""
    if a < LARGE:
        return math.lgamma(a + b) - math.lgamma(a)
    return (a - 0.5) * math.log1p(b / a) + b * math.log(a + b) - b + _stirling_rest(a + b) - _stirling_rest(a)


def _log(x: float, rest: float) -> float:
    """log(x), given ``rest`` = 1 - x."""
    return math.log(x) if x < 0.5 else math.log1p(-rest)


def gamma_upper(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0.0:
        return 1.0
    front = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1.0:
        term = total = 1.0 / s
        for m in range(1, MOST_STEPS):
            term *= x / (s + m)
            total += term
            if term < total * 1e-17:
                return 1.0 - front * total
        raise ArithmeticError(f"no convergence at s={s}, x={x}")
    low = x + 1.0 - s
    c, d = 1e300, 1.0 / low
    total = d
    for m in range(1, MOST_STEPS):
        low += 2.0
        d = 1.0 / (low - m * (m - s) * d)
        c = low - m * (m - s) / c
        total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return front * total
    raise ArithmeticError(f"no convergence at s={s}, x={x}")


def beta_share(a: float, b: float, x: float, rest: float | None = None) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz).

    ``rest`` is 1 - x, for callers that know it more exactly. Where ``a`` dwarfs ``b`` the gamma limit is used; its
    error is of the order b^3 / a^2 and stays below 1e-12.
    """
    rest = 1.0 - x if rest is None else rest
    if x <= 0.0:
        return 0.0
    if rest <= 0.0:
        return 1.0
    if max(b, 1.0) ** 3 <= 1e-12 * a * a:
        return gamma_upper(b, -(a + (b - 1.0) / 2.0) * _log(x, rest))
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_share(b, a, rest, x)
    smaller, larger = sorted((a, b))
    step = _log_gamma_step(larger, smaller) - math.lgamma(smaller)
    front = math.exp(step + a * _log(x, rest) + b * _log(rest, x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, MOST_STEPS):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            total *= step
        if abs(step - 1.0) < 1e-15:
            return front * total
    raise ArithmeticError(f"no convergence at a={a}, b={b}, x={x}")


def t_two_sided(t: float, df: float) -> float:
    return beta_share(df / 2.0, 0.5, df / (df + t * t), t * t / (df + t * t))


def f_upper(f: float, df1: float, df2: float) -> float:
    whole = df2 + df1 * f
    return beta_share(df2 / 2.0, df1 / 2.0, df2 / whole, df1 * f / whole)


def t_quantile(level: float, df: float) -> float:
    """t with ``level`` of the mass within [-t, t], by bisection."""
    low, high = 0.0, 1.0
    while 1.0 - t_two_sided(high, df) < level:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if 1.0 - t_two_sided(middle, df) < level:
            low = middle
        else:
            high = middle
        if high - low <= 1e-15 * high:
            break
    return (low + high) / 2.0
