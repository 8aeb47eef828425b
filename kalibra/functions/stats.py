"""Scalar statistics for results of a few rows: distributions that Spark has no built-in functions for."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


def normal_cdf(x: float) -> float:
    return _NORMAL.cdf(x)


def normal_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def t_cdf(t: float, df: float) -> float:
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    tail = (front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b) / 2
    return 1 - tail if t > 0 else tail if t < 0 else 0.5


def t_ppf(p: float, df: float) -> float:
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def simplex_weights(cov: np.ndarray) -> np.ndarray:
    """Non-negative weights of sum 1 with least variance: the unconstrained optimum, its most negative entry taken out until none is."""
    held = list(range(len(cov)))
    while True:
        x = np.linalg.lstsq(cov[np.ix_(held, held)], np.ones(len(held)), rcond=None)[0]
        x = x / x.sum() if abs(x.sum()) > 1e-300 else np.full(len(held), 1 / len(held))
        if len(held) == 1 or x.min() >= 0:
            out = np.zeros(len(cov))
            out[held] = np.maximum(x, 0) / np.maximum(x, 0).sum()
            return out
        held.pop(int(x.argmin()))


#: Fixed value: Kendall's p is counted out for so many pairs at most (where nothing is tied), and for one pair out of order in any number.
KENDALL_EXACT = 33


def kendall_exact(n: int, discordant: int) -> float | None:
    """The two-sided p of Kendall's tau for n rows without ties, of which so many pairs are out of order: the share of all orders
    that are at least as far from the middle. None where the normal approximation serves."""
    pairs = n * (n - 1) // 2
    c = min(discordant, pairs - discordant)
    if n > KENDALL_EXACT and c > 1:
        return None
    if 4 * c == 2 * pairs or n < 2:
        return 1.0
    ways = [1] + [0] * c  # orders of one row, by pairs out of order; the k-th row adds 0 to k - 1
    for k in range(2, n + 1):
        run = 0
        fresh = []
        for i in range(c + 1):
            run += ways[i] - (ways[i - k] if i >= k else 0)
            fresh.append(run)
        ways = fresh
        if c <= 1 and k > 2:  # 1 and k - 1 ways, whatever the rest
            ways = [1, n - 1][: c + 1]
            break
    return min(1.0, 2 * sum(ways) / math.factorial(n)) if n <= 170 else 0.0
