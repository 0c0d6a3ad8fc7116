"""Tail functions and logarithms of them, with numpy and the standard library only."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np



def lgamma(x: np.ndarray) -> np.ndarray:
    """ln gamma of positive numbers: the recurrence up to 10, then Stirling's series."""
    x = np.array(x, float)
    shift = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        if not low.any():
            break
        shift = shift + np.where(low, np.log(np.where(low, x, 1.0)), 0.0)
        x = np.where(low, x + 1, x)
    r = 1 / (x * x)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - shift


def log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0)


def log_sum(x: np.ndarray) -> float:
    m = x.max(initial=-np.inf)
    return float(m + math.log(np.exp(x - m).sum())) if np.isfinite(m) else -math.inf


def _telling(k: int, hi: int, mode: int, sd: float) -> np.ndarray:
    """Of the values k to hi, those whose terms show in a sum of doubles: the terms fall off on both sides of the mode."""
    reach = int(12 * sd) + 60
    return np.arange(max(k, mode - reach), min(hi, max(k, mode) + reach) + 1, dtype=float)


def log_hypergeom_tail(k: int, total: int, marked: int, drawn: int) -> float:
    """ln P(X >= k) for X marked items among `drawn` of `total`."""
    lo, hi = max(0, drawn - (total - marked)), min(marked, drawn)
    if k <= lo:
        return 0.0
    if k > hi:
        return -math.inf
    share = marked / total
    x = _telling(k, hi, (drawn + 1) * (marked + 1) // (total + 2), math.sqrt(drawn * share * (1 - share) * (total - drawn) / max(1, total - 1)))
    return min(0.0, log_sum(log_choose(np.float64(marked), x) + log_choose(np.float64(total - marked), drawn - x) - log_choose(np.float64(total), np.float64(drawn))))


def hypergeom_sf(k: int, total: int, marked: int, drawn: int) -> float:
    """P(X >= k); nan where the numbers are impossible."""
    if not 0 <= marked <= total or not 0 <= drawn <= total or k > min(marked, drawn):
        return math.nan
    return math.exp(log_hypergeom_tail(int(k), int(total), int(marked), int(drawn)))


def hypergeom_tails(k: np.ndarray, total: np.ndarray, marked: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(X >= k), P(X <= k - 1)) of arrays; nan where the numbers are impossible.

    All rows go on together: from the term at k upwards beyond the mode, from that at k - 1 downwards below it, each next
    term by its ratio to the last, until none of them shows in its sum. The other tail is what is left to one.
    """
    k, total, marked, drawn = (np.array(x, float) for x in np.broadcast_arrays(k, total, marked, drawn))
    lo, hi = np.maximum(0.0, drawn - (total - marked)), np.minimum(marked, drawn)
    bad = (marked < 0) | (marked > total) | (drawn < 0) | (drawn > total) | (k > hi)
    up = k > np.floor((drawn + 1) * (marked + 1) / (total + 2))
    x = np.where(up, k, k - 1)
    sums = np.zeros(len(k))
    at = np.flatnonzero(~bad & (x >= lo) & (x <= hi))
    x, K, n, N, up_at = x[at], marked[at], drawn[at], total[at], up[at]
    term = np.exp(log_choose(K, x) + log_choose(N - K, n - x) - log_choose(N, n))
    own = term.copy()
    # of a term that is zero as a double, the tail away from the mode is too
    live = np.flatnonzero(term > 0)
    while len(live):
        y, a, b, c = x[live], K[live], n[live], N[live]
        ratio = np.where(up_at[live], (a - y) * (b - y) / ((y + 1) * (c - a - b + y + 1)), y * (c - a - b + y) / np.maximum((a - y + 1) * (b - y + 1), 1e-300))
        term[live] *= ratio
        own[live] += term[live]
        x[live] += np.where(up_at[live], 1, -1)
        live = live[term[live] > own[live] * 1e-17]
    sums[at] = np.minimum(own, 1.0)
    upper, lower = np.where(up, sums, 1 - sums), np.where(up, 1 - sums, sums)
    return np.where(bad, math.nan, upper), np.where(bad, math.nan, lower)


def binom_sf(k: int, n: int, p: float) -> float:
    """P(X >= k)."""
    if k <= 0:
        return 1.0
    if k > n or p <= 0:
        return 0.0
    if p >= 1:
        return 1.0
    x = _telling(k, n, int((n + 1) * p), math.sqrt(n * p * (1 - p)))
    return min(1.0, math.exp(log_sum(log_choose(np.float64(n), x) + x * math.log(p) + (n - x) * math.log1p(-p))))


def binom_two_sided(k: int, n: int, p: float, cap: bool = False) -> float:
    """Twice the smaller of P(X >= k) and P(X <= k-1); may exceed one unless capped."""
    upper = binom_sf(k, n, p)
    out = 2 * min(upper, 1 - upper)
    return min(1.0, out) if cap else out


def gammainc_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x): series below a + 1, continued fraction beyond."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h * scale


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gammainc_upper(df / 2, x / 2)


def norm_sf(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def t_sf(t: float, df: float) -> float:
    tail = betainc(df / 2, 0.5, df / (df + t * t)) / 2
    return tail if t >= 0 else 1 - tail


def f_sf(x: float, d1: float, d2: float) -> float:
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def chi2_isf_1(p: float) -> float:
    """Square of the normal quantile of p/2."""
    return NormalDist().inv_cdf(p / 2) ** 2 if 0 < p < 1 else (0.0 if p >= 1 else math.inf)
