"""Tail probabilities of a few distributions: small numeric helpers for pandas UDFs."""

from __future__ import annotations

import math
from statistics import NormalDist


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: a series for small x, a continued fraction beyond."""
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
        return min(1.0, total * front)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = step * d + b
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + step / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return max(0.0, 1 - front * h)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + step / c
            c = c if abs(c) > 1e-300 else 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def beta_quantile(a: float, b: float, p: float) -> float:
    """Where the incomplete beta function reaches ``p``, by bisection."""
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        if beta_i(a, b, mid) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def poisson_two_sided(x: int, mean: float) -> float:
    """Twice the smaller tail, 1 at most; 1 where nothing is expected."""
    if mean <= 0:
        return 1.0
    at_most = 1 - gamma_p(x + 1, mean)
    at_least = gamma_p(x, mean) if x > 0 else 1.0
    return min(1.0, 2 * min(at_most, at_least))


def binomial_two_sided(k: int, n: int, p: float) -> float:
    """Sum of the probabilities of all outcomes that are no likelier than ``k`` (to a relative 1e-7)."""
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    limit = math.exp(log(k)) * (1 + 1e-7)
    # the outcomes rise to the mode and fall after it, so each side has one border
    mode = min(n, int((n + 1) * p))

    def border(low: int, high: int, falling: bool) -> int:
        while low < high:
            mid = (low + high) // 2
            if (math.exp(log(mid)) <= limit) == falling:
                high = mid
            else:
                low = mid + 1
        return low

    left = border(0, mode, False) if math.exp(log(mode)) > limit else mode + 1
    right = border(mode, n + 1, True) if math.exp(log(mode)) > limit else mode + 1
    lower = 1 - beta_i(left, n - left + 1, p) if 0 < left <= n else (0.0 if left <= 0 else 1.0)
    upper = beta_i(right, n - right + 1, p) if 0 < right <= n else (0.0 if right > n else 1.0)
    return min(1.0, lower + upper)


def clopper_pearson(k: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    """Exact interval of a binomial share."""
    tail = (1 - confidence) / 2
    return (0.0 if k == 0 else beta_quantile(k, n - k + 1, tail)), (1.0 if k == n else beta_quantile(k + 1, n - k, 1 - tail))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def chi_square_tail(x: float, freedom: int) -> float:
    return 1 - gamma_p(freedom / 2, x / 2)
