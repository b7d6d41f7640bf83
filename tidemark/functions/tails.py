"""Tail probabilities and special functions in plain Python, for the few numbers a test ends with."""

from __future__ import annotations

import math

TINY = 1e-300


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution function, by bisection on a bracket that holds all doubles of use."""
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if normal_cdf(mid) < p else (low, mid)
    return (low + high) / 2


def _lentz(terms, first: float) -> float:
    """A continued fraction first + a1/(b1 + a2/(b2 + ...)) by the modified Lentz method."""
    f = first or TINY
    c, d = f, 0.0
    for a, b in terms:
        d = b + a * d
        d = 1 / (d if abs(d) > TINY else TINY)
        c = b + a / c
        c = c if abs(c) > TINY else TINY
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return f


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)

    def terms():
        yield 1.0, 1.0
        for m in range(1, 500):
            yield -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1)), 1.0
            yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    return front * _lentz(terms(), 0.0)


def gamma_upper(s: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < s + 1:
        term = total = 1 / s
        for k in range(1, 2000):
            term *= x / (s + k)
            total += term
            if term < total * 1e-16:
                break
        return 1 - total * math.exp(-x + s * math.log(x) - math.lgamma(s))

    def terms():
        yield 1.0, x + 1 - s
        for k in range(1, 2000):
            yield -k * (k - s), x + 2 * k + 1 - s

    return math.exp(-x + s * math.log(x) - math.lgamma(s)) * _lentz(terms(), 0.0)


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """The quantile of Student's t for p above one half."""
    low, high = 0.0, 1.0
    while 1 - t_two_sided(high, df) / 2 < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def chi2_tail(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def kolmogorov_tail(d: float, n: int, m: int) -> float:
    """Two-sample KS p-value: exact by counting lattice paths up to 10,000 pairs, else the limit law with the usual
    small-sample correction."""
    if n * m <= 10_000:
        return _ks_exact(d, n, m)
    effective = n * m / (n + m)
    x = (math.sqrt(effective) + 0.12 + 0.11 / math.sqrt(effective)) * d
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def _ks_exact(d: float, n: int, m: int) -> float:
    """Share of the lattice paths from (0, 0) to (n, m) that leave the band |i/n - j/m| < d."""
    return 1.0 if d <= 0 else min(1.0, max(0.0, 1 - _band_share(n, m, d - 1e-12)))


def _band_share(n: int, m: int, limit: float) -> float:
    """The share of paths that stay within the band, counted exactly."""
    ways = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if abs(i / n - j / m) >= limit:
                continue
            ways[i][j] = 1 if i == j == 0 else (ways[i - 1][j] if i else 0) + (ways[i][j - 1] if j else 0)
    return ways[n][m] / math.comb(n + m, n)
