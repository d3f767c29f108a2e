"""Small distribution functions for the driver."""

from __future__ import annotations

import math
from statistics import NormalDist


def beta_cdf(x: float, a: int, b: int) -> float:
    """Regularised incomplete beta for whole a and b: the upper tail of a binomial."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    n = a + b - 1
    log = lambda j: math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(x) + (n - j) * math.log1p(-x)
    return min(1.0, math.fsum(math.exp(log(j)) for j in range(a, n + 1)))


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of chi-square, by series or continued fraction of the incomplete gamma."""
    if x <= 0:
        return 1.0
    a, z = df / 2, x / 2
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - scale * total)
    b, c = z + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b)
        c = b + k / c
        h *= (step := d * c)
        if abs(step - 1) < 1e-15:
            break
    return scale * h


def budget(alpha: float, kind: str | int) -> int:
    """Permutations for a level: minimum, auto or maximum, or a number."""
    if isinstance(kind, int):
        return kind
    least = math.ceil(1 / alpha)
    if kind == "minimum":
        return least
    if kind == "maximum":
        return math.ceil(1 / (4 * alpha * alpha))
    z = NormalDist().inv_cdf(1 - alpha)
    return max(least, math.ceil(z * z * (1 - alpha) / alpha))


def stop_bounds(alpha: float, gamma: float, most: int, every: int = 1) -> list[tuple[int, int, int]]:
    """(m, low, high): an adaptive test stops after m permutations with at most ``low`` or at least ``high`` exceedances.

    ``low`` is -1 where no number of exceedances makes significance sure.  The posterior falls as exceedances rise, so both bounds rise with m.
    """
    least, rows, low, high = math.ceil(1 / alpha), [], -1, 0
    for m in range(least, most + 1):
        if m % every and m != most:
            continue
        while low < m and beta_cdf(alpha, 2 + low, m - low) >= gamma:
            low += 1
        while high <= m and beta_cdf(alpha, 1 + high, 1 + m - high) > 1 - gamma:
            high += 1
        rows.append((m, low, high))
    return rows


def stop_table(alpha: float, gamma: float, most: int, every: int = 1) -> list[tuple[int, int, bool]]:
    """(m, exceedances, stop) rows where an adaptive test stops after m permutations."""
    return [(m, c, True) for m, low, high in stop_bounds(alpha, gamma, most, every) for c in range(m + 1) if c <= low or c >= high]


def normal_sf(z: float) -> float:
    """Upper tail of the standard normal distribution."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def wilcoxon_p(counts: list[int], w_plus: float) -> float:
    """Two-sided exact p-value of a signed-rank sum, from the doubled ranks of the differences (whole numbers even with ties)."""
    ways = {0: 1}
    for r in counts:
        after = dict(ways)
        for s, n in ways.items():
            after[s + r] = after.get(s + r, 0) + n
        ways = after
    total, w = sum(ways.values()), round(2 * w_plus)
    low, high = sum(n for s, n in ways.items() if s <= w), sum(n for s, n in ways.items() if s >= w)
    return min(1.0, 2 * min(low, high) / total)


def t_cdf(t: float, df: int) -> float:
    """Student's distribution function, by Simpson's rule on the angle atan(t / sqrt(df))."""
    end = math.atan(abs(t) / math.sqrt(df))
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    steps = 2000
    h = end / steps
    area = sum((1 if i in (0, steps) else 4 if i % 2 else 2) * math.cos(i * h) ** (df - 1) for i in range(steps + 1)) * h / 3
    half = min(0.5, scale * area)
    return 0.5 + half if t >= 0 else 0.5 - half


def t_quantile(p: float, df: int) -> float:
    low, high = -1e3, 1e3
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_cdf(middle, df) < p else (low, middle)
    return (low + high) / 2
