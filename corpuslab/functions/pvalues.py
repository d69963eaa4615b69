"""Tail probabilities, in plain arithmetic, and the column functions made of them.

The columns are for result tables: a row for each test, not for each observation.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def chi2_sf(x: float, df: int) -> float:
    """P(chi-squared with df degrees of freedom > x), by the finite sums for whole df."""
    if x <= 0:
        return 1.0
    if df % 2:
        p, term = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
        for k in range(3, df + 1, 2):
            p += term
            term *= x / k
        return min(1.0, p)
    p = term = math.exp(-x / 2)
    for k in range(2, df, 2):
        term *= x / k
        p += term
    return min(1.0, p)


def beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    total = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or 1e-300)
            c = 1 + step / c or 1e-300
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else beta_fraction(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def t_two_sided(t: float, df: float) -> float:
    return beta_fraction(df / 2, 0.5, df / (df + t * t))


def norm_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def ks_p(d: float, n: int, m: int) -> float:
    """Two-sample Kolmogorov-Smirnov: counted exactly over lattice paths up to n * m = 10000, else the limiting series."""
    if n * m <= 10_000:
        far = round(d * n * m)
        below = [0.0] * (m + 1)
        for i in range(n + 1):
            row = [0.0] * (m + 1)
            for j in range(m + 1):
                if abs(i * m - j * n) < far:
                    row[j] = 1.0 if i == j == 0 else (below[j] * i + (row[j - 1] * j if j else 0.0)) / (i + j)
            below = row
        return max(0.0, min(1.0, 1 - below[m]))
    z = d * math.sqrt(n * m / (n + m))
    if z < 0.2:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101))))


def wilcoxon_p(w: float, n: int, ties: float) -> float:
    """Two-sided, of the lesser rank sum w of n differences: exact for n <= 50 without ties, else normal with the tie term sum(t^3 - t)."""
    if n == 0:
        return 1.0
    if n <= 50 and ties == 0 and w == int(w):
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    variance = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return norm_two_sided((w - n * (n + 1) / 4) / math.sqrt(variance)) if variance > 0 else 1.0


def binom_sf(k: int, n: int, p: float) -> float:
    """P(X >= k) of n draws, summed from k away from the mean until terms no longer count: some square roots of n terms."""
    if k <= 0:
        return 1.0
    if p <= 0 or p >= 1 or k > n:
        return 1.0 if p >= 1 and k <= n else 0.0
    odds = p / (1 - p)
    upper = k > n * p
    i = k if upper else k - 1  # the lower tail, up to k - 1, is summed where it is the lesser one
    first = math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    total = term = 1.0
    while term > 1e-18 * total and (i < n if upper else i > 0):
        term *= (n - i) / (i + 1) * odds if upper else i / (n - i + 1) / odds
        total += term
        i += 1 if upper else -1
    tail = min(1.0, math.exp(min(0.0, first + math.log(total))))
    return tail if upper else 1 - tail


def _column(f):
    """f as a column function; null where an argument is."""

    def column(*args: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in row) else f(*row) for row in zip(*args, strict=True)], dtype="float64")

    def one(a: pd.Series) -> pd.Series:
        return column(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return column(a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return column(a, b, c)

    return F.pandas_udf({1: one, 2: two, 3: three}[f.__code__.co_argcount], DoubleType())


chi2_p_column = _column(lambda x, df: chi2_sf(x, int(df)))
f_p_column = _column(lambda x, a, b: f_sf(x, a, b))
t_p_column = _column(lambda t, df: t_two_sided(t, df))
norm_p_column = _column(lambda z: norm_two_sided(z))
ks_p_column = _column(lambda d, n, m: ks_p(d, int(n), int(m)))
wilcoxon_p_column = _column(lambda w, n, t: wilcoxon_p(w, int(n), t))
binom_p_column = _column(lambda k, n, p: binom_sf(int(k), int(n), p))
