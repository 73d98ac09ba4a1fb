"""Tail probabilities of test statistics, one number per test result.

The sums behind a statistic come from Spark; these helpers turn the few resulting
numbers of each test into a p-value.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    out = d
    # About sqrt(max(a, b)) terms are enough.
    for m in range(1, 1000 + int(20 * math.sqrt(max(a, b)))):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + num / c
            c = c if abs(c) > 1e-300 else 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def gamma_sf(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * scale
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 2000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def f_sf(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2, x / 2)


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def studentized_range_sf(q: float, k: float, df: float) -> float:
    """P(range of k normals / independent sd > q), integrated on a grid."""
    if not q > 0:
        return 1.0
    z = np.linspace(-8.5, 8.5, 681)
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = np.array([1 - normal_sf(v) for v in z])

    def within(w):
        low = np.interp(z - w, z, cdf, left=0.0, right=1.0)
        return k * np.trapezoid(phi * (cdf - low) ** (k - 1), z)

    s = np.linspace(max(1e-4, 1 - 7 / math.sqrt(2 * df)), 1 + 7 / math.sqrt(2 * df), 241)
    # Density of the deviation up to a factor, which the division by its own integral takes out.
    logf = (df - 1) * np.log(s) - df * (s * s - 1) / 2
    weight = np.exp(logf - logf.max())
    total = np.trapezoid(weight * np.array([within(q * v) for v in s]), s) / np.trapezoid(weight, s)
    return float(min(1.0, max(0.0, 1 - total)))


def binomial_two_sided(k: int, n: int, p: float = 0.5) -> float:
    """Chance of a count as unlikely as ``k``: both tails by the incomplete beta function, at every n."""
    k, n = int(k), int(n)
    if n == 0:
        return 1.0

    def log_pmf(i):
        return math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)

    def below(i):
        """P(X <= i)"""
        return 0.0 if i < 0 else 1.0 if i >= n else beta_inc(n - i, i + 1, 1 - p)

    limit, mode = log_pmf(k) + 1e-7, int((n + 1) * p)
    if log_pmf(mode) <= limit:
        return 1.0
    # First count past the mode, on the other side, that is as unlikely.
    if k < mode:
        lo, hi = mode, n + 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if log_pmf(mid) <= limit else (mid, hi)
        return min(1.0, below(k) + (1 - below(hi - 1) if 2 * p != 1 else below(k)))
    lo, hi = -1, mode
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if log_pmf(mid) <= limit else (lo, mid)
    upper = beta_inc(k, n - k + 1, p)
    return min(1.0, upper + (below(lo) if 2 * p != 1 else upper))


def beta_quantile(q: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_inc(a, b, mid) < q else (lo, mid)
    return (lo + hi) / 2


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    alpha = 1 - level
    return (0.0 if k == 0 else beta_quantile(alpha / 2, k, n - k + 1),
            1.0 if k == n else beta_quantile(1 - alpha / 2, k + 1, n - k))


def ks_p(d: float, n: int, m: int) -> float:
    """Two-sided two-sample p-value.

    The common library rule, kept: exact lattice paths while neither sample exceeds 10,000, else the
    one-sample law at the rounded effective size (here by its series with the small-sample terms).
    """
    n, m = int(n), int(m)
    if max(n, m) > 10_000:
        size = round(n * m / (n + m))
        root = math.sqrt(size)
        t = root * d + 1 / (6 * root) + (root * d - 1) / (4 * size)
        if t < 0.2:
            return 1.0
        return float(min(1.0, max(0.0, 2 * sum((-1) ** (i - 1) * math.exp(-2 * i * i * t * t) for i in range(1, 101)))))
    # Share of lattice paths that stay inside |i/n - j/m| < d, by anti-diagonals; only the band inside is kept.
    reach = d * n * m - 0.5
    prob, first = np.array([1.0]), 0
    for step in range(1, n + m + 1):
        lo = max(0, step - m, math.floor((step * n - reach) / (n + m)) + 1)
        hi = min(n, step, math.ceil((step * n + reach) / (n + m)) - 1)
        if hi < lo:
            return 1.0
        i = np.arange(lo, hi + 1)
        held = np.zeros(hi - lo + 3)  # of counts lo - 1 to hi + 1
        a, b = max(lo - 1, first), min(hi + 1, first + len(prob) - 1)
        if a <= b:
            held[a - lo + 1: b - lo + 2] = prob[a - first: b - first + 1]
        prob, first = held[:-2] * i / step + held[1:-1] * (step - i) / step, lo
    return float(min(1.0, max(0.0, 1 - prob[n - first])))


def mann_whitney_p(u: float, n: int, m: int, ties: float) -> float:
    """Two-sided p-value.

    The common library rule, kept: exact while the smaller sample has at most 8 rows and nothing
    ties, else normal with continuity. Exact counts come from the Gaussian binomial coefficient.
    """
    n, m = int(n), int(m)
    top = max(u, n * m - u)
    if ties == 0 and min(n, m) <= 8:
        least = int(round(n * m - top))
        counts = np.zeros(least + 1)
        counts[0] = 1.0
        for i in range(1, min(n, m) + 1):
            for start in range(min(i, least + 1)):  # divided by 1 - q^i
                counts[start::i] = np.cumsum(counts[start::i])
            away = max(n, m) + i  # times 1 - q^(larger + i)
            if away <= least:
                counts[away:] = counts[away:] - counts[:-away].copy()
        return float(min(1.0, 2 * counts.sum() / math.comb(n + m, n)))
    total = n + m
    var = n * m / 12 * (total + 1 - ties / (total * (total - 1)))
    if var <= 0:
        return 1.0
    z = (top - n * m / 2 - 0.5) / math.sqrt(var)
    return min(1.0, 2 * normal_sf(z))


def wilcoxon_p(w_plus: float, n: int, ties: float, zeros: int) -> float:
    """Two-sided signed-rank p-value; the common library rule, kept: exact up to 50 without ties or zeros, else normal."""
    n = int(n)
    if n == 0:
        return float("nan")
    if n <= 50 and ties == 0 and zeros == 0:
        counts = np.array([1.0])
        for i in range(1, n + 1):
            out = np.zeros(len(counts) + i)
            out[:len(counts)] += counts
            out[i:] += counts
            counts = out / 2
        w = int(round(min(w_plus, n * (n + 1) / 2 - w_plus)))
        return float(min(1.0, 2 * counts[:w + 1].sum()))
    sd = math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    return 1.0 if sd == 0 else min(1.0, 2 * normal_sf(abs(w_plus - n * (n + 1) / 4) / sd))


def p_value(function, *columns):
    """Column of p-values, one small call per test row; null where an input is null."""

    @F.pandas_udf("double")
    def run(frame: pd.DataFrame) -> pd.Series:
        def one(args):
            return None if any(v is None or v != v for v in args) else float(function(*args))
        return pd.Series([one(a) for a in frame.itertuples(index=False)], dtype="float64")

    return F.nanvl(run(F.struct(*[F.col(c).cast("double").alias(f"a{i}") for i, c in enumerate(columns)])), F.lit(None))
