"""Tail probabilities of test statistics: a few numbers per report."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return value


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    if math.isnan(t):
        return float("nan")
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def t_quantile(p: float, df: float) -> float:
    """The t below which a share ``p`` (0.5 or more) of the distribution lies."""
    low, high = 0.0, 1.0
    while 1 - t_two_sided(high, df) / 2 < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        if 1 - t_two_sided(middle, df) / 2 < p:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def f_upper(f: float, df1: float, df2: float) -> float:
    if math.isnan(f):
        return float("nan")
    return beta_cdf(df2 / (df2 + df1 * f), df2 / 2, df1 / 2)


def chi2_two_df_upper(x: float) -> float:
    return math.exp(-x / 2)


def skew_z(skew: float, n: int) -> float:
    """D'Agostino's normal score of a sample skewness."""
    y = skew * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3)
             / ((n - 2) * (n + 5) * (n + 7) * (n + 9)))
    w2 = math.sqrt(2 * (beta2 - 1)) - 1
    alpha = math.sqrt(2 / (w2 - 1))
    return math.asinh(y / alpha) / math.sqrt(0.5 * math.log(w2))


def kurtosis_z(kurtosis: float, n: int) -> float:
    """Anscombe and Glynn's normal score of a sample kurtosis."""
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (kurtosis - mean) / math.sqrt(var)
    beta1 = (6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
             * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))))
    a = 6 + 8 / beta1 * (2 / beta1 + math.sqrt(1 + 4 / beta1 ** 2))
    ratio = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
    root = math.copysign(abs(ratio) ** (1 / 3), ratio)
    return (1 - 2 / (9 * a) - root) / math.sqrt(2 / (9 * a))
