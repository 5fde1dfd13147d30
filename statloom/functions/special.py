"""Distributions by incomplete beta and gamma functions, as column expressions and as numbers.

Series and continued fractions whose coefficients depend on the parameters alone run over a constant array, so that a column
costs no Python and no table. Each is as long as its terms are above rounding in the region where it is used.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-17


def _beta_fraction(a: float, b: float) -> list[float]:
    """Multiples of x in the continued fraction 1 / (1 + d1 x / (1 + d2 x / ...)), far end first; used up to x = (a + 1) / (a + b + 2)."""
    out: list[float] = []
    for m in range(60 + int(5 * math.sqrt(a + b))):
        if m:
            out.append(m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m)))
        out.append(-(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1)))
    return out[::-1]


def _gamma_terms(a: float) -> list[float]:
    """1 / ((a + 1) ... (a + n)), used up to x = a + 1."""
    out, size, n = [1.0], 1.0, 1
    while size > TINY:
        out.append(out[-1] / (a + n))
        size *= (a + 1) / (a + n)
        n += 1
    return out


def _log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def _horner(x: Column, terms: list[float]) -> Column:
    return F.aggregate(F.array(*[F.lit(t) for t in reversed(terms)]), F.lit(0.0), lambda s, t: s * x + t)


def betainc(a: float, b: float, x: Column) -> Column:
    """The regularized incomplete beta function; 0 and 1 outside (0, 1)."""

    def side(a: float, b: float, x: Column, y: Column) -> Column:
        below = F.aggregate(F.array(*[F.lit(d) for d in _beta_fraction(a, b)]), F.lit(1.0), lambda t, d: 1 + d * x / t)
        return F.exp(a * F.log(x) + b * F.log(y) - (_log_beta(a, b) + math.log(a))) / below

    lower = F.when(x <= (a + 1) / (a + b + 2), side(a, b, x, 1 - x)).otherwise(1 - side(b, a, 1 - x, x))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(lower)


def gammainc(a: float, x: Column) -> Column:
    """The regularized lower incomplete gamma function: a series up to a + 1, then a continued fraction from its far end."""
    scale = F.exp(a * F.log(x) - x - math.lgamma(a))
    series = scale / a * _horner(x, _gamma_terms(a))
    depth = 200 + int(20 * math.sqrt(a))
    steps = F.sequence(F.lit(depth), F.lit(1), F.lit(-1))
    fraction = F.aggregate(steps, x + (2.0 * depth + 1 - a), lambda t, n: x + 2.0 * n - 1 - a - n * (n - a) / t)
    return F.when(x <= 0, 0.0).when(x <= a + 1, series).otherwise(1 - scale / fraction)


def norm_cdf(x: Column) -> Column:
    half = 0.5 * gammainc(0.5, x * x / 2)
    return F.when(x < 0, 0.5 - half).otherwise(0.5 + half)


#: The rational approximations of Acklam for the normal quantile, centre and tails, numerators and denominators.
_PPF = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)


def norm_ppf(q: Column) -> Column:
    """The normal quantile: a rational approximation, then two steps of Halley's method on the distribution function."""

    def poly(x: Column, terms: tuple[float, ...]) -> Column:
        out = F.lit(terms[0])
        for t in terms[1:]:
            out = out * x + t
        return out

    def halley(x: Column) -> Column:
        e = (norm_cdf(x) - q) * math.sqrt(2 * math.pi) * F.exp(x * x / 2)
        return x - e / (1 + x * e / 2)

    c, r = q - 0.5, F.sqrt(-2 * F.log(F.least(q, 1 - q)))
    centre = poly(c * c, _PPF[0]) * c / poly(c * c, _PPF[1])
    tail = poly(r, _PPF[2]) / poly(r, _PPF[3])
    start = F.when(F.least(q, 1 - q) > 0.02425, centre).when(q < 0.5, tail).otherwise(-tail)
    # each step's value is bound once, as a column that is written out would double with each use
    steps = F.aggregate(F.array(F.lit(0), F.lit(1)), start, lambda x, _: halley(x))
    return F.when(q <= 0, float("-inf")).when(q >= 1, float("inf")).otherwise(steps)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series from x + 8, less the logarithms passed over."""
    z = x + 8.0
    passed = x * (x + 1.0) * (x + 2.0) * (x + 3.0) * (x + 4.0) * (x + 5.0) * (x + 6.0) * (x + 7.0)
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3.0))) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0))) + 1 / (1188 * F.pow(z, F.lit(9.0)))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(passed)


def t_cdf(x: Column, df: float) -> Column:
    tail = 0.5 * betainc(df / 2, 0.5, df / (df + x * x))
    return F.when(x < 0, tail).otherwise(1 - tail)


def _power(x: Column, k: float) -> Column:
    return F.pow(x, F.lit(float(k)))


def poisson_cdf(k: Column, mu: float) -> Column:
    """P(X <= k), 1 - P(k + 1, mu), summed term by term up to k."""
    step = lambda s, j: F.struct((s["t"] * mu / (j + 1)).alias("t"), (s["s"] + s["t"]).alias("s"))
    total = F.aggregate(F.sequence(F.lit(0), k.cast("int")), F.struct(F.lit(math.exp(-mu)).alias("t"), F.lit(0.0).alias("s")), step, lambda s: s["s"])
    return F.when(k < 0, 0.0).otherwise(total)


def binom_cdf(k: Column, n: int, p: float) -> Column:
    cums, out = 0.0, []
    for j in range(n + 1):
        cums += math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p))
        out.append(min(cums, 1.0))
    return F.when(k < 0, 0.0).when(k >= n, 1.0).otherwise(F.element_at(F.array(*[F.lit(c) for c in out]), k.cast("int") + 1))


#: Cumulative distribution functions of x and parameters.
CDF: dict[str, Callable[..., Column]] = {
    "norm": norm_cdf,
    "t": t_cdf,
    "chi2": lambda x, df: gammainc(df / 2, x / 2),
    "gamma": lambda x, a: gammainc(a, x),
    "beta": lambda x, a, b: betainc(a, b, x),
    "f": lambda x, d1, d2: F.when(x <= 0, 0.0).otherwise(betainc(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2))),
    "lognorm": lambda x, s: F.when(x <= 0, 0.0).otherwise(norm_cdf(F.log(F.greatest(x, F.lit(1e-300))) / s)),
}

#: Densities.
PDF: dict[str, Callable[..., Column]] = {
    "norm": lambda x: F.exp(-x * x / 2) / math.sqrt(2 * math.pi),
    "t": lambda x, df: _power(1 + x * x / df, -(df + 1) / 2) * math.exp(-_log_beta(df / 2, 0.5)) / math.sqrt(df),
    "chi2": lambda x, df: _power(x, df / 2 - 1) * F.exp(-x / 2) / (2 ** (df / 2) * math.gamma(df / 2)),
    "gamma": lambda x, a: _power(x, a - 1) * F.exp(-x) / math.gamma(a),
    "beta": lambda x, a, b: F.when((x > 0) & (x < 1), _power(x, a - 1) * _power(1 - x, b - 1) * math.exp(-_log_beta(a, b))).otherwise(0.0),
    "f": lambda x, d1, d2: (d1 / d2) ** (d1 / 2) * _power(x, d1 / 2 - 1) * _power(1 + d1 / d2 * x, -(d1 + d2) / 2) * math.exp(-_log_beta(d1 / 2, d2 / 2)),
    "lognorm": lambda x, s: F.exp(-0.5 * _power(F.log(x) / s, 2)) / (x * s * math.sqrt(2 * math.pi)),
}


def ppf(cdf: Callable[[Column], Column], q: Column, low: float, high: float, steps: int = 60) -> Column:
    """The quantile in [low, high] by bisection."""
    mid = lambda s: (s["a"] + s["b"]) / 2
    step = lambda s, _: F.struct(F.when(cdf(mid(s)) < q, mid(s)).otherwise(s["a"]).alias("a"), F.when(cdf(mid(s)) < q, s["b"]).otherwise(mid(s)).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(float(low)).alias("a"), F.lit(float(high)).alias("b")), step, mid)


def betainc_value(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc_value(b, a, 1 - x)
    below = 1.0
    for d in _beta_fraction(a, b):
        below = 1 + d * x / below
    return math.exp(a * math.log(x) + b * math.log1p(-x) - _log_beta(a, b)) / a / below


def t_sf_two_sided(t: float, df: float) -> float:
    return betainc_value(df / 2, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    return betainc_value(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def norm_sf_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def norm_quantile(q: float) -> float:
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * math.erfc(-mid / math.sqrt(2)) < q else (low, mid)
    return (low + high) / 2


def gammainc_value(a: float, x: float) -> float:
    """The regularized lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x <= a + 1:
        total, term, n = 1 / a, 1 / a, 1
        while abs(term) > TINY * abs(total):
            term *= x / (a + n)
            total += term
            n += 1
        return scale * total
    depth = 200 + int(20 * math.sqrt(a))
    below = x + 2.0 * depth + 1 - a
    for n in range(depth, 0, -1):
        below = x + 2.0 * n - 1 - a - n * (n - a) / below
    return 1 - scale / below


def chi2_sf(x: float, df: float) -> float:
    return 1 - gammainc_value(df / 2, x / 2)


def studentized_range_sf(q: float, k: int, df: float) -> float:
    """P(range of k normal values over an independent scale with df degrees > q), by Gauss-Legendre sums in both integrals."""
    if q <= 0:
        return 1.0
    x, w = np.polynomial.legendre.leggauss(96)

    def range_cdf(r: np.ndarray) -> np.ndarray:
        """P(range <= r) of k normal values."""
        z = 8.0 * x
        phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        inside = _norm_cdf_values(z[None, :]) - _norm_cdf_values(z[None, :] - r[:, None])
        return k * (8.0 * w * phi * inside ** (k - 1)).sum(1)

    if df > 1e5:
        return float(1 - range_cdf(np.array([q]))[0])
    # the scale s has df s^2 ~ chi-square: integrate over s around 1
    spread = 10 / math.sqrt(2 * df)
    low, high = max(1e-8, 1 - spread), 1 + max(spread, 12 / df)
    s = (high - low) / 2 * x + (high + low) / 2
    log_density = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    return float(max(0.0, 1 - ((high - low) / 2 * w * np.exp(log_density) * range_cdf(q * s)).sum()))


def studentized_range_quantile(p: float, k: int, df: float) -> float:
    low, high = 0.0, 4.0
    while studentized_range_sf(high, k, df) > 1 - p:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if studentized_range_sf(mid, k, df) > 1 - p else (low, mid)
    return (low + high) / 2


_erfc = np.vectorize(math.erfc, otypes=[float])


def _norm_cdf_values(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(-z / math.sqrt(2))


def norm_ppf_values(q: np.ndarray) -> np.ndarray:
    """The normal quantile of numbers in (0, 1), as norm_ppf()."""
    c, r = q - 0.5, np.sqrt(-2 * np.log(np.minimum(q, 1 - q)))
    tail = np.polyval(_PPF[2], r) / np.polyval(_PPF[3], r)
    x = np.where(np.minimum(q, 1 - q) > 0.02425, np.polyval(_PPF[0], c * c) * c / np.polyval(_PPF[1], c * c), np.where(c < 0, tail, -tail))
    e = (_norm_cdf_values(x) - q) * math.sqrt(2 * math.pi) * np.exp(x * x / 2)
    return x - e / (1 + x * e / 2)


def t_quantile(q: float, df: float) -> float:
    """The quantile of Student's distribution for q >= 0.5."""
    low, high = 0.0, 1.0
    while t_sf_two_sided(high, df) > 2 * (1 - q):
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if t_sf_two_sided(mid, df) > 2 * (1 - q) else (low, mid)
    return (low + high) / 2
