"""Distributions by name: distribution function, upper tail, density and quantiles as column expressions, with place and scale."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import special


@dataclass
class Distribution:
    """cdf, pdf and ppf of the standard form; the methods take loc and scale. Counts have no density: pdf is their probability."""

    name: str
    standard_cdf: Callable[[Column], Column]
    standard_pdf: Callable[[Column], Column]
    standard_ppf: Callable[[Column], Column]
    counts: bool = False

    def _z(self, x: Column, loc: float, scale: float) -> Column:
        return (x - loc) / scale

    def cdf(self, x: Column, loc: float = 0.0, scale: float = 1.0) -> Column:
        return self.standard_cdf(self._z(x, loc, scale))

    def sf(self, x: Column, loc: float = 0.0, scale: float = 1.0) -> Column:
        return 1 - self.cdf(x, loc, scale)

    def pdf(self, x: Column, loc: float = 0.0, scale: float = 1.0) -> Column:
        return self.standard_pdf(self._z(x, loc, scale)) / (1.0 if self.counts else scale)

    def ppf(self, q: Column, loc: float = 0.0, scale: float = 1.0) -> Column:
        return self.standard_ppf(q) * scale + loc


def _positive(x: Column, value: Column) -> Column:
    return F.when(x > 0, value).otherwise(0.0)


def _closed() -> dict[str, Callable[..., Distribution]]:
    one = F.lit
    up = lambda x: F.greatest(x, one(1e-300))
    return {
        "uniform": lambda: Distribution("uniform", lambda x: F.least(F.greatest(x, one(0.0)), one(1.0)), lambda x: F.when((x >= 0) & (x <= 1), 1.0).otherwise(0.0), lambda q: q),
        "expon": lambda: Distribution("expon", lambda x: _positive(x, 1 - F.exp(-x)), lambda x: F.when(x >= 0, F.exp(-x)).otherwise(0.0), lambda q: -F.log1p(-q)),
        "cauchy": lambda: Distribution("cauchy", lambda x: 0.5 + F.atan(x) / math.pi, lambda x: 1 / (math.pi * (1 + x * x)), lambda q: F.tan(math.pi * (q - 0.5))),
        "laplace": lambda: Distribution("laplace", lambda x: F.when(x < 0, 0.5 * F.exp(x)).otherwise(1 - 0.5 * F.exp(-x)), lambda x: 0.5 * F.exp(-F.abs(x)), lambda q: F.when(q < 0.5, F.log(2 * q)).otherwise(-F.log(2 * (1 - q)))),
        "logistic": lambda: Distribution("logistic", lambda x: 1 / (1 + F.exp(-x)), lambda x: F.exp(-F.abs(x)) / ((1 + F.exp(-F.abs(x))) * (1 + F.exp(-F.abs(x)))), lambda q: F.log(q / (1 - q))),
        "weibull_min": lambda c=1.0: Distribution("weibull_min", lambda x: _positive(x, 1 - F.exp(-F.pow(up(x), one(c)))), lambda x: _positive(x, c * F.pow(up(x), one(c - 1)) * F.exp(-F.pow(up(x), one(c)))), lambda q: F.pow(-F.log1p(-q), one(1 / c))),
    }


def _special(name: str, low: float, high: float) -> Callable[..., Distribution]:
    def make(*a: float) -> Distribution:
        cdf = lambda x: special.CDF[name](x, *a)
        return Distribution(name, cdf, lambda x: special.PDF[name](x, *a), lambda q: special.ppf(cdf, q, low, high))

    return make


def _poisson(mu: float) -> Distribution:
    pmf = lambda k: F.when((k < 0) | (k != F.floor(k)), 0.0).otherwise(F.exp(k * math.log(mu) - mu - special.log_gamma(F.greatest(k, F.lit(0)) + 1.0)))
    most = int(mu + 20 * math.sqrt(mu) + 30)
    return Distribution("poisson", lambda k: special.poisson_cdf(F.floor(k), mu), pmf, lambda q: _least(lambda k: special.poisson_cdf(k, mu), q, most), True)


def _binom(n: int, p: float) -> Distribution:
    choose = lambda k: math.lgamma(n + 1) - special.log_gamma(k + 1.0) - special.log_gamma(n - k + 1.0)
    inside = lambda k: F.least(F.greatest(k, F.lit(0)), F.lit(n))
    pmf = lambda k: F.when((k < 0) | (k > n) | (k != F.floor(k)), 0.0).otherwise(F.exp(choose(inside(k)) + k * math.log(p) + (n - k) * math.log1p(-p)))
    return Distribution("binom", lambda k: special.binom_cdf(F.floor(k), n, p), pmf, lambda q: _least(lambda k: special.binom_cdf(k, n, p), q, n), True)


def _least(cdf: Callable[[Column], Column], q: Column, most: int) -> Column:
    """The least count whose distribution function is at least q."""
    counts = F.sequence(F.lit(0), F.lit(most))
    return F.element_at(F.filter(counts, lambda k: cdf(k) >= q), 1).cast("double")


_MAKERS: dict[str, Callable[..., Distribution]] = {
    "norm": lambda: Distribution("norm", special.norm_cdf, special.PDF["norm"], special.norm_ppf),
    "t": _special("t", -1e4, 1e4), "chi2": _special("chi2", 0.0, 1e4), "gamma": _special("gamma", 0.0, 1e4), "beta": _special("beta", 0.0, 1.0), "f": _special("f", 0.0, 1e5), "lognorm": _special("lognorm", 0.0, 1e6),
    "poisson": _poisson, "binom": _binom,
}


def get_distribution(name: str, *shape: float) -> Distribution:
    """A distribution with its shape parameters, as t(5), beta(3, 4), weibull_min(1.5), poisson(4.5), binom(12, 0.3)."""
    makers = _MAKERS | _closed()
    if name not in makers:
        raise ValueError(f"no distribution {name!r}; there are {', '.join(list_available_distributions())}")
    return makers[name](*shape)


def list_available_distributions() -> list[str]:
    return sorted([*_MAKERS, "uniform", "expon", "cauchy", "laplace", "logistic", "weibull_min"])
