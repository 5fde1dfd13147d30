"""Losses of an observation y at the linear predictor e, as column expressions with parameters, and a registry.

Each gives its value, its slope in e, and a weight: the expected curvature, or for robust losses the slope over the
residual, so that reweighted least squares on e - slope / weight is a step that never needs more than a Gram matrix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Loss:
    """link is the inverse of what e is of the mean; canonical names are those of LINKS."""

    link = "identity"
    #: Whether the weight is a curvature, so that steps are Newton's, and whether a dispersion scales the errors.
    curved, dispersed = True, False

    def value(self, y: Column, e: Column) -> Column:
        raise NotImplementedError

    def slope(self, y: Column, e: Column) -> Column:
        raise NotImplementedError

    def weight(self, y: Column, e: Column) -> Column:
        raise NotImplementedError

    def mean(self, e: Column) -> Column:
        return F.exp(F.greatest(F.least(e, F.lit(30.0)), F.lit(-30.0))) if self.link == "log" else e

    def variance(self, m: Column) -> Column:
        """The variance function of the family that the loss is the likelihood of."""
        return m * 0 + 1.0


class Squared(Loss):
    dispersed = True

    def value(self, y, e):
        return 0.5 * (y - e) * (y - e)

    def slope(self, y, e):
        return e - y

    def weight(self, y, e):
        return F.lit(1.0)


class Logistic(Loss):
    link = "logit"

    def mean(self, e):
        return 1 / (1 + F.exp(-e))

    def value(self, y, e):
        return F.greatest(e, F.lit(0.0)) + F.log1p(F.exp(-F.abs(e))) - y * e

    def slope(self, y, e):
        return self.mean(e) - y

    def weight(self, y, e):
        p = self.mean(e)
        return F.greatest(p * (1 - p), F.lit(1e-10))

    def variance(self, m):
        return m * (1 - m)


class Poisson(Loss):
    link = "log"

    def value(self, y, e):
        return self.mean(e) - y * e

    def slope(self, y, e):
        return self.mean(e) - y

    def weight(self, y, e):
        return self.mean(e)

    def variance(self, m):
        return m


class Gamma(Loss):
    dispersed = True

    def __init__(self, link: str = "log"):
        self.link = link

    def mean(self, e):
        return super().mean(e) if self.link == "log" else 1 / F.greatest(F.least(e, F.lit(1e3)), F.lit(1e-4))

    def value(self, y, e):
        return e + y / self.mean(e) if self.link == "log" else y * e + F.log(self.mean(e))

    def slope(self, y, e):
        return 1 - y / self.mean(e) if self.link == "log" else y - self.mean(e)

    def weight(self, y, e):
        return F.lit(1.0) if self.link == "log" else self.mean(e) * self.mean(e)

    def variance(self, m):
        return m * m


class InverseGaussian(Loss):
    link, dispersed = "log", True

    def value(self, y, e):
        m = self.mean(e)
        return y / (2 * m * m) - 1 / m

    def slope(self, y, e):
        m = self.mean(e)
        return (m - y) / (m * m)

    def weight(self, y, e):
        return 1 / self.mean(e)

    def variance(self, m):
        return m * m * m


class NegativeBinomial(Loss):
    link = "log"

    def __init__(self, alpha: float = 1.0):
        self.alpha = float(alpha)

    def value(self, y, e):
        m = self.mean(e)
        return -y * F.log(m / (1 + self.alpha * m)) + F.log1p(self.alpha * m) / self.alpha

    def slope(self, y, e):
        m = self.mean(e)
        return (m - y) / (1 + self.alpha * m)

    def weight(self, y, e):
        m = self.mean(e)
        return m / (1 + self.alpha * m)

    def variance(self, m):
        return m + self.alpha * m * m


class Tweedie(Loss):
    link, dispersed = "log", True

    def __init__(self, power: float = 1.5):
        if not 1 < power < 2:
            raise ValueError("the power lies between 1 and 2")
        self.power = float(power)

    def value(self, y, e):
        m, p = self.mean(e), self.power
        return -y * F.pow(m, F.lit(1 - p)) / (1 - p) + F.pow(m, F.lit(2 - p)) / (2 - p)

    def slope(self, y, e):
        m = self.mean(e)
        return (m - y) * F.pow(m, F.lit(1 - self.power))

    def weight(self, y, e):
        return F.pow(self.mean(e), F.lit(2 - self.power))

    def variance(self, m):
        return F.pow(m, F.lit(self.power))


class Quantile(Loss):
    """Majorized by parabolas that are `width` wide at their sharpest."""

    curved = False

    def __init__(self, quantile: float = 0.5, width: float = 1e-6):
        self.quantile, self.width = float(quantile), float(width)

    def value(self, y, e):
        return F.when(y >= e, self.quantile * (y - e)).otherwise((1 - self.quantile) * (e - y))

    def slope(self, y, e):
        return 0.5 * (e - y) / (self.width + F.abs(y - e)) - (self.quantile - 0.5)

    def weight(self, y, e):
        return 0.5 / (self.width + F.abs(y - e))


class Huber(Loss):
    curved = False

    def __init__(self, delta: float = 1.345):
        self.delta = float(delta)

    def value(self, y, e):
        u = F.abs(y - e)
        return F.when(u <= self.delta, 0.5 * u * u).otherwise(self.delta * (u - 0.5 * self.delta))

    def slope(self, y, e):
        return F.greatest(F.least(e - y, F.lit(self.delta)), F.lit(-self.delta))

    def weight(self, y, e):
        return self.delta / F.greatest(F.abs(y - e), F.lit(self.delta))


class Bisquare(Loss):
    curved = False

    def __init__(self, delta: float = 4.685):
        self.delta = float(delta)

    def _inside(self, y, e):
        t = (y - e) / self.delta
        return F.greatest(1 - t * t, F.lit(0.0))

    def value(self, y, e):
        return self.delta**2 / 6 * (1 - F.pow(self._inside(y, e), F.lit(3.0)))

    def slope(self, y, e):
        return (e - y) * F.pow(self._inside(y, e), F.lit(2.0))

    def weight(self, y, e):
        return F.greatest(F.pow(self._inside(y, e), F.lit(2.0)), F.lit(1e-12))


class Fair(Loss):
    curved = False

    def __init__(self, delta: float = 1.3998):
        self.delta = float(delta)

    def value(self, y, e):
        t = F.abs(y - e) / self.delta
        return self.delta**2 * (t - F.log1p(t))

    def slope(self, y, e):
        return (e - y) * self.weight(y, e)

    def weight(self, y, e):
        return 1 / (1 + F.abs(y - e) / self.delta)


_LOSSES: dict[str, Callable[..., Loss]] = {}


def register_loss(name: str) -> Callable:
    """A decorator that makes a loss known by name; estimators take it from then on."""

    def put(make: Callable[..., Loss]) -> Callable[..., Loss]:
        _LOSSES[name] = make
        return make

    return put


def get_loss(name: str, **parameters) -> Loss:
    if name not in _LOSSES:
        raise ValueError(f"no loss {name!r}; there are {', '.join(list_losses())}")
    return _LOSSES[name](**parameters)


def list_losses() -> list[str]:
    return sorted(_LOSSES)


def list_glm_losses() -> list[str]:
    """Losses that are the likelihood of an exponential family."""
    return sorted(n for n, make in _LOSSES.items() if getattr(make, "curved", False))


for _name, _make in (
    ("squared_error", Squared), ("logistic", Logistic), ("poisson", Poisson), ("gamma", Gamma), ("inverse_gaussian", InverseGaussian), ("negative_binomial", NegativeBinomial),
    ("tweedie", Tweedie), ("quantile", Quantile), ("huber", Huber), ("bisquare", Bisquare), ("fair", Fair),
):
    register_loss(_name)(_make)
