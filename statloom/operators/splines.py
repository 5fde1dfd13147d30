"""Spline bases as expressions, their penalized fits, and additive models of several columns. Each fit is one Gram matrix."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import gram, linear
from .multivariate import bspline


def clamped(inner: Sequence[float], low: float, high: float, degree: int = 3) -> list[float]:
    return [low] * (degree + 1) + [float(k) for k in inner if low < k < high] + [high] * (degree + 1)


def basis(x: Column, knots: Sequence[float], degree: int = 3) -> list[Column]:
    """B-splines on clamped knots; the last one includes the upper end."""
    n = len(knots) - degree - 1
    out = [bspline(x, knots, degree, i) for i in range(n)]
    out[-1] = F.when(x == float(knots[-1]), 1.0).otherwise(out[-1])
    return [F.when(x == float(knots[-1]), 0.0).otherwise(b) if i < n - 1 else b for i, b in enumerate(out)]


def basis_values(x: np.ndarray, knots: Sequence[float], degree: int = 3, order: int = 0) -> np.ndarray:
    """The same, or derivatives, at numbers: (point, spline)."""
    t = np.asarray(knots, float)
    b = [((x >= t[i]) & (x < t[i + 1])).astype(float) for i in range(len(t) - 1)]
    last = max(i for i in range(len(t) - 1) if t[i] < t[i + 1])
    b[last] = np.where(x == t[-1], 1.0, b[last])
    for d in range(1, degree + 1):
        slope = d > degree - order
        new = []
        for i in range(len(t) - 1 - d):
            left, right = t[i + d] - t[i], t[i + d + 1] - t[i + 1]
            if slope:
                new.append((d / left * b[i] if left > 0 else 0 * x) - (d / right * b[i + 1] if right > 0 else 0 * x))
            else:
                new.append(((x - t[i]) / left * b[i] if left > 0 else 0 * x) + ((t[i + d + 1] - x) / right * b[i + 1] if right > 0 else 0 * x))
        b = new
    return np.stack(b, 1)


def _null_space(c: np.ndarray) -> np.ndarray:
    u, s, v = np.linalg.svd(c)
    return v[len(s[s > 1e-10 * max(s[0], 1)]) :].T


def _combined(columns: Sequence[Column], m: np.ndarray) -> list[Column]:
    return [linear(list(columns), m[:, j]) for j in range(m.shape[1])]


def natural(x: Column, inner: Sequence[float], low: float, high: float) -> list[Column]:
    """Cubic splines without curvature at both ends."""
    k = clamped(inner, low, high)
    ends = basis_values(np.array([low, high]), k, 3, 2)
    return _combined(basis(x, k), _null_space(ends))


def cyclic(x: Column, inner: Sequence[float], low: float, high: float) -> list[Column]:
    """Cubic splines with one value, slope and curvature at both ends."""
    k = clamped(inner, low, high)
    rows = [np.diff(basis_values(np.array([low, high]), k, 3, order), axis=0)[0] for order in (0, 1, 2)]
    return _combined(basis(x, k), _null_space(np.stack(rows)))


def thin_plate(x: Sequence[Column], centres: np.ndarray, order: int = 2) -> list[Column]:
    """Radial functions of the distance from each centre, r^(2 order - columns), times ln r if that is even, and a polynomial
    of degree under the order (1 and the columns for 2)."""
    d = len(x)
    power = 2 * order - d
    if power <= 0:
        raise ValueError("the order is more than half of the columns")
    out = []
    for c in np.asarray(centres, float).reshape(-1, d):
        r2 = sum(((v - float(m)) * (v - float(m)) for v, m in zip(x, c, strict=True)), F.lit(0.0))
        out.append(F.when(r2 <= 0, 0.0).otherwise(F.pow(r2, F.lit(power / 2)) * (0.5 * F.log(r2) if power % 2 == 0 else 1.0)))
    return [*out, F.lit(1.0), *(list(x) if order >= 2 else [])]


def difference_penalty(order: int, n: int) -> np.ndarray:
    d = np.diff(np.eye(n), n=order, axis=0)
    return d.T @ d


def penalized_least_squares(a: np.ndarray, b: np.ndarray, penalty: np.ndarray, strength: float) -> tuple[np.ndarray, float]:
    """(coefficients, effective size) from B'B and B'y."""
    m = a + strength * penalty + 1e-10 * np.trace(a) / len(a) * np.eye(len(a))
    return np.linalg.solve(m, b), float(np.trace(np.linalg.solve(m, a)))


def gcv(a: np.ndarray, b: np.ndarray, yy: float, n: float, penalty: np.ndarray, strength: float, gamma: float = 1.0) -> float:
    beta, size = penalized_least_squares(a, b, penalty, strength)
    return (yy - 2 * beta @ b + beta @ a @ beta) / n / (1 - gamma * size / n) ** 2


class SplineTransformer:
    """Columns of a spline basis with uniform, quantile or given knots. Beyond the ends: error, constant or linear."""

    def __init__(self, knots: int | Sequence[float] = 5, degree: int = 3, place: str = "uniform", bias: bool = True, beyond: str = "constant"):
        self.knots, self.degree, self.place, self.bias, self.beyond = knots, degree, place, bias, beyond

    def fit(self, df: DataFrame, column: str) -> SplineTransformer:
        low, high = map(float, df.agg(F.min(column), F.max(column)).first())
        if not isinstance(self.knots, int):
            inner = list(self.knots)
        elif self.place == "quantile":
            inner = df.agg(F.percentile_approx(F.col(column).cast("double"), [i / (self.knots - 1) for i in range(1, self.knots - 1)], 100_000)).first()[0] if self.knots > 2 else []
        else:
            inner = np.linspace(low, high, self.knots)[1:-1].tolist()
        self.t = clamped(sorted(set(inner)), low, high, self.degree)
        return self

    def transform(self, x: Column) -> list[Column]:
        low, high = self.t[0], self.t[-1]
        inside = F.least(F.greatest(x, F.lit(low)), F.lit(high))
        if self.beyond == "error":
            inside = F.when((x < low) | (x > high), F.raise_error(F.lit("a value lies beyond the knots")).cast("double")).otherwise(x)
        out = basis(inside, self.t, self.degree)
        if self.beyond == "linear":
            slopes = basis_values(np.array([low, high]), self.t, self.degree, 1)
            out = [b + (F.least(x - low, F.lit(0.0)) * float(slopes[0, i])) + (F.greatest(x - high, F.lit(0.0)) * float(slopes[1, i])) for i, b in enumerate(out)]
        return out if self.bias else out[:-1]


class GAM:
    """An additive model: a centred spline of each column, one strength for all, chosen by generalized cross-validation."""

    def __init__(self, splines: int = 20, degree: int = 3, strength: float | None = None, order: int = 2, gamma: float = 1.0, place: str = "quantile"):
        self.splines, self.degree, self.strength, self.order, self.gamma, self.place = splines, degree, strength, order, gamma, place

    def fit(self, df: DataFrame, y: str, x: Sequence[str], grid: Sequence[float] | None = None) -> GAM:
        self.names = list(x)
        self.parts = [SplineTransformer(max(2, self.splines - self.degree + 1), self.degree, self.place).fit(df, c) for c in x]
        columns = [b for c, p in zip(x, self.parts, strict=True) for b in p.transform(F.col(c).cast("double"))]
        g = gram(df, [F.lit(1.0), *columns, F.col(y).cast("double")])
        n = g[0, 0]
        mean = g[0, 1:] / n
        c = g[1:, 1:] - n * np.outer(mean, mean)
        a, b, yy = c[:-1, :-1], c[:-1, -1], c[-1, -1]
        penalty = np.zeros_like(a)
        at = 0
        for p in self.parts:
            k = len(p.t) - p.degree - 1
            penalty[at : at + k, at : at + k] = difference_penalty(self.order, k)
            at += k
        if self.strength is None:
            grid = np.logspace(-4, 6, 31) if grid is None else grid
            self.strength = float(min(grid, key=lambda s: gcv(a, b, yy, n, penalty, s, self.gamma)))
        self.beta, self.size = penalized_least_squares(a, b, penalty, self.strength)
        self.intercept, self.centre = float(mean[-1]), mean[:-1]
        self.rss = yy - 2 * self.beta @ b + self.beta @ a @ self.beta
        return self

    def predict(self) -> Column:
        columns = [b for c, p in zip(self.names, self.parts, strict=True) for b in p.transform(F.col(c).cast("double"))]
        return linear(columns, self.beta) + float(self.intercept - self.beta @ self.centre)
