"""Kernel methods. Rows meet a bounded set of landmarks, so no matrix of all pairs is made; exact forms take bounded tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import block_sums, doubles
from .resampling import mixed

#: Rows that an exact kernel matrix is made of at most, and landmarks.
EXACT_ROWS, LANDMARKS = 5_000, 5_000
#: Rows that meet a block of others at once.
MET_ROWS = 256


def _dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x @ y.T


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0)


#: Kernels of rows of two arrays, with their parameters; gamma is 1 / columns where none is given.
KERNELS: dict[str, Callable[..., np.ndarray]] = {
    "linear": lambda x, y, **_: _dot(x, y),
    "rbf": lambda x, y, gamma=None, **_: np.exp(-(gamma or 1 / x.shape[1]) * squared_distances(x, y)),
    "polynomial": lambda x, y, gamma=None, degree=3, coef0=1, **_: ((gamma or 1 / x.shape[1]) * _dot(x, y) + coef0) ** degree,
    "sigmoid": lambda x, y, gamma=None, coef0=1, **_: np.tanh((gamma or 1 / x.shape[1]) * _dot(x, y) + coef0),
    "laplacian": lambda x, y, gamma=None, **_: np.exp(-(gamma or 1 / x.shape[1]) * _by_column(lambda a, b: np.abs(a - b), x, y)),
    "cosine": lambda x, y, **_: _dot(x, y) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None] + 1e-10),
    "chi2": lambda x, y, gamma=1.0, **_: np.exp(-gamma * _chi2(x, y)),
}


def _chi2(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if (x < 0).any() or (y < 0).any():
        raise ValueError("the chi-square kernel takes values of at least 0")

    def term(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = a + b
        return np.divide((a - b) ** 2, s, out=np.zeros_like(s), where=s > 0)

    return _by_column(term, x, y)


def _by_column(f: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sum over columns of f of all pairs: one matrix of pairs at a time, not one for each column."""
    out = np.zeros((len(x), len(y)))
    for a, b in zip(x.T, y.T, strict=True):
        out += f(a[:, None], b[None])
    return out


def register_kernel(name: str) -> Callable:
    """A decorator that makes a function of two arrays of rows known as a kernel."""

    def put(f: Callable[..., np.ndarray]) -> Callable[..., np.ndarray]:
        KERNELS[name] = f
        return f

    return put


def kernel(name: str | Callable[..., np.ndarray]) -> Callable[..., np.ndarray]:
    return name if callable(name) else KERNELS[name]


def pairwise(rows: DataFrame, others: DataFrame, id_col: str, vector: str, name: str | Callable = "rbf", block: int = 1024, **parameters) -> DataFrame:
    """(a, b, value) of every row a and each row b of `others`, which is a stated set: in blocks, by one matrix product each.

    Blocks of others are broadcast one after the other, so a task holds one block of them, and its rows meet it MET_ROWS at a time.
    """
    f, out = kernel(name), None
    kind = rows.schema[id_col].dataType.simpleString()
    few = others.select(F.col(id_col), vector).orderBy(id_col).toPandas()
    for i in range(0, len(few), block):
        ids, y = few[id_col].to_numpy()[i : i + block], np.stack(few[vector].to_numpy()[i : i + block]).astype(float)

        def meet(batches, ids=ids, y=y):
            for b in batches:
                for j in range(0, len(b), MET_ROWS):
                    c = b.iloc[j : j + MET_ROWS]
                    k = f(np.stack(c.v).astype(float), y, **parameters)
                    yield pd.DataFrame({"a": np.repeat(c.id.to_numpy(), len(ids)), "b": np.tile(ids, len(c)), "value": k.ravel()})

        part = rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).where("v IS NOT NULL").mapInPandas(meet, f"a {kind}, b {kind}, value double")
        out = part if out is None else out.union(part)
    return out


def landmarks(df: DataFrame, columns: Sequence[str], id_col: str, n: int, seed: int = 0) -> np.ndarray:
    """n rows, the first in an order drawn by a hash of the id."""
    if n > LANDMARKS:
        raise ValueError(f"at most {LANDMARKS} landmarks")
    rows = df.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).na.drop()
    few = rows.orderBy(mixed(F.col("id"), F.lit(seed)), "id").limit(n).drop("id").collect()
    return np.array([tuple(r) for r in few], float).reshape(-1, len(columns))


class Nystroem:
    """Rows as kernel values with landmarks, times the inverse root of the landmarks' own kernel matrix."""

    def __init__(self, name: str = "rbf", components: int = 100, **parameters):
        self.f, self.n, self.parameters = kernel(name), components, parameters

    def fit(self, df: DataFrame, columns: Sequence[str], id_col: str, seed: int = 0) -> Nystroem:
        self.marks = landmarks(df, columns, id_col, self.n, seed)
        u, s, v = np.linalg.svd(self.f(self.marks, self.marks, **self.parameters))
        self.normal = (u / np.sqrt(np.maximum(s, 1e-12))) @ v
        return self

    def features(self, x: np.ndarray) -> np.ndarray:
        return self.f(x, self.marks, **self.parameters) @ self.normal.T

    def transform(self, df: DataFrame, columns: Sequence[str], id_col: str) -> DataFrame:
        """(id, features array)."""
        rows = df.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).na.drop()

        def run(batches):
            for b in batches:
                yield pd.DataFrame({"id": b.id, "features": list(self.features(b.drop(columns="id").to_numpy()))})

        return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, features array<double>")


def _bounded(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    rows = doubles(df, columns)
    if (n := rows.count()) > EXACT_ROWS:
        raise ValueError(f"{n} rows; the exact form takes at most {EXACT_ROWS}: use landmarks")
    return rows.toPandas().to_numpy(float).reshape(-1, len(columns))


class KernelRidge:
    """Ridge regression in a kernel's space. Up to EXACT_ROWS rows exactly, (K + alpha I)^-1 y; with landmarks, the ridge
    regression of y on their features, from one pass of blocks over any number of rows."""

    def __init__(self, name: str = "rbf", alpha: float = 1.0, marks: int | None = None, **parameters):
        self.name, self.f, self.alpha, self.marks, self.parameters = name, kernel(name), alpha, marks, parameters

    def fit(self, df: DataFrame, y: str, columns: Sequence[str], id_col: str | None = None) -> KernelRidge:
        if self.marks is None:
            data = _bounded(df, [*columns, y])
            self.x, target = data[:, :-1], data[:, -1]
            k, jitter = self.f(self.x, self.x, **self.parameters), 0.0
            while True:
                try:
                    np.linalg.cholesky(k + (self.alpha + jitter) * np.eye(len(k)))
                    break
                except np.linalg.LinAlgError:
                    jitter = max(jitter * 10, 1e-10 * np.trace(k) / len(k))
            self.dual = np.linalg.solve(k + (self.alpha + jitter) * np.eye(len(k)), target)
            return self
        self.map = Nystroem(self.name, self.marks, **self.parameters).fit(df, columns, id_col)
        m = len(self.map.marks)

        def sums(z: np.ndarray) -> np.ndarray:
            f = np.column_stack([self.map.features(z[:-1].T), z[-1]])
            return (f.T @ f).ravel()

        g = block_sums(doubles(df, [*columns, y]), sums, (m + 1) ** 2).reshape(m + 1, m + 1)
        self.x, w = self.map.marks, np.linalg.solve(g[:m, :m] + self.alpha * np.eye(m), g[:m, m])
        self.dual = self.map.normal.T @ w
        return self

    def values(self, x: np.ndarray) -> np.ndarray:
        return self.f(x, self.x, **self.parameters) @ self.dual

    def predict(self, df: DataFrame, columns: Sequence[str], id_col: str) -> DataFrame:
        """(id, predicted)."""
        rows = df.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).na.drop()

        def run(batches):
            for b in batches:
                yield pd.DataFrame({"id": b.id, "predicted": self.values(b.drop(columns="id").to_numpy())})

        return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, predicted double")


def kernel_ridge_cv(df: DataFrame, y: str, columns: Sequence[str], fold: Column, folds: int, alphas: Sequence[float], name: str = "rbf", marks: int = 50, id_col: str = "id", **parameters) -> tuple[float, np.ndarray]:
    """(best alpha, mean squared errors by alpha): features on landmarks, whose products are summed by fold in one pass."""
    m = Nystroem(name, marks, **parameters).fit(df, columns, id_col)
    k = len(m.marks)
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*columns, y])], fold.cast("double").alias("f")).na.drop()

    def sums(z: np.ndarray) -> np.ndarray:
        f = np.column_stack([m.features(z[:-2].T), z[-2], np.ones(z.shape[1])])
        return np.stack([(f[z[-1] == i].T @ f[z[-1] == i]) for i in range(folds)]).ravel()

    g = block_sums(rows, sums, folds * (k + 2) ** 2).reshape(folds, k + 2, k + 2)
    errors = np.zeros((len(alphas), folds))
    for j in range(folds):
        t = g.sum(0) - g[j]
        for i, alpha in enumerate(alphas):
            v = np.concatenate([np.linalg.solve(t[:k, :k] + alpha * np.eye(k), t[:k, k]), [-1.0]])
            errors[i, j] = v @ g[j][: k + 1, : k + 1] @ v / g[j][k + 1, k + 1]
    return float(alphas[int(errors.mean(1).argmin())]), errors.mean(1)


class KernelPCA:
    """Components in a kernel's space: exactly for up to EXACT_ROWS rows, from the doubly centred kernel matrix."""

    def __init__(self, name: str = "rbf", components: int = 2, **parameters):
        self.f, self.keep, self.parameters = kernel(name), components, parameters

    def fit(self, df: DataFrame, columns: Sequence[str]) -> KernelPCA:
        self.x = _bounded(df, columns)
        k = self.f(self.x, self.x, **self.parameters)
        self.rows_mean, self.mean = k.mean(0), k.mean()
        values, vectors = np.linalg.eigh(k - k.mean(0)[None] - k.mean(1)[:, None] + k.mean())
        order = [i for i in np.argsort(-values)[: self.keep] if values[i] > 1e-12]
        sign = np.sign(vectors[np.abs(vectors[:, order]).argmax(0), order])
        self.eigenvalues, self.vectors = values[order], vectors[:, order] * sign
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        k = self.f(x, self.x, **self.parameters)
        return (k - k.mean(1)[:, None] - self.rows_mean[None] + self.mean) @ self.vectors / np.sqrt(self.eigenvalues)


def kde_multivariate(df: DataFrame, columns: Sequence[str], points: np.ndarray, factor: float | str = "scott", weight: str | None = None) -> np.ndarray:
    """A normal kernel density at some points, with a kernel covariance of factor^2 times the data's (weights scaled to sum to
    1; their covariance has the divisor 1 - sum of squares)."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)], w.alias("w")).na.drop()
    p = len(columns)
    got = block_sums(rows, lambda z: np.concatenate([[z[-1].sum(), (z[-1] ** 2).sum()], z[:-1] @ z[-1], ((z[:-1] * z[-1]) @ z[:-1].T).ravel()]), 2 + p + p * p)
    total, squares = got[0], got[1] / got[0] ** 2
    mean = got[2 : 2 + p] / total
    cov = (got[2 + p :].reshape(p, p) / total - np.outer(mean, mean)) / (1 - squares)
    n = 1 / squares
    h = {"scott": n ** (-1 / (p + 4)), "silverman": (n * (p + 2) / 4) ** (-1 / (p + 4))}.get(factor, factor) if isinstance(factor, str) else factor
    c = cov * h * h + 1e-12 * np.trace(cov) / p * np.eye(p)
    root = np.linalg.inv(np.linalg.cholesky(c))
    scale = 1 / math.sqrt((2 * math.pi) ** p * np.linalg.det(c))
    z0 = points @ root.T
    return block_sums(rows, lambda z: (np.exp(-0.5 * squared_distances(z0, z[:-1].T @ root.T)) * z[-1]).sum(1), len(points)) * scale / total


def kde_interval(density: float, n: float, bandwidth: float, level: float = 0.95) -> tuple[float, float]:
    """Normal limits of a one-dimensional normal kernel density, whose variance is about density * R / (n h)."""
    from ..functions.special import norm_quantile

    half = norm_quantile((1 + level) / 2) * math.sqrt(max(density, 0) / (2 * math.sqrt(math.pi)) / (n * bandwidth))
    return max(density - half, 0.0), density + half
