"""Low-rank forms of wide tables: everything comes from sums over blocks of rows whose size depends on the columns alone."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import block_sums, doubles, gram, linear


def flip(components: np.ndarray) -> np.ndarray:
    """Rows with the sign that makes their largest entry positive."""
    return components * np.sign(components[np.arange(len(components)), np.abs(components).argmax(1)])[:, None]


class PCA:
    """Principal components from moments that may be added up batch by batch."""

    def __init__(self, components: int | None = None, whiten: bool = False):
        self.keep, self.whiten, self.g = components, whiten, None

    def partial_fit(self, batch: DataFrame, columns: Sequence[str]) -> PCA:
        """Add a batch's rows: the moments of all batches are those of all rows, so their order and sizes don't matter."""
        g = gram(batch, [F.lit(1.0), *[F.col(c) for c in columns]])
        self.g = g if self.g is None else self.g + g
        return self._solve()

    def fit(self, df: DataFrame, columns: Sequence[str]) -> PCA:
        self.g = None
        return self.partial_fit(df, columns)

    def _solve(self) -> PCA:
        n = self.g[0, 0]
        self.mean = self.g[0, 1:] / n
        s = (self.g[1:, 1:] - n * np.outer(self.mean, self.mean)) / max(n - 1, 1)
        values, vectors = np.linalg.eigh(s)
        order = np.argsort(-values)[: self.keep or len(values)]
        self.explained, self.components = np.clip(values[order], 0, None), flip(vectors[:, order].T)
        self.ratio = self.explained / max(np.trace(s), 1e-300)
        return self

    def transform(self, columns: Sequence[str]) -> list[Column]:
        """Scores as expressions of the columns."""
        scale = np.sqrt(np.maximum(self.explained, 1e-300)) if self.whiten else np.ones(len(self.explained))
        return [linear([F.col(c) - float(m) for c, m in zip(columns, self.mean, strict=True)], v / s) for v, s in zip(self.components, scale, strict=True)]

    def inverse(self, scores: Sequence[Column]) -> list[Column]:
        scale = np.sqrt(np.maximum(self.explained, 1e-300)) if self.whiten else np.ones(len(self.explained))
        return [linear(list(scores), self.components[:, j] * scale) + float(self.mean[j]) for j in range(len(self.mean))]


class TruncatedSVD:
    """Singular values and right vectors of the rows as they are, from their Gram matrix."""

    def __init__(self, components: int = 2):
        self.keep = components

    def fit(self, df: DataFrame, columns: Sequence[str]) -> TruncatedSVD:
        values, vectors = np.linalg.eigh(gram(df, [F.col(c) for c in columns]))
        order = np.argsort(-values)[: self.keep]
        self.singular, self.components = np.sqrt(np.clip(values[order], 0, None)), flip(vectors[:, order].T)
        return self

    def transform(self, columns: Sequence[str]) -> list[Column]:
        return [linear([F.col(c) for c in columns], v) for v in self.components]


def randomized_svd(df: DataFrame, columns: Sequence[str], components: int, oversamples: int = 10, steps: int = 2, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors) by powers of X'X applied to random vectors: each a pass that never makes X'X itself."""
    p = len(columns)
    k = min(p, components + oversamples)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(p, k)))[0]
    rows = doubles(df, columns)
    for _ in range(steps + 1):
        y = block_sums(rows, lambda x, q=q: (x @ (x.T @ q)).ravel(), p * k).reshape(p, k)
        q = np.linalg.qr(y)[0]
    small = block_sums(rows, lambda x, q=q: ((x.T @ q).T @ (x.T @ q)).ravel(), k * k).reshape(k, k)
    values, vectors = np.linalg.eigh(small)
    order = np.argsort(-values)[:components]
    return np.sqrt(np.clip(values[order], 0, None)), flip((q @ vectors[:, order]).T)


class NMF:
    """Non-negative rows as non-negative sums of components, by multiplicative updates.

    A row's weights are a function of the components: some updates from equal weights. So no weights are kept between
    steps, and a step of the components is one pass of blocks.
    """

    EPS = 1e-10

    def __init__(self, components: np.ndarray, inner: int = 20, steps: int = 50, tol: float = 1e-4):
        self.h, self.inner, self.steps, self.tol = np.asarray(components, float), inner, steps, tol
        self.a, self.b = np.zeros((len(self.h), len(self.h))), np.zeros_like(self.h)

    def weights(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        w, hx, hh = np.ones((len(h), x.shape[1])), h @ x, h @ h.T
        for _ in range(self.inner):
            w *= hx / (hh @ w + self.EPS)
        return w

    def _sums(self, rows: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
        h = self.h
        k, p = h.shape

        def f(x: np.ndarray) -> np.ndarray:
            w = self.weights(x, h)
            return np.concatenate([(w @ w.T).ravel(), (w @ x.T).ravel(), [((x - h.T @ w) ** 2).sum()]])

        got = block_sums(rows, f, k * k + k * p + 1)
        return got[: k * k].reshape(k, k), got[k * k : -1].reshape(k, p), float(got[-1])

    def fit(self, df: DataFrame, columns: Sequence[str]) -> NMF:
        rows, last = doubles(df, columns).persist(), None
        try:
            for _ in range(self.steps):
                a, b, error = self._sums(rows)
                self.error = error
                if last is not None and last - error < self.tol * last:
                    break
                last = error
                self.h = self.h * b / (a @ self.h + self.EPS)
        finally:
            rows.unpersist()
        return self

    def partial_fit(self, batch: DataFrame, columns: Sequence[str]) -> NMF:
        """Add a batch's sums to those of all batches before, and take a step of the components by all of them."""
        a, b, self.error = self._sums(doubles(batch, columns))
        self.a, self.b = self.a + a, self.b + b
        self.h = self.h * self.b / (self.a @ self.h + self.EPS)
        return self
