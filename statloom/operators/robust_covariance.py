"""Covariances that outliers don't move, the lasso of precisions over strengths, and likelihoods of rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import gammainc_value
from ..plans import block_sums, gram
from .models import graphical_lasso
from .resampling import mixed


def _chi2_quantile(q: float, df: float) -> float:
    low, high = 0.0, df + 10
    while gammainc_value(df / 2, high / 2) < q:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if gammainc_value(df / 2, mid / 2) < q else (low, mid)
    return (low + high) / 2


def _squared(columns: Sequence[str], mean: np.ndarray, precision: np.ndarray) -> Column:
    d = [F.col(c) - float(m) for c, m in zip(columns, mean, strict=True)]
    out = F.lit(0.0)
    for i in range(len(d)):
        for j in range(len(d)):
            out = out + d[i] * d[j] * float(precision[i, j])
    return out


def _moments(rows: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, float]:
    g = gram(rows, [F.lit(1.0), *[F.col(c) for c in columns]])
    mean = g[0, 1:] / g[0, 0]
    return mean, g[1:, 1:] / g[0, 0] - np.outer(mean, mean), g[0, 0]


class MinCovDet:
    """The mean and covariance of the share of rows whose covariance has the least determinant, found by steps that keep the
    rows nearest to the last mean and covariance.

    Starts are small subsets drawn by hash; after two steps the best few go on. A step is a quantile of distances and a sum
    over the rows within it, so it never orders the rows.
    """

    def __init__(self, share: float | None = None, starts: int = 10, best: int = 2, steps: int = 30, accuracy: int = 100_000):
        self.share, self.starts, self.best, self.steps, self.accuracy = share, starts, best, steps, accuracy

    def _step(self, rows: DataFrame, columns: Sequence[str], mean: np.ndarray, cov: np.ndarray, h: float) -> tuple[np.ndarray, np.ndarray]:
        d = rows.withColumn("__d", _squared(columns, mean, np.linalg.pinv(cov)))
        cut = d.agg(F.percentile_approx("__d", h, self.accuracy)).first()[0]
        return _moments(d.where(F.col("__d") <= cut), columns)[:2]

    def fit(self, df: DataFrame, columns: Sequence[str], id_col: str) -> MinCovDet:
        names = [f"c{i}" for i in range(len(columns))]
        rows = df.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True)]).na.drop().persist()
        p = len(columns)
        try:
            n = rows.count()
            h = self.share or (n + p + 1) / 2 / n
            candidates = []
            for start in range(self.starts):
                few = rows.orderBy(mixed(F.col("id"), F.lit(start)), "id").limit(p + 1)
                mean, cov, _ = _moments(few, names)
                cov = cov + 1e-6 * np.trace(cov) / p * np.eye(p)
                for _ in range(2):
                    mean, cov = self._step(rows, names, mean, cov, h)
                candidates.append((float(np.linalg.det(cov)), start, mean, cov))
            candidates.sort(key=lambda c: c[:2])
            done = []
            for det, start, mean, cov in candidates[: self.best]:
                for _ in range(self.steps):
                    mean, cov = self._step(rows, names, mean, cov, h)
                    after = float(np.linalg.det(cov))
                    if after >= det * (1 - 1e-12):
                        break
                    det = after
                done.append((det, start, mean, cov))
            self.determinant, _, mean, cov = min(done, key=lambda c: c[:2])
            self.raw_mean = mean
            # consistent at normal rows: the median distance is that of chi-square
            d = rows.withColumn("__d", _squared(names, mean, np.linalg.pinv(cov)))
            self.raw_covariance = cov * d.agg(F.percentile_approx("__d", 0.5, self.accuracy)).first()[0] / _chi2_quantile(0.5, p)
            near = rows.where(_squared(names, mean, np.linalg.pinv(self.raw_covariance)) < _chi2_quantile(0.975, p))
            self.mean, self.covariance, self.used = _moments(near, names)
        finally:
            rows.unpersist()
        return self


def mean_loglikelihood(s: np.ndarray, precision: np.ndarray) -> float:
    """Mean normal log-likelihood of rows with second moments s about the model's mean."""
    sign, logdet = np.linalg.slogdet(precision)
    return float(0.5 * (logdet - (s * precision).sum() - len(s) * math.log(2 * math.pi))) if sign > 0 else -math.inf


def score(df: DataFrame, columns: Sequence[str], mean: np.ndarray, covariance: np.ndarray) -> float:
    """Mean log-likelihood of rows under a normal law."""
    m, s, _ = _moments(df, columns)
    return mean_loglikelihood(s + np.outer(m - mean, m - mean), np.linalg.pinv(covariance))


def graphical_lasso_cv(df: DataFrame, columns: Sequence[str], fold: Column, folds: int, alphas: Sequence[float] | int = 4) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(best strength, mean held-out likelihoods, covariance, precision): folds' moments are summed in one pass."""
    grid = list(np.logspace(-2, 0, alphas)) if isinstance(alphas, int) else list(alphas)
    p = len(columns)
    rows = df.select(F.lit(1.0).alias("one"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)], fold.cast("double").alias("f")).na.drop()
    g = block_sums(rows, lambda z: np.stack([(z[:-1] * (z[-1] == i)) @ z[:-1].T for i in range(folds)]).ravel(), folds * (p + 1) ** 2).reshape(folds, p + 1, p + 1)

    def moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = x[0, 1:] / x[0, 0]
        return m, x[1:, 1:] / x[0, 0] - np.outer(m, m)

    total, scores = g.sum(0), np.zeros((len(grid), folds))
    for j in range(folds):
        mean, s = moments(total - g[j])
        held, sh = moments(g[j])
        for i, alpha in enumerate(grid):
            scores[i, j] = mean_loglikelihood(sh + np.outer(held - mean, held - mean), graphical_lasso(s, alpha)[1])
    best = grid[int(scores.mean(1).argmax())]
    cov, precision = graphical_lasso(moments(total)[1], best)
    return float(best), scores.mean(1), cov, precision


