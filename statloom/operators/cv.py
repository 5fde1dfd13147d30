"""Cross-validated strengths. Folds' Gram matrices come from one pass; a training matrix is the total less the fold's own, so
linear paths need no more rows. Other losses make a pass for each step of each fold and strength."""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.losses import Loss, get_loss
from ..functions.penalties import L1, ElasticNet, L2, Penalty, get_penalty, solve_quadratic
from ..plans import block_sums
from . import glm


def fold_grams(df: DataFrame, y: str, x: Sequence[str], fold: Column, folds: int, weight: str | None = None) -> np.ndarray:
    """(fold, k, k): weighted sums of products of (1, x, y) in each fold, numbered from 0."""
    k = len(x) + 2
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(F.lit(1.0).alias("one"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*x, y])], w.alias("w"), fold.cast("double").alias("f")).na.drop()

    def sums(m: np.ndarray) -> np.ndarray:
        return np.stack([((m[:k] * m[k]) * (m[k + 1] == f)) @ m[:k].T for f in range(folds)]).ravel()

    return block_sums(rows, sums, folds * k * k).reshape(folds, k, k)


def folds_are_complete(df: DataFrame, fold: Column, folds: int) -> bool:
    """Whether every row is in one of the folds and none is empty."""
    r = df.select(fold.alias("f")).agg(F.count_if(F.col("f").isNull() | ~F.col("f").between(0, folds - 1)).alias("bad"), F.count_distinct("f").alias("n")).first()
    return r.bad == 0 and r.n == folds


def check_weights(df: DataFrame, weight: str) -> None:
    """An error unless weights are finite, at least 0, and not all 0."""
    w = F.col(weight).cast("double")
    r = df.agg(F.count_if(w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")) | (w < 0)).alias("bad"), F.sum(w).alias("s")).first()
    if r.bad or not r.s:
        raise ValueError("weights are finite, at least 0, and not all 0")


def data_hash(df: DataFrame) -> str:
    """A name of a table's rows, whatever their order: the sum and the exclusive or of rows' hashes, and their number."""
    h = F.xxhash64(*df.columns)
    r = df.select(h.alias("h")).agg(F.count("*"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    return hashlib.sha256(repr((sorted(df.dtypes), *map(str, r))).encode()).hexdigest()


class Cache:
    """Results by key, of which the ones used last stay."""

    def __init__(self, most: int = 64):
        self.most, self.kept = most, OrderedDict()

    def get(self, key: str, make: Callable[[], object]) -> object:
        if key not in self.kept:
            self.kept[key] = make()
        self.kept.move_to_end(key)
        while len(self.kept) > self.most:
            self.kept.popitem(last=False)
        return self.kept[key]


def run(grid: Sequence[float], folds: Sequence[int], score: Callable[[int, float], float], minimize: bool = True) -> tuple[float, np.ndarray]:
    """(best strength, mean scores): a strength that fails in a fold is left out; of equals the first wins."""
    table = np.full((len(grid), len(folds)), np.nan)
    for i, alpha in enumerate(grid):
        for j, f in enumerate(folds):
            try:
                table[i, j] = score(f, alpha)
            except (ArithmeticError, np.linalg.LinAlgError):
                break
    mean = table.mean(1)
    if np.isnan(mean).all():
        raise ValueError("no strength worked in all folds")
    return float(grid[int(np.nanargmin(mean) if minimize else np.nanargmax(mean))]), mean


def _centred(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """(x'x / n, x'y / n, means of x, mean of y, n) of a Gram matrix of (1, x, y)."""
    n = g[0, 0]
    m = g[0, 1:] / n
    c = g[1:, 1:] / n - np.outer(m, m)
    return c[:-1, :-1], c[:-1, -1], m[:-1], float(m[-1]), n


def _error(g: np.ndarray, b0: float, b: np.ndarray) -> float:
    v = np.concatenate([[b0], b, [-1.0]])
    return float(v @ g @ v / g[0, 0])


def linear_cv(grams: np.ndarray, penalty: Callable[[float], Penalty], grid: Sequence[float]) -> tuple[float, np.ndarray, np.ndarray]:
    """(best strength, mean squared errors by strength, coefficients at the best on all rows) of a penalized linear model."""
    total = grams.sum(0)

    def fitted(g: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
        a, b, mx, my, _ = _centred(g)
        p = penalty(alpha)
        beta = np.linalg.solve(a + alpha * np.eye(len(a)), b) if isinstance(p, L2) else solve_quadratic(a, b, p, ())
        return my - mx @ beta, beta

    best, mean = run(grid, range(len(grams)), lambda f, alpha: _error(grams[f], *fitted(total - grams[f], alpha)))
    b0, b = fitted(total, best)
    return best, mean, np.concatenate([[b0], b])


def lasso_grid(g: np.ndarray, n: int = 12, least: float = 1e-3, ratio: float = 1.0) -> list[float]:
    """Falling strengths from the least that leaves no coefficient, by equal factors."""
    _, b, _, _, _ = _centred(g)
    top = max(float(np.abs(b).max()) / max(ratio, 1e-12), 1e-300)
    return [top * least ** (i / max(n - 1, 1)) for i in range(n)]


def lasso_cv(df: DataFrame, y: str, x: Sequence[str], fold: Column, folds: int = 5, grid: Sequence[float] | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    g = fold_grams(df, y, x, fold, folds)
    return linear_cv(g, L1, lasso_grid(g.sum(0)) if grid is None else grid)


def elastic_net_cv(df: DataFrame, y: str, x: Sequence[str], fold: Column, folds: int = 5, ratios: Sequence[float] = (0.5,), grid: Sequence[float] | None = None) -> tuple[float, float, np.ndarray]:
    """(mixing, strength, coefficients) with the least error over both."""
    g = fold_grams(df, y, x, fold, folds)
    tried = []
    for r in ratios:
        best, mean, beta = linear_cv(g, lambda a, r=r: ElasticNet(a, r), lasso_grid(g.sum(0), 100, 1e-3, r) if grid is None else grid)
        tried.append((float(np.nanmin(mean)), r, best, beta))
    _, r, best, beta = min(tried, key=lambda t: t[0])
    return r, best, beta


def glm_cv(df: DataFrame, y: str, x: Sequence[str], fold: Column, folds: int, loss: str | Loss, penalty: str, grid: Sequence[float], **parameters) -> tuple[float, np.ndarray, glm.Fit]:
    """(best strength, mean held-out losses, fit on all rows). Strengths run from the largest, each fit from the one before; of
    equal losses the larger strength wins."""
    loss = get_loss(loss) if isinstance(loss, str) else loss
    rows = df.withColumn("__f", fold).persist()
    grid = sorted(grid, reverse=True)
    table = np.full((len(grid), folds), np.nan)
    try:
        for f in range(folds):
            train, held, start = rows.where(F.col("__f") != f), rows.where(F.col("__f") == f), None
            fits = []
            for alpha in grid:
                m = glm.fit(train, y, x, loss, get_penalty(penalty, alpha=alpha, **parameters), start=start)
                start = m.beta
                fits.append(m)
            got = held.agg(*[F.avg(loss.value(F.col(y).cast("double"), m.eta())).alias(f"v{i}") for i, m in enumerate(fits)]).first()
            table[:, f] = [math.nan if v is None else v for v in got]
        mean = np.nanmean(table, 1)
        best = grid[int(np.nanargmin(mean))]
        return best, mean, glm.fit(rows, y, x, loss, get_penalty(penalty, alpha=best, **parameters))
    finally:
        rows.unpersist()


def logistic_cv(df: DataFrame, y: str, x: Sequence[str], fold: Column, folds: int, cs: Sequence[float]) -> tuple[float, np.ndarray, glm.Fit]:
    """(best C, mean held-out losses from the smallest C up, fit). C weighs the summed loss of all rows against half the squares."""
    n = df.count()
    best, mean, m = glm_cv(df, y, x, fold, folds, "logistic", "l2", [1 / (c * n) for c in cs])
    return min(cs, key=lambda c: abs(1 / (c * n) - best)), mean, m
