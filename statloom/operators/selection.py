"""Choosing columns: steps by an information criterion, and knockoffs. Both work on one Gram matrix of the columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.penalties import L1, solve_quadratic
from ..functions.special import norm_ppf_values
from ..plans import block_sums, gram
from .resampling import PRIME, mixed_values


def criterion_of(g: np.ndarray, chosen: Sequence[int], kind: str = "aic") -> float:
    """AIC or BIC of least squares on some columns, from the Gram matrix of (1, x, y)."""
    at = [0, *[i + 1 for i in chosen]]
    n, y = g[0, 0], len(g) - 1
    beta = np.linalg.pinv(g[np.ix_(at, at)]) @ g[at, y]
    rss = max(g[y, y] - beta @ g[at, y], 1e-300)
    llf = -n / 2 * (math.log(2 * math.pi * rss / n) + 1)
    return -2 * llf + (2 if kind == "aic" else math.log(n)) * len(at)


def stepwise(df: DataFrame, y: str, x: Sequence[str], criterion: str = "aic", direction: str = "both", most: int | None = None, score: Callable[[list[str]], float] | None = None) -> tuple[list[str], float]:
    """(columns, criterion) when no single column added or removed lowers the criterion. Of equal moves a removal comes first,
    then the column that is first. backward goes on down to `most` columns. score: another model's criterion of some columns;
    without it least squares, which needs one pass over the rows in all."""
    g = None if score else gram(df, [F.lit(1.0), *[F.col(c).cast("double") for c in x], F.col(y).cast("double")])
    value = (lambda cs: score([x[i] for i in cs])) if score else (lambda cs: criterion_of(g, cs, criterion))
    now = list(range(len(x))) if direction == "backward" else []
    best = value(now)
    while True:
        moves = []
        if direction in ("backward", "both"):
            moves += [(value([i for i in now if i != j]), 0, j) for j in now]
        if direction in ("forward", "both") and (most is None or len(now) < most):
            moves += [(value(sorted([*now, j])), 1, j) for j in range(len(x)) if j not in now]
        forced = direction == "backward" and most is not None and len(now) > most
        if not moves or (min(moves)[0] >= best - 1e-12 and not forced):
            break
        best, kind, j = min(moves)
        now = sorted([*now, j]) if kind else [i for i in now if i != j]
    return [x[i] for i in now], float(best)


@dataclass
class Knockoffs:
    selected: list[str]
    w: dict[str, float]
    threshold: float


def threshold(w: np.ndarray, q: float, offset: int = 1) -> float:
    """The least |W| down to which (offset + how many W <= 0) / how many W > 0 is at most q, at the largest such rank."""
    order = np.argsort(-np.abs(w), kind="stable")
    best, minus, plus = math.inf, 0, 0
    for i in order:
        minus, plus = minus + (w[i] <= 0), plus + (w[i] > 0)
        if (offset + minus) / max(plus, 1) <= q:
            best = abs(w[i])
    return float(best)


def equal_s(sigma: np.ndarray) -> np.ndarray:
    """The diagonal that makes all columns and their copies equally unlike, for a correlation matrix."""
    return np.full(len(sigma), min(1.0, 2 * float(np.linalg.eigvalsh(sigma)[0])) * (1 - 1e-8))


class Copies:
    """Normal copies of standardized columns: the law that exchanging a column with its copy leaves as it is. Draws are a
    function of a row's id, so reruns agree."""

    def __init__(self, df: DataFrame, x: Sequence[str]):
        self.x, p = list(x), len(x)
        g = gram(df, [F.lit(1.0), *[F.col(c).cast("double") for c in x]])
        self.mean = g[0, 1:] / g[0, 0]
        cov = g[1:, 1:] / g[0, 0] - np.outer(self.mean, self.mean)
        self.sd = np.sqrt(np.diag(cov))
        self.sigma = cov / np.outer(self.sd, self.sd)
        self.s = np.diag(equal_s(self.sigma))
        self.shift = np.linalg.solve(self.sigma, self.s)  # a copy's mean: z less z times this
        self.root = np.linalg.cholesky(2 * self.s - self.s @ self.shift + 1e-10 * np.eye(p))

    def draws(self, ids: np.ndarray, seed: int) -> np.ndarray:
        """(row, column) of standard normal values."""
        p = len(self.x)
        return np.stack([norm_ppf_values((mixed_values(ids, seed * p + j) + 1) / (float(PRIME) * PRIME + 2)) for j in range(p)], 1)

    def of(self, z: np.ndarray, u: np.ndarray) -> np.ndarray:
        return z - z @ self.shift + u @ self.root.T

    def rows(self, df: DataFrame, id_col: str, y: str) -> DataFrame:
        """(id, x.., y) as doubles; ids are whole numbers under 2^53."""
        return df.select(F.col(id_col).cast("double").alias("id"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*self.x, y])]).na.drop()

    def gram(self, df: DataFrame, id_col: str, y: str, seed: int, raw: bool = False) -> np.ndarray:
        """Sums of products of (1, z, copies, y), or of the draws instead of copies, in one pass."""
        p = len(self.x)

        def sums(m: np.ndarray) -> np.ndarray:
            z, u = (m[1 : p + 1].T - self.mean) / self.sd, self.draws(m[0].astype(np.int64), seed)
            f = np.column_stack([np.ones(len(z)), z, u if raw else self.of(z, u), m[p + 1]])
            return (f.T @ f).ravel()

        k = 2 * p + 2
        return block_sums(self.rows(df, id_col, y), sums, k * k).reshape(k, k)


def statistics(g: np.ndarray, p: int, method: str) -> np.ndarray:
    """W of each column from the Gram matrix of (1, z, copies, y): how much more the column tells than its copy."""
    n = g[0, 0]
    m = g[0, 1:] / n
    c = g[1:, 1:] / n - np.outer(m, m)
    a, b = c[:-1, :-1], c[:-1, -1]
    if method == "corr_diff":
        r = np.abs(b) / np.sqrt(np.diag(a) * c[-1, -1])
    elif method == "ols_coef_diff":
        r = np.abs(np.linalg.solve(a + 1e-8 * np.eye(2 * p), b))
    elif method == "lasso_coef_diff":
        sigma = math.sqrt(max(c[-1, -1] - b @ np.linalg.pinv(a) @ b, 0.0))
        r = np.abs(solve_quadratic(a, b, L1(sigma * math.sqrt(2 * math.log(2 * p) / n)), ()))
    else:
        raise ValueError(method)
    return r[:p] - r[p:]


def model_x_knockoffs(df: DataFrame, y: str, x: Sequence[str], id_col: str, q: float = 0.1, method: str = "corr_diff", plus: bool = True, draws: int = 1, seed: int = 0) -> Knockoffs:
    """The columns that tell more of y than their normal copies, W averaged over draws, at a share q of false ones."""
    p, w, copies = len(x), np.zeros(len(x)), Copies(df, x)
    for d in range(draws):
        w += statistics(copies.gram(df, id_col, y, seed + d), p, method) / draws
    t = threshold(w, q, int(plus))
    return Knockoffs([c for c, v in zip(x, w, strict=True) if v >= t and v > 0], dict(zip(x, w.tolist(), strict=True)), t)


def fixed_x_knockoffs(df: DataFrame, y: str, x: Sequence[str], id_col: str, q: float = 0.1, method: str = "corr_diff", plus: bool = True, seed: int = 0) -> Knockoffs:
    """Knockoffs whose own products are exactly as they must be: normal draws, freed of what the columns tell of them and
    rotated by their Gram matrix, both found in one pass. Needs twice as many rows as columns."""
    p = len(x)
    g = Copies(df, x).gram(df, id_col, y, seed, raw=True)
    n = g[0, 0]
    if n < 2 * p:
        raise ValueError("fixed knockoffs need twice as many rows as columns")
    m = g[0, 1:] / n
    c = g[1:, 1:] / n - np.outer(m, m)
    sigma, zu, uu = c[:p, :p], c[:p, p : 2 * p], c[p : 2 * p, p : 2 * p]
    s = np.diag(equal_s(sigma))
    shift, target = np.linalg.solve(sigma, s), 2 * s - s @ np.linalg.solve(sigma, s)
    on = np.linalg.solve(sigma, zu)  # what the columns tell of the draws
    left = uu - zu.T @ on
    lw, lv = np.linalg.eigh(left)
    tw, tv = np.linalg.eigh(target)
    turn = lv / np.sqrt(np.clip(lw, 1e-12, None)) @ lv.T @ tv * np.sqrt(np.clip(tw, 0, None)) @ tv.T
    # copies: z (I - shift) + (u - z on) turn; their products with z and y follow from the same matrix
    z_part, u_part = np.eye(p) - shift - on @ turn, turn
    at = np.vstack([np.hstack([np.eye(p), z_part]), np.hstack([np.zeros((p, p)), u_part])])
    full = np.zeros((2 * p + 2, 2 * p + 2))
    full[0, 0] = n
    full[1:-1, 1:-1] = n * at.T @ c[: 2 * p, : 2 * p] @ at
    full[1:-1, -1] = full[-1, 1:-1] = n * at.T @ c[: 2 * p, 2 * p]
    full[-1, -1] = n * c[2 * p, 2 * p]
    w = statistics(full, p, method)
    t = threshold(w, q, int(plus))
    return Knockoffs([c_ for c_, v in zip(x, w, strict=True) if v >= t and v > 0], dict(zip(x, w.tolist(), strict=True)), t)
