"""Generalized linear models with any registered loss and penalty: reweighted Gram matrices, one aggregate a step.

A step's aggregate gives the weighted Gram matrix of (1, x, working response) and the loss at the present coefficients; the
penalized quadratic is solved on the driver. The objective is the mean loss plus the penalty; the intercept is free.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.losses import Loss, Squared, get_loss
from ..functions.penalties import L2, NoPenalty, Penalty, get_penalty, solve_quadratic
from ..functions.special import chi2_sf, norm_quantile, norm_sf_two_sided, t_quantile, t_sf_two_sided
from ..plans import gram, linear

RESULT = "term string, estimate double, std_err double, stat double, p double, low double, high double"


@dataclass
class Fit:
    """A fitted model: coefficients with the intercept first, and what its inference needs."""

    names: list[str]
    beta: np.ndarray
    loss: Loss
    penalty: Penalty
    n: float
    mean_loss: float
    hessian: np.ndarray  # of the mean loss, by expected curvature
    slopes: np.ndarray  # of the mean loss at beta
    iterations: int
    terms: list[Column] = field(repr=False, default_factory=list)

    def eta(self, terms: Sequence[Column] | None = None) -> Column:
        return linear([F.lit(1.0), *(self.terms if terms is None else terms)], self.beta)

    def predict(self, terms: Sequence[Column] | None = None) -> Column:
        """The mean."""
        return self.loss.mean(self.eta(terms))

    def loglikelihood(self) -> float:
        """Minus the summed loss: terms of y alone are left out."""
        return -self.n * self.mean_loss

    def aic(self) -> float:
        return -2 * self.loglikelihood() + 2 * len(self.beta)

    def bic(self) -> float:
        return -2 * self.loglikelihood() + math.log(self.n) * len(self.beta)

    def stationarity(self) -> float:
        """How far the coefficients are from a fixed point of a proximal step: 0 at an optimum."""
        step = min(1.0 / max(np.linalg.eigvalsh(self.hessian)[-1], 1e-12), self.penalty.most_step)
        moved = self.beta - step * self.slopes
        moved[1:] = self.penalty.prox(moved[1:], step)
        return float(np.abs(moved - self.beta).max() / step)


def _prepared(df: DataFrame, y: str, x: Sequence[str], weight: str | None) -> tuple[DataFrame, list[Column]]:
    cols = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x)]
    w = (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w")
    return df.select(F.col(y).cast("double").alias("y"), *cols, w).na.drop(), [F.col(f"x{i}") for i in range(len(x))]


def _aggregate(rows: DataFrame, terms: list[Column], loss: Loss, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(mean weighted Gram of (1, x), its product with beta less the mean slope, mean loss, total weight)."""
    y, e, w = F.col("y"), F.col("e"), F.col("w")
    d = rows.withColumn("e", linear([F.lit(1.0), *terms], beta))
    d = d.withColumn("h", loss.weight(y, e)).withColumn("z", e - loss.slope(y, e) / F.col("h")).withColumn("v", loss.value(y, e) / F.col("h")).withColumn("o", 1 / F.col("h"))
    g = gram(d, [F.lit(1.0), *terms, F.col("z"), F.col("v"), F.col("o")], w * F.col("h"))
    k = len(terms) + 1
    total = g[0, k + 2]
    return g[:k, :k] / total, g[:k, k] / total, g[0, k + 1] / total, total


def fit(df: DataFrame, y: str, x: Sequence[str], loss: str | Loss = "squared_error", penalty: str | Penalty = "none", alpha: float = 1.0, weight: str | None = None, start: Sequence[float] | None = None, steps: int = 100, tol: float = 1e-9, intercept: bool = True, **penalty_parameters) -> Fit:
    """Coefficients that minimize the mean loss plus a penalty. Rows with a null in any column are left out.

    A step that raises the objective is halved. Losses whose weight is a curvature move by Newton's steps with expected
    curvature; the robust ones and quantiles by majorizing parabolas.
    """
    loss = get_loss(loss) if isinstance(loss, str) else loss
    if isinstance(penalty, str):
        penalty = NoPenalty() if penalty == "none" else get_penalty(penalty, alpha=alpha, **penalty_parameters)
    rows, terms = _prepared(df, y, x, weight)
    k = len(x) + 1
    beta = np.zeros(k) if start is None else np.asarray(start, float)
    if start is None and intercept:
        beta[0] = _first_intercept(rows, loss)
    if not isinstance(loss, Squared):
        rows = rows.persist()  # read once for each step; spills to disk where memory is short
    free = (0,) if intercept else ()
    try:
        a, b, value, n = _aggregate(rows, terms, loss, beta)
        objective, i = value + penalty.value(beta[1:]), 0
        for i in range(1, steps + 1):
            new = solve_quadratic(a, b, penalty, free, beta) if intercept else _without_intercept(a, b, penalty, beta)
            size = 1.0
            while True:
                trial = beta + size * (new - beta)
                ta, tb, tv, _ = _aggregate(rows, terms, loss, trial)
                after = tv + penalty.value(trial[1:])
                if after <= objective + 1e-12 * (1 + abs(objective)) or size < 1e-4 or not math.isfinite(objective):
                    break
                size /= 2
            moved = np.abs(trial - beta).max()
            beta, a, b, value, objective = trial, ta, tb, tv, after
            if moved <= tol * (1 + np.abs(beta).max()) or isinstance(loss, Squared):
                break
    finally:
        rows.unpersist()
    return Fit(["intercept", *x], beta, loss, penalty, n, value, a, a @ beta - b, i, [F.col(c).cast("double") for c in x])


def _without_intercept(a: np.ndarray, b: np.ndarray, penalty: Penalty, beta: np.ndarray) -> np.ndarray:
    out = np.zeros(len(b))
    out[1:] = solve_quadratic(a[1:, 1:], b[1:], penalty, (), beta[1:])
    return out


def _first_intercept(rows: DataFrame, loss: Loss) -> float:
    mean = rows.agg(F.sum(F.col("w") * F.col("y")) / F.sum("w")).first()[0] or 0.0
    if loss.link == "logit":
        p = min(max(mean, 1e-6), 1 - 1e-6)
        return math.log(p / (1 - p))
    if loss.link == "log":
        return math.log(max(mean, 1e-10))
    return 1 / max(mean, 1e-10) if loss.link == "inverse" else mean


def lla_path(df: DataFrame, y: str, x: Sequence[str], loss: str, penalty: str, alphas: Sequence[float], rounds: int = 6, tol: float = 1e-6, **parameters) -> list[Fit]:
    """Fits along falling alphas; at each the concave penalty is replaced by weighted absolute values that touch it at the last
    coefficients, until these stand still. Each fit starts from the one before."""
    from ..functions.penalties import L1

    out, beta = [], None
    for alpha in sorted(alphas, reverse=True):
        concave = get_penalty(penalty, alpha=alpha, **parameters)
        got = None
        for _ in range(rounds):
            weights = concave.weights(np.zeros(len(x)) if beta is None else beta[1:])
            got = fit(df, y, x, loss, L1(1.0, weights), start=beta)
            done = beta is not None and np.abs(got.beta - beta).max() < tol
            beta = got.beta
            if done:
                break
        got.penalty = concave
        out.append(got)
    return out


def dispersion(df: DataFrame, y: str, model: Fit) -> float:
    """Pearson's chi-square over the residual degrees of freedom; 1 for families without a dispersion."""
    if not model.loss.dispersed:
        return 1.0
    m = model.predict()
    r = F.col(y) - m
    got = df.agg(F.sum(r * r / model.loss.variance(m))).first()[0]
    return float(got / max(model.n - len(model.beta), 1))


def covariance(df: DataFrame, y: str, model: Fit, kind: str = "nonrobust", cluster: str | None = None) -> np.ndarray:
    """The coefficients' covariance: nonrobust, hc0, hc1, or summed by cluster. The bread is the mean curvature of the loss
    plus the penalty's; the meat, from one more pass, the mean product of slopes."""
    curve = np.zeros(len(model.beta))
    curve[1:] = model.penalty.curvature(model.beta[1:])
    bread = np.linalg.pinv(model.hessian + np.diag(curve))
    if kind == "nonrobust":
        return bread * dispersion(df, y, model) / model.n
    terms = [F.lit(1.0), *model.terms]
    u = model.loss.slope(F.col(y).cast("double"), model.eta())
    if cluster is not None:
        sums = df.groupBy(cluster).agg(*[F.sum(u * t).alias(f"s{i}") for i, t in enumerate(terms)])
        meat = gram(sums, [F.col(f"s{i}") for i in range(len(terms))]) / model.n
    elif kind in ("hc0", "hc1"):
        meat = gram(df, terms, u * u) / model.n
    else:
        raise NotImplementedError(kind)
    factor = model.n / (model.n - len(terms)) if kind == "hc1" else 1.0
    return bread @ meat @ bread / model.n * factor


def inference(df: DataFrame, y: str, model: Fit, kind: str = "nonrobust", alpha: float = 0.05, cluster: str | None = None) -> DataFrame:
    """(term, estimate, std_err, stat, p, low, high): normal, but Student's t for plain least squares."""
    se = np.sqrt(np.diag(covariance(df, y, model, kind, cluster)))
    return result_rows(df, model.names, model.beta, se, model.n - len(model.beta) if isinstance(model.loss, Squared) and kind == "nonrobust" else None, alpha)


def result_rows(df: DataFrame, names: Sequence[str], beta: Sequence[float], se: Sequence[float], dof: float | None, alpha: float = 0.05) -> DataFrame:
    q = norm_quantile(1 - alpha / 2) if dof is None else t_quantile(1 - alpha / 2, dof)
    rows = []
    for name, b, s in zip(names, beta, se, strict=True):
        stat = float(b / s) if s > 0 else float("nan")
        p = norm_sf_two_sided(stat) if dof is None else t_sf_two_sided(stat, float(dof))
        rows.append((name, float(b), float(s), stat, float(p), float(b - q * s), float(b + q * s)))
    return df.sparkSession.createDataFrame(rows, RESULT)


def wald(beta: np.ndarray, cov: np.ndarray) -> tuple[float, float]:
    """The joint test that all coefficients given are 0: chi-square and its p."""
    stat = float(beta @ np.linalg.pinv(cov) @ beta)
    return stat, chi2_sf(stat, len(beta))


def summary(df: DataFrame, y: str, model: Fit, kind: str = "nonrobust") -> str:
    """The coefficient table and what the fit comes to, as text."""
    lines = [f"{'term':<16}{'estimate':>14}{'std err':>12}{'stat':>10}{'p':>10}{'low':>12}{'high':>12}"]
    lines += [f"{r.term:<16}{r.estimate:>14.6g}{r.std_err:>12.4g}{r.stat:>10.3f}{r.p:>10.4f}{r.low:>12.5g}{r.high:>12.5g}" for r in inference(df, y, model, kind).collect()]
    return "\n".join([*lines, f"n {model.n:g}  log-likelihood {model.loglikelihood():.6g}  AIC {model.aic():.6g}  BIC {model.bic():.6g}"])


def debiased(df: DataFrame, y: str, x: Sequence[str], model: Fit, alpha: float = 0.05) -> DataFrame:
    """Inference after a lasso: coefficients corrected by an approximate inverse of the covariance, whose rows are lassos of
    each column on the others. All comes from one Gram matrix. Columns are centred; the intercept has no row."""
    cols = [F.col(c).cast("double") for c in x]
    g = gram(df, [F.lit(1.0), *cols, F.col(y).cast("double")])
    n, p = g[0, 0], len(x)
    c = g[1:, 1:] / n - np.outer(g[0, 1:], g[0, 1:]) / n**2
    s, xy, beta = c[:p, :p], c[:p, p], model.beta[1:]
    rss = c[p, p] - 2 * beta @ xy + beta @ s @ beta
    sigma2 = n * rss / max(n - np.count_nonzero(beta) - 1, 1)
    from ..functions.penalties import L1

    m = np.zeros((p, p))
    for j in range(p):
        rest = np.arange(p) != j
        lam = math.sqrt(s[j, j]) * math.sqrt(2 * math.log(max(p, 2)) / n)
        gamma = solve_quadratic(s[np.ix_(rest, rest)], s[rest, j], L1(lam), ()) if p > 1 else np.zeros(0)
        tau = s[j, j] - s[j, rest] @ gamma
        m[j, j], m[j, rest] = 1 / tau, -gamma / tau
    theta = beta + m @ (xy - s @ beta)
    se = np.sqrt(np.clip(sigma2 * np.diag(m @ s @ m.T) / n, 0, None))
    return result_rows(df, x, theta, se, None, alpha)


def refit_active(df: DataFrame, y: str, x: Sequence[str], model: Fit, least: float = 1e-10, alpha: float = 0.05) -> DataFrame:
    """Inference of an unpenalized fit on the columns whose coefficients aren't 0, as if these had been known; others are null."""
    active = [c for c, b in zip(x, model.beta[1:], strict=True) if abs(b) > least]
    again = fit(df, y, active, model.loss)
    got = {r.term: r for r in inference(df, y, again, alpha=alpha).collect()}
    rows = [tuple(got[c]) if c in got else (c, None, None, None, None, None, None) for c in ["intercept", *x]]
    return df.sparkSession.createDataFrame(rows, RESULT)


def simultaneous_band(cov: np.ndarray, level: float = 0.95, draws: int = 10_000, seed: int = 0) -> float:
    """The quantile of the largest |z| among coefficients with this covariance, by normal draws."""
    d = np.sqrt(np.diag(cov))
    values, vectors = np.linalg.eigh(cov / np.outer(d, d))
    z = np.random.default_rng(seed).normal(size=(draws, len(cov))) * np.sqrt(np.clip(values, 0, None)) @ vectors.T
    return float(np.quantile(np.abs(z).max(1), level))


def ridge_strength(c: float, n: float, summed: bool) -> L2:
    """The mean-scale penalty of an inverse strength: 1 / (C n) where it weighs the summed loss (logistic regression), else
    1 / (2 C)."""
    return L2(1 / (c * n) if summed else 1 / (2 * c))
