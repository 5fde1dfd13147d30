"""Fits by reweighted sums: robust and quantile regression, ordered categories, cross-validated ridge, mixtures, factors.

Each step is one aggregate over the rows; what reaches the driver depends on the number of columns alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.losses import get_loss
from ..functions.special import norm_cdf, norm_quantile
from ..plans import gram, linear
from . import glm
from .linear import LinearModel, _solve, ols

#: Tuning constants of the M-estimators (95 % efficiency at the normal distribution).
TUNING = {"huber": 1.345, "bisquare": 4.685, "fair": 1.3998}
#: Accuracy of the approximate median that a scale is read from.
MEDIAN_ACCURACY = 100_000


def robust_scale(df: DataFrame, y: str, x: Sequence[str], beta: Sequence[float]) -> float:
    """Median absolute residual / 0.6745, about 0."""
    r = F.col(y) - linear([F.lit(1.0), *[F.col(c) for c in x]], beta)
    return (df.agg(F.percentile_approx(F.abs(r), 0.5, MEDIAN_ACCURACY)).first()[0] or 0.0) / 0.6745 or 1.0


def robust_fit(df: DataFrame, y: str, x: Sequence[str], kind: str = "huber", epsilon: float | None = None, penalty: str = "none", alpha: float = 1.0) -> glm.Fit:
    """An M-estimator (huber, bisquare, fair) whose width is epsilon times the scale of the least-squares residuals."""
    scale = robust_scale(df, y, x, ols(df, y, x).beta)
    start = [df.agg(F.percentile_approx(y, 0.5, MEDIAN_ACCURACY)).first()[0] or 0.0, *[0.0] * len(x)]
    return glm.fit(df, y, x, get_loss(kind, delta=scale * (epsilon or TUNING[kind])), penalty, alpha, start=start)


def quantile_fit(df: DataFrame, y: str, x: Sequence[str], q: float = 0.5, steps: int = 80) -> np.ndarray:
    """Coefficients that minimize the check loss, by majorizing it with parabolas whose width shrinks to 1e-4 of the scale."""
    terms = [F.lit(1.0), *[F.col(c) for c in x]]
    m = ols(df, y, x)
    k, beta = len(terms), m.beta
    scale = math.sqrt(max(m.rss, 0.0) / max(m.n, 1.0)) or 1.0
    sums = gram(df.where(F.col(y).isNotNull()), terms)[0]
    for step in range(steps):
        width = scale * max(1e-4, 0.5 ** (step + 1))
        w = 1 / (width + F.abs(F.col(y) - linear(terms, beta)))
        g = gram(df, [*terms, F.col(y)], w)
        new = _solve(g[:k, :k], g[:k, k] + (2 * q - 1) * sums)
        done = width <= scale * 1e-4 and np.abs(new - beta).max() < 1e-7 * (1 + np.abs(beta).max())
        beta = new
        if done:
            break
    return beta


def quantile_inference(df: DataFrame, y: str, x: Sequence[str], beta: Sequence[float], q: float = 0.5, alpha: float = 0.05) -> DataFrame:
    """(term, estimate, std_err, stat, p, low, high) of a quantile fit: Powell's sandwich with an Epanechnikov kernel, whose width
    is Hall and Sheather's share of quantiles on the scale of the residuals."""
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
    r = F.col(y) - linear(terms, beta)
    got = df.agg(F.count(r), F.stddev_samp(r), F.percentile_approx(r, [0.25, 0.75], MEDIAN_ACCURACY)).first()
    n, z, tail = got[0], norm_quantile(q), norm_quantile(1 - alpha / 2)
    density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    share = n ** (-1 / 3) * tail ** (2 / 3) * (1.5 * density**2 / (2 * z * z + 1)) ** (1 / 3)
    share = min(share, 0.999 * min(q, 1 - q))
    h = min(got[1], (got[2][1] - got[2][0]) / 1.34) * (norm_quantile(q + share) - norm_quantile(q - share))
    u = r / h
    inside = gram(df, terms, F.when(F.abs(u) <= 1, 0.75 * (1 - u * u)).otherwise(0.0) / h)
    bread = np.linalg.pinv(inside)
    cov = q * (1 - q) * bread @ gram(df, terms) @ bread
    return glm.result_rows(df, ["intercept", *x], beta, np.sqrt(np.diag(cov)), n - len(terms), alpha)


def ordered_fit(df: DataFrame, y: str, x: Sequence[str], categories: int, link: str = "logit", steps: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """(cut points, slopes, log-likelihood) of y in 0..categories-1, by scoring steps on sums of score products with halving."""
    cuts = categories - 1
    share = {r[y]: r["count"] for r in df.groupBy(y).count().collect()}  # a row for each category
    total, cum, theta = sum(share.values()), 0.0, []
    for c in range(cuts):
        cum += share.get(c, 0) / total
        theta.append(math.log(min(max(cum, 1e-6), 1 - 1e-6) / (1 - min(max(cum, 1e-6), 1 - 1e-6))) * (1.0 if link == "logit" else 0.6))
    params = np.array([*theta, *[0.0] * len(x)])

    def cdf(z: Column) -> Column:
        return 1 / (1 + F.exp(-z)) if link == "logit" else norm_cdf(z)

    def pdf(z: Column) -> Column:
        return cdf(z) * (1 - cdf(z)) if link == "logit" else F.exp(-z * z / 2) / math.sqrt(2 * math.pi)

    def rows(p: np.ndarray) -> DataFrame:
        d = df.select(F.col(y).alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x)])
        eta = linear([F.col(f"x{i}") for i in range(len(x))], p[cuts:])
        bounds = F.array(*[F.lit(float(c)) for c in p[:cuts]])
        d = d.withColumn("up", F.when(F.col("y") < cuts, F.get(bounds, F.col("y")) - eta)).withColumn("low", F.when(F.col("y") > 0, F.get(bounds, F.col("y") - 1) - eta))
        d = d.withColumn("pr", F.greatest(F.coalesce(cdf(F.col("up")), F.lit(1.0)) - F.coalesce(cdf(F.col("low")), F.lit(0.0)), F.lit(1e-300)))
        return d.withColumn("fu", F.coalesce(pdf(F.col("up")), F.lit(0.0)) / F.col("pr")).withColumn("fl", F.coalesce(pdf(F.col("low")), F.lit(0.0)) / F.col("pr"))

    def value(p: np.ndarray) -> float:
        return -np.inf if np.any(np.diff(p[:cuts]) <= 0) else rows(p).agg(F.sum(F.log("pr"))).first()[0]

    best = value(params)
    for _ in range(steps):
        at_cut = [F.when(F.col("y") == c, F.col("fu")).when(F.col("y") == c + 1, -F.col("fl")).otherwise(0.0) for c in range(cuts)]
        at_x = [(F.col("fl") - F.col("fu")) * F.col(f"x{i}") for i in range(len(x))]
        g = gram(rows(params), [*at_cut, *at_x, F.lit(1.0)])
        step = _solve(g[:-1, :-1], g[:-1, -1])
        size = 1.0
        while (new := value(params + size * step)) < best - 1e-9 and size > 1e-6:
            size /= 2
        gain, params, best = new - best, params + size * step, new
        if np.abs(g[:-1, -1]).max() < 1e-6 * total or abs(gain) < 1e-11 * abs(best):
            break
    return params[:cuts], params[cuts:], float(best)


def ridge_cv(df: DataFrame, y: str, x: Sequence[str], fold: Column, alphas: Sequence[float]) -> DataFrame:
    """(alpha, mse): held-out squared errors of ridge fits with an intercept and penalty alpha * n, averaged over folds.

    One pass sums the Gram matrix of each fold; a fold's training matrix is the total less its own, so fits for all alphas
    and their errors need no further rows.
    """
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in x], F.col(y).cast("double")]
    k = len(cols)
    named = df.select(fold.alias("f"), *[c.alias(f"c{i}") for i, c in enumerate(cols)]).na.drop()
    sums = named.groupBy("f").agg(*[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).collect()  # a row for each fold
    folds = []
    for r in sums:
        g = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                g[i, j] = g[j, i] = r[f"s{i}_{j}"]
        folds.append(g)
    total, out = sum(folds), []
    for alpha in alphas:
        errors = []
        for g in folds:
            t = total - g
            b = LinearModel(list(x), t, alpha * t[0, 0]).beta
            v = np.concatenate([b, [-1.0]])
            errors.append(float(v @ g @ v / g[0, 0]))
        out.append((float(alpha), float(np.mean(errors))))
    return df.sparkSession.createDataFrame(out, "alpha double, mse double")


def mixture_step(df: DataFrame, x: str, weights: Sequence[float], means: Sequence[float], variances: Sequence[float]) -> DataFrame:
    """(label, weight, mean, variance, loglik) after one EM step of a normal mixture: the posterior is a projection."""
    v = F.col(x).cast("double")
    logs = [math.log(w) - 0.5 * math.log(2 * math.pi * s) - (v - m) * (v - m) / (2 * s) for w, m, s in zip(weights, means, variances, strict=True)]
    rows = df.select(v.alias("v"), F.array(*logs).alias("l")).where("v IS NOT NULL")
    top = F.array_max("l")
    rows = rows.withColumn("all", top + F.log(F.aggregate("l", F.lit(0.0), lambda s, t: s + F.exp(t - top))))
    n, parts = F.count("*"), []
    for i in range(len(weights)):
        r = F.exp(F.get("l", F.lit(i)) - F.col("all"))
        mean = F.sum(r * F.col("v")) / F.sum(r)
        parts.append(F.struct(F.lit(i).alias("label"), (F.sum(r) / n).alias("weight"), mean.alias("mean"), (F.sum(r * F.col("v") * F.col("v")) / F.sum(r) - mean * mean).alias("variance"), F.sum("all").alias("loglik")))
    return rows.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("a")).select("a.*")


def mixture_fit(df: DataFrame, x: str, weights: Sequence[float], means: Sequence[float], variances: Sequence[float], steps: int = 100, tol: float = 1e-3) -> DataFrame:
    """The same after EM has gained less than tol in mean log-likelihood; variances stay over 1e-6."""
    n, last, got = max(df.count(), 1), -math.inf, None
    for _ in range(steps):
        got = mixture_step(df, x, weights, means, variances).collect()
        weights, means, variances = [r.weight for r in got], [r["mean"] for r in got], [max(r.variance, 1e-6) for r in got]
        if got[0].loglik / n - last < tol:
            break
        last = got[0].loglik / n
    return df.sparkSession.createDataFrame([(r.label, r.weight, r["mean"], r.variance, r.loglik) for r in got], "label int, weight double, mean double, variance double, loglik double")


def factor_step(df: DataFrame, x: Sequence[str], h: np.ndarray) -> tuple[Column, np.ndarray]:
    """One multiplicative update of a non-negative factorization x ~ w h from w = 1: w as an array column, and the new h.

    Rows carry w; the new h needs only w'x and w'w.
    """
    k, p, eps = *h.shape, 1e-10
    cols = [F.col(c).cast("double") for c in x]
    hh = h @ h.T
    w = [linear(cols, h[i]) / (float(hh[i].sum()) + eps) for i in range(k)]
    g = gram(df, [*w, *cols])
    return F.array(*w), h * g[:k, k:] / (g[:k, :k] @ h + eps)


def ledoit_wolf(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, float]:
    """(covariance, shrinkage): the sum of fourth powers of centred rows' lengths is one more aggregate."""
    terms = [F.lit(1.0), *[F.col(c) for c in columns]]
    g = gram(df, terms)
    n, mean = g[0, 0], g[0, 1:] / g[0, 0]
    s = g[1:, 1:] / n - np.outer(mean, mean)
    length = sum(((F.col(c) - float(m)) * (F.col(c) - float(m)) for c, m in zip(columns, mean, strict=True)), F.lit(0.0))
    fourth = df.agg(F.sum(length * length)).first()[0]
    mu = np.trace(s) / len(s)
    delta = (s**2).sum() - np.trace(s) ** 2 / len(s)
    beta = (fourth - n * (s**2).sum()) / n**2
    a = float(np.clip(beta / delta, 0, 1)) if delta > 0 else 0.0
    return (1 - a) * s + a * mu * np.eye(len(s)), a


def graphical_lasso(s: np.ndarray, alpha: float, sweeps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(covariance, precision) with off-diagonal precisions penalized by alpha, by block coordinate descent on the matrix."""
    p, w = len(s), s.copy()
    slopes = np.zeros((p, p))
    for _ in range(sweeps):
        old = w.copy()
        for j in range(p):
            rest = np.arange(p) != j
            v, b = w[np.ix_(rest, rest)], slopes[j, rest]
            for _ in range(500):
                before = b.copy()
                for i in range(p - 1):
                    z = s[rest, j][i] - v[i] @ b + v[i, i] * b[i]
                    b[i] = np.sign(z) * max(abs(z) - alpha, 0) / v[i, i]
                if np.abs(b - before).max() < 1e-12:
                    break
            slopes[j, rest] = b
            w[rest, j] = w[j, rest] = v @ b
        if np.abs(w - old).max() < 1e-10:
            break
    return w, np.linalg.inv(w)


def penalized_spline(df: DataFrame, y: str, basis: Sequence[Column], strengths: Sequence[float], order: int = 2) -> tuple[np.ndarray, float, float]:
    """(coefficients, strength, effective size) of the strength with the least generalized cross-validation, from one Gram matrix."""
    g = gram(df, [*basis, F.col(y), F.lit(1.0)])
    k = len(basis)
    a, b, yy, n = g[:k, :k], g[:k, k], g[k, k], g[k + 1, k + 1]
    d = np.diff(np.eye(k), n=order, axis=0)
    jitter = 1e-10 * np.trace(a) / k * np.eye(k)
    best: tuple[float, np.ndarray, float, float] | None = None
    for lam in strengths:
        m = a + lam * d.T @ d + jitter
        beta = np.linalg.solve(m, b)
        size = float(np.trace(np.linalg.solve(m, a)))
        score = (yy - 2 * beta @ b + beta @ a @ beta) / n / (1 - size / n) ** 2
        if best is None or score < best[0]:
            best = score, beta, float(lam), size
    assert best is not None, "no strengths given"
    return best[1], best[2], best[3]
