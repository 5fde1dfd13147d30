"""Least squares, ridge and generalized linear models from Gram matrices, one aggregate a fit or step."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import f_sf
from ..plans import gram, linear
from ..plans.ranks import ranked

#: Rows of a block that autocorrelations are summed in, if lags are fewer.
HAC_BLOCK = 65_536


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a^-1 b, by the pseudoinverse where a scaled a is nearly singular."""
    d = np.sqrt(np.clip(np.diag(a), 1e-300, None))
    scaled = a / np.outer(d, d)
    inv = np.linalg.inv(scaled) if np.linalg.eigvalsh(scaled)[0] > 1e-12 else np.linalg.pinv(scaled, rcond=1e-10)
    return (inv / np.outer(d, d)) @ b


class LinearModel:
    """Coefficients with an intercept first, and what follows from the Gram matrix of (1, x, y)."""

    def __init__(self, names: Sequence[str], g: np.ndarray, alpha: float = 0.0):
        p = len(names)
        self.names = ["intercept", *names]
        self.n = g[0, 0]
        mean = g[0, 1:] / self.n
        # centred, so that large means don't cancel
        c = g[1:, 1:] - self.n * np.outer(mean, mean)
        slope = _solve(c[:p, :p] + alpha * np.eye(p), c[:p, p])
        self.beta = np.concatenate([[mean[p] - slope @ mean[:p]], slope])
        self.tss = c[p, p]
        self.rss = c[p, p] - 2 * slope @ c[:p, p] + slope @ c[:p, :p] @ slope
        self.df = self.n - p - 1
        ridge = alpha * np.diag([0.0, *[1.0] * p])
        self.bread = _solve(g[: p + 1, : p + 1] + ridge, np.eye(p + 1))
        # with a penalty, the sums between its inverses; without, the inverse alone
        middle = self.bread @ g[: p + 1, : p + 1] @ self.bread if alpha else self.bread
        self.se = np.sqrt(np.diag(middle) * self.rss / self.df)

    def stats(self) -> dict[str, float]:
        n, p = self.n, len(self.beta) - 1
        r2 = 1 - self.rss / self.tss if self.tss > 0 else 0.0
        llf = -n / 2 * (np.log(2 * np.pi * self.rss / n) + 1)
        f = ((self.tss - self.rss) / p) / (self.rss / self.df) if self.rss > 0 else float("inf")
        return {"r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / self.df, "f": f, "f_p": f_sf(f, p, self.df) if np.isfinite(f) else 0.0, "llf": llf, "aic": -2 * llf + 2 * (p + 1), "bic": -2 * llf + np.log(n) * (p + 1), "sigma2": self.rss / self.df}

    def score(self, df: DataFrame, y: str) -> float:
        """R squared on any rows."""
        e = F.col(y) - self.predict([F.col(c) for c in self.names[1:]])
        r = df.agg(F.sum(e * e), F.var_pop(y), F.count(y)).first()
        return 1 - r[0] / (r[1] * r[2]) if r[1] else 0.0

    def predict(self, terms: Sequence[Column]) -> Column:
        return linear([F.lit(1.0), *terms], self.beta)


def ols(df: DataFrame, y: str, x: Sequence[str], weight: str | None = None, alpha: float = 0.0) -> LinearModel:
    """Least squares with an intercept. alpha: a ridge penalty on the mean loss, so alpha * n is added to the sums (with
    weights, alpha times their sum)."""
    columns = [F.lit(1.0), *[F.col(c) for c in x], F.col(y)]
    g = gram(df, columns, None if weight is None else F.col(weight))
    return LinearModel(x, g, alpha * g[0, 0])


def coefficients(df: DataFrame, m: LinearModel) -> DataFrame:
    """(term, estimate, std_err, t)."""
    rows = [(n, float(b), float(s), float(b / s)) for n, b, s in zip(m.names, m.beta, m.se, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, std_err double, t double")


def hac_lags(n: float, lags: int | None = None) -> int:
    return int(min(max(np.floor(4 * (n / 100) ** (2 / 9)) if lags is None else lags, 0), n - 1))


def robust(df: DataFrame, y: str, x: Sequence[str], kind: str, order: str | None = None, lags: int | None = None) -> np.ndarray:
    """Standard errors from one more pass for the meat: hc0 to hc3, or hac, with Bartlett's weights over rows in an order (a
    whole number that rows follow each other by)."""
    m = ols(df, y, x)
    terms = [F.lit(1.0), *[F.col(c) for c in x]]
    e = F.col(y) - m.predict(terms[1:])
    if kind == "hac":
        meat = _hac_meat(df.select(F.col(order).alias("__o"), *[(e * t).alias(f"u{i}") for i, t in enumerate(terms)]), len(terms), hac_lags(m.n, lags))
    else:
        w = e * e * (float(m.n / m.df) if kind == "hc1" else 1.0)
        if kind in ("hc2", "hc3"):
            left = 1 - F.least(F.greatest(_quadratic(terms, m.bread), F.lit(0.0)), F.lit(1 - 1e-12))
            w = w / (left if kind == "hc2" else left * left)
        elif kind not in ("hc0", "hc1"):
            raise ValueError(kind)
        meat = gram(df, terms, w)
    return np.sqrt(np.diag(m.bread @ meat @ m.bread))


def _hac_meat(scores: DataFrame, k: int, lags: int) -> np.ndarray:
    """Rows are ranked over the whole table in ranges, and dealt into blocks of ranks that follow each other; a block also gets the
    last `lags` rows of the one before. What blocks add is one number for each two columns."""
    rows, _, _ = ranked(scores, "__o", rank="__r")
    names = [f"u{i}" for i in range(k)]
    rows = rows.select("__r", *names)
    total = gram(rows, [F.col(n) for n in names])
    if not lags:
        return total
    size = max(HAC_BLOCK, lags)
    block, place = F.floor((F.col("__r") - 1) / size), (F.col("__r") - 1) % size
    dealt = rows.withColumn("__b", F.explode(F.when(place >= size - lags, F.array(block, block + 1)).otherwise(F.array(block))))

    def cross(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("__r")
        u = np.nan_to_num(b[names].to_numpy(float))  # a row with a null keeps its place and adds nothing
        own = int((b["__r"] <= key[0] * size).sum())
        out = np.zeros((k, k))
        for h in range(1, min(lags, len(u) - 1) + 1):
            at = max(own, h)
            out += (1 - h / (lags + 1)) * (u[at:].T @ u[at - h : len(u) - h])
        return pd.DataFrame({"cell": np.arange(k * k), "value": out.ravel()})

    sums = dealt.groupBy("__b").applyInPandas(cross, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros(k * k)
    for r in sums.collect():  # a row for each two columns
        out[r.cell] = r.value
    out = out.reshape(k, k)
    return total + out + out.T


def _quadratic(terms: Sequence[Column], m: np.ndarray) -> Column:
    out = F.lit(0.0)
    for i, a in enumerate(terms):
        for j, b in enumerate(terms):
            out = out + a * b * float(m[i, j])
    return out


def vif(df: DataFrame, x: Sequence[str]) -> DataFrame:
    """(term, vif): 1 / (1 - R squared) of each column on the others; infinite where the others give it wholly."""
    g = gram(df, [F.lit(1.0), *[F.col(c) for c in x]])
    c = g[1:, 1:] / g[0, 0] - np.outer(g[0, 1:], g[0, 1:]) / g[0, 0] ** 2
    d = np.sqrt(np.clip(np.diag(c), 1e-300, None))
    r = c / np.outer(d, d)
    whole = np.linalg.eigvalsh(r)[0] < 1e-12
    v = np.full(len(x), np.inf) if whole else np.diag(np.linalg.inv(r))
    return df.sparkSession.createDataFrame([(n, float(a)) for n, a in zip(x, v, strict=True)], "term string, vif double")


def leverage(df: DataFrame, y: str, x: Sequence[str], m: LinearModel) -> DataFrame:
    """df with h, resid, standard, student (internally studentized), external (by the scale without the row) and cooks."""
    terms = [F.lit(1.0), *[F.col(c) for c in x]]
    s2, p = float(m.rss / m.df), len(terms)
    out = df.withColumn("h", _quadratic(terms, m.bread)).withColumn("resid", F.col(y) - m.predict(terms[1:]))
    out = out.withColumn("student", F.col("resid") / F.sqrt(s2 * (1 - F.col("h")))).withColumn("standard", F.col("resid") / float(np.sqrt(s2)))
    t2 = F.col("student") * F.col("student")
    out = out.withColumn("external", F.col("student") * F.sqrt((m.df - 1) / (m.df - t2)))
    return out.withColumn("cooks", F.col("student") * F.col("student") * F.col("h") / (1 - F.col("h")) / p)


def pearson_dispersion(df: DataFrame, y: str, mean: Column, variance: Column, params: int) -> DataFrame:
    """(phi): Pearson's chi-square over the residual degrees of freedom, at least 1."""
    r = F.col(y) - mean
    return df.agg((F.sum(r * r / variance) / F.greatest(F.count("*") - params, F.lit(1))).alias("phi"))


def coordinate_descent(g: np.ndarray, penalty: str, strength: float, mixing: float = 1.0, sweeps: int = 500) -> np.ndarray:
    """Penalized least squares (1/2n scale) from the Gram matrix of standardized (x, y): lasso, elastic net, SCAD, MCP."""
    p = len(g) - 1
    b = np.zeros(p)
    for _ in range(sweeps):
        old = b.copy()
        for j in range(p):
            v = g[j, j]
            z = g[j, p] - g[j, :p] @ b + v * b[j]
            a = abs(z)
            if penalty in ("lasso", "elastic_net"):
                b[j] = np.sign(z) * max(a - strength * mixing, 0) / (v + strength * (1 - mixing))
            elif penalty == "mcp":
                b[j] = np.sign(z) * max(a - strength, 0) / (v - 1 / 3) if a <= 3 * strength * v else z / v
            else:
                b[j] = np.sign(z) * max(a - strength, 0) / v if a <= 2 * strength else ((2.7 * z - np.sign(z) * 3.7 * strength) / (2.7 * v - 1) if a <= 3.7 * strength * v else z / v)
        if np.abs(b - old).max() < 1e-12:
            break
    return b
