"""Panel estimators with any number of regressors: each is a transformation of the rows, one Gram matrix, and its errors."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import gram, linear
from .glm import result_rows


@dataclass
class PanelFit:
    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    n: float
    df_resid: float
    normal: bool
    sigma2: float
    extra: dict[str, float] = field(default_factory=dict)

    def table(self, df: DataFrame, alpha: float = 0.05) -> DataFrame:
        if not 0 < alpha < 1:
            raise ValueError("alpha lies between 0 and 1")
        return result_rows(df, self.names, self.beta, np.sqrt(np.clip(np.diag(self.cov), 0, None)), None if self.normal else self.df_resid, alpha)


def _clean(df: DataFrame, y: str, x: Sequence[str], keys: Sequence[str]) -> DataFrame:
    cols = [F.col(y).cast("double").alias("__y"), *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(x)], *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]]
    rows = df.select(*cols).na.drop()
    return rows.where(F.forall(F.array("__y", *[f"__x{i}" for i in range(len(x))]), lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))))


def _inverse(g: np.ndarray) -> np.ndarray:
    """Of sums scaled to a unit diagonal, as large means beside small spreads cost too many digits otherwise; the pseudoinverse
    where these are nearly singular."""
    d = np.sqrt(np.clip(np.diag(g), 1e-300, None))
    scaled = g / np.outer(d, d)
    return np.linalg.inv(scaled) / np.outer(d, d) if np.linalg.eigvalsh(scaled)[0] > 1e-12 else np.linalg.pinv(g)


def _solve(rows: DataFrame, terms: list[Column], absorbed: float, kind: str, clusters: Sequence[str], small: bool, order: str | None = None, lags: int | None = None) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """(beta, covariance, n, residual degrees, variance) of __y on terms. clusters: columns that scores are summed by; of two,
    the sums by both are taken off. hac: Bartlett's weights over rows in an order."""
    g = gram(rows, [*terms, F.col("__y"), F.lit(1.0)])
    k = len(terms)
    n, bread = g[k + 1, k + 1], _inverse(g[:k, :k])
    beta = bread @ g[:k, k]
    rss = g[k, k] - 2 * beta @ g[:k, k] + beta @ g[:k, :k] @ beta
    dof = n - k - absorbed
    if kind == "nonrobust":
        return beta, bread * rss / dof, n, dof, rss / dof
    u = F.col("__y") - linear(terms, beta)
    scores = [(u * t).alias(f"u{i}") for i, t in enumerate(terms)]
    names = [F.col(f"u{i}") for i in range(k)]
    by = rows.select(*scores, *[F.col(c) for c in clusters], *([F.col(order).alias("__o")] if order else []))
    if kind == "robust":
        meat = gram(by, names) * (n / dof if small else 1.0)
    elif kind == "clustered":
        summed = lambda d, c: gram(d.groupBy(*c).agg(*[F.sum(f"u{i}").alias(f"u{i}") for i in range(k)]), names)
        meat = summed(by, clusters[:1])
        if len(clusters) == 2:
            meat = meat + summed(by, clusters[1:]) - summed(by, clusters)
    elif kind == "hac":
        lags = math.floor(4 * (n / 100) ** (2 / 9)) if lags is None else lags
        # scores in order, those of equal order added up, so that lags are between distinct places; a row for each place
        at = by.groupBy("__o").agg(*[F.sum(f"u{i}").alias(f"u{i}") for i in range(k)])
        meat = newey_west(at, "__o", [f"u{i}" for i in range(k)], lags)
    else:
        raise ValueError(kind)
    return beta, bread @ meat @ bread, n, dof, rss / dof


def newey_west(rows: DataFrame, order: str, columns: Sequence[str], lags: int) -> np.ndarray:
    """Sum of products of rows with themselves and, weighted by Bartlett, with those up to so many places before."""
    k = len(columns)
    w = Window.orderBy(order)
    now = [F.col(c) for c in columns]
    out = rows.select(*now, *[F.coalesce(F.lag(c, h).over(w), F.lit(0.0)).alias(f"l{h}_{i}") for h in range(1, lags + 1) for i, c in enumerate(columns)])
    g = gram(out, [*now, *[F.col(f"l{h}_{i}") for h in range(1, lags + 1) for i in range(k)]])
    total = g[:k, :k].copy()
    for h in range(1, lags + 1):
        cross = g[:k, h * k : (h + 1) * k]
        total += (1 - h / (lags + 1)) * (cross + cross.T)
    return total


def fixed_effects(df: DataFrame, y: str, x: Sequence[str], entity: str | None = None, time: str | None = None, kind: str = "nonrobust", clusters: Sequence[str] = ()) -> PanelFit:
    """Within estimator with entity and/or time effects, for panels with or without gaps.

    Rows are centred by the first effect. The second, if any, enters as a column for each of its levels but one, centred
    alike: exact for any panel, with one Gram matrix as wide as the levels of the smaller effect.
    """
    keys = [k for k in (entity, time) if k]
    if not keys:
        raise ValueError("no effect is given")
    rows = _clean(df, y, x, [*keys, *clusters])
    levels = [rows.select(F.count_distinct(f"__k{i}")).first()[0] for i in range(len(keys))]
    large = int(np.argmax(levels))
    columns = ["__y", *[f"__x{i}" for i in range(len(x))]]
    dummies: list[str] = []
    if len(keys) == 2:
        other = f"__k{1 - large}"
        values = [r[0] for r in rows.select(other).distinct().orderBy(other).collect()][1:]  # the levels of the smaller effect
        for i, v in enumerate(values):
            rows = rows.withColumn(f"__d{i}", (F.col(other) == F.lit(v)).cast("double"))
            dummies.append(f"__d{i}")
    by = Window.partitionBy(f"__k{large}")
    extra = [f"__k{i}" for i in range(len(keys) + len(clusters))]
    rows = rows.select(*[(F.col(c) - F.avg(c).over(by)).alias(c) for c in [*columns, *dummies]], *extra)
    # dummies are nuisance columns: their coefficients are solved with the others and left out of the result
    terms = [F.col(c) for c in [*columns[1:], *dummies]]
    named = [f"__k{len(keys) + i}" for i in range(len(clusters))]
    beta, cov, n, dof, s2 = _solve(rows, terms, float(levels[large] - 1), kind, named, True)
    p = len(x)
    return PanelFit(list(x), beta[:p], cov[:p, :p], n, dof, kind != "nonrobust", s2, {"levels_" + k: float(v) for k, v in zip(keys, levels, strict=True)})


def effects(df: DataFrame, y: str, x: Sequence[str], m: PanelFit, key: str) -> DataFrame:
    """(key, effect): a level's mean residual less the mean of all rows."""
    u = F.col(y) - linear([F.col(c) for c in x], m.beta)
    rows = df.select(F.col(key), u.alias("u")).na.drop()
    mean = rows.agg(F.avg("u")).first()[0]
    return rows.groupBy(key).agg((F.avg("u") - mean).alias("effect"))


def predict(df: DataFrame, x: Sequence[str], m: PanelFit, found: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """df with `predicted`: the regressors' part, and the effect of a known level; the grand mean is not added."""
    if found is not None:
        df = df.join(found, key, "left")
    e = F.coalesce("effect", F.lit(0.0)) if found is not None else F.lit(0.0)
    out = df.withColumn("predicted", linear([F.col(c) for c in x], m.beta) + e)
    return out.drop("effect") if found is not None else out


def pooled(df: DataFrame, y: str, x: Sequence[str], kind: str = "nonrobust", clusters: Sequence[str] = (), order: str | None = None, lags: int | None = None) -> PanelFit:
    rows = _clean(df, y, x, [*clusters, *([order] if order else [])])
    terms = [F.lit(1.0), *[F.col(f"__x{i}") for i in range(len(x))]]
    beta, cov, n, dof, s2 = _solve(rows, terms, 0.0, kind, [f"__k{i}" for i in range(len(clusters))], True, f"__k{len(clusters)}" if order else None, lags)
    return PanelFit(["intercept", *x], beta, cov, n, dof, kind != "nonrobust", s2)


def between(df: DataFrame, y: str, x: Sequence[str], entity: str, kind: str = "nonrobust") -> PanelFit:
    """Least squares of entities' means, each with one weight."""
    rows = _clean(df, y, x, [entity])
    means = rows.groupBy("__k0").agg(*[F.avg(c).alias(c) for c in ["__y", *[f"__x{i}" for i in range(len(x))]]])
    terms = [F.lit(1.0), *[F.col(f"__x{i}") for i in range(len(x))]]
    beta, cov, n, dof, s2 = _solve(means, terms, 0.0, kind, [], True)
    return PanelFit(["intercept", *x], beta, cov, n, dof, kind != "nonrobust", s2)


def first_difference(df: DataFrame, y: str, x: Sequence[str], entity: str, time: str, kind: str = "nonrobust") -> PanelFit:
    """Least squares without intercept of changes from an entity's row before."""
    rows = _clean(df, y, x, [entity, time])
    w = Window.partitionBy("__k0").orderBy("__k1")
    names = ["__y", *[f"__x{i}" for i in range(len(x))]]
    changes = rows.select("__k0", *[(F.col(c) - F.lag(c).over(w)).alias(c) for c in names]).na.drop()
    beta, cov, n, dof, s2 = _solve(changes, [F.col(c) for c in names[1:]], 0.0, kind, ["__k0"] if kind == "clustered" else [], True)
    return PanelFit(list(x), beta, cov, n, dof, kind != "nonrobust", s2)


def random_effects(df: DataFrame, y: str, x: Sequence[str], entity: str) -> PanelFit:
    """Swamy and Arora's estimator. The between step has no intercept and weighs entities alike; variances are at least 0."""
    rows = _clean(df, y, x, [entity])
    p = len(x)
    names = ["__y", *[f"__x{i}" for i in range(p)]]
    means = rows.groupBy("__k0").agg(F.count("*").cast("double").alias("__n"), *[F.avg(c).alias(f"m{c}") for c in names])
    mx, my = [F.col(f"m__x{i}") for i in range(p)], F.col("m__y")
    counts = means.agg(F.count("*"), F.sum("__n"), F.sum(1 / F.col("__n"))).first()
    groups, total, harmonic = counts[0], counts[1], counts[0] / counts[2]
    centred = rows.join(means, "__k0")
    w = gram(centred.select(*[(F.col(c) - F.col(f"m{c}")).alias(c) for c in names]), [F.col(c) for c in [*names[1:], "__y"]])
    b = gram(means, [*mx, my])
    bw, bb = np.linalg.pinv(w[:p, :p]) @ w[:p, p], np.linalg.pinv(b[:p, :p]) @ b[:p, p]
    sse = w[p, p] - bw @ w[:p, p]
    s2e = sse / (total - p - (groups - 1))
    s2b = (b[p, p] - bb @ b[:p, p]) / max(groups - p, 1)
    s2a = max(0.0, (s2b - s2e) / harmonic)
    theta = 1 - F.sqrt(F.lit(s2e) / (s2e + F.col("__n") * s2a))
    moved = centred.select(*[(F.col(c) - theta * F.col(f"m{c}")).alias(c) for c in names])
    beta, cov, n, dof, s2 = _solve(moved, [F.col(c) for c in names[1:]], 0.0, "nonrobust", [], False)
    return PanelFit(list(x), beta, cov, n, dof, False, s2, {"sigma2_e": s2e, "sigma2_a": s2a})


def fama_macbeth(df: DataFrame, y: str, x: Sequence[str], time: str, kind: str = "newey-west", lags: int | None = None, least: int = 1) -> PanelFit:
    """Means of the coefficients of each period with rows enough; errors by their spread over periods, with Bartlett's weights.

    A period's regression comes from its own sums of products, one row for each period.
    """
    rows = _clean(df, y, x, [time])
    k = len(x) + 1
    cols = [F.lit(1.0), *[F.col(f"__x{i}") for i in range(len(x))], F.col("__y")]
    cells = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    sums = rows.groupBy("__k0").agg(*[F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i, j in cells]).orderBy("__k0").collect()
    betas = []
    for r in sums:
        g = np.zeros((k + 1, k + 1))
        for i, j in cells:
            g[i, j] = g[j, i] = r[f"g{i}_{j}"]
        if g[0, 0] >= max(least, k + 1):
            betas.append(np.linalg.pinv(g[:k, :k]) @ g[:k, k])
    b = np.array(betas)
    t, mean = len(b), b.mean(0)
    u = b - mean
    if kind == "newey-west":
        lags = math.floor(4 * (t / 100) ** (2 / 9)) if lags is None else lags
        s = u.T @ u / t
        for h in range(1, min(lags, t - 1) + 1):
            c = u[h:].T @ u[:-h] / t
            s += (1 - h / (lags + 1)) * (c + c.T)
        cov = s / t
    else:
        cov = u.T @ u / (t - 1) / t
    return PanelFit(["intercept", *x], mean, cov, t, t - 1, kind == "newey-west", float("nan"))


def factorize(df: DataFrame, column: str, name: str) -> tuple[DataFrame, int]:
    """df with the place of a label among the sorted distinct labels, from 0 (null stays null), and how many there are."""
    labels = df.select(F.col(column).alias("__l")).where("__l IS NOT NULL").distinct()
    codes = labels.withColumn(name, F.row_number().over(Window.orderBy("__l")) - 1)  # a row for each label
    n = labels.count()
    out = df.join(F.broadcast(codes) if n <= 100_000 else codes, F.col(column) == F.col("__l"), "left").drop("__l")
    return out, n


def dummies(df: DataFrame, column: str, first: bool = True) -> tuple[DataFrame, list[str]]:
    """df with a column of 0 and 1 for each level (but the first, if not `first`), and their names."""
    levels = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()][0 if first else 1 :]
    names = [f"{column}_{v}" for v in levels]
    return df.withColumns({n: F.when(F.col(column).isNotNull(), (F.col(column) == F.lit(v)).cast("double")) for n, v in zip(names, levels, strict=True)}), names
