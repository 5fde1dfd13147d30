"""Covariance, decomposition, clustering, kernel smoothing and resampling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import KERNELS
from ..plans import gram
from ..plans.ranks import ranged, running


def covariance(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, float]:
    """(covariance with divisor n, means, n) in one aggregate."""
    g = gram(df, [F.lit(1.0), *[F.col(c) for c in columns]])
    n, mean = g[0, 0], g[0, 1:] / g[0, 0]
    return g[1:, 1:] / n - np.outer(mean, mean), mean, n


def shrunk(s: np.ndarray, amount: float) -> np.ndarray:
    return (1 - amount) * s + amount * np.trace(s) / len(s) * np.eye(len(s))


def oas(s: np.ndarray, n: float) -> tuple[np.ndarray, float]:
    """Oracle-approximating shrinkage of a covariance, and its amount."""
    p = len(s)
    mu = np.trace(s) / p
    alpha = (s**2).mean()
    den = (n + 1) * (alpha - mu**2 / p)
    amount = 1.0 if den == 0 else min((alpha + mu**2) / den, 1.0)
    return shrunk(s, amount), amount


def mahalanobis(df: DataFrame, columns: Sequence[str]) -> Column:
    """Squared distance of a row from the means in the metric of the inverse covariance."""
    s, mean, _ = covariance(df, columns)
    inv = np.linalg.pinv(s)
    out = F.lit(0.0)
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            out = out + (F.col(a) - float(mean[i])) * (F.col(b) - float(mean[j])) * float(inv[i, j])
    return out


def pca(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(explained variances, components as rows): largest first, each component's largest loading positive."""
    s, _, n = covariance(df, columns)
    values, vectors = np.linalg.eigh(s * n / (n - 1))
    order = np.argsort(-values)
    v = vectors[:, order].T
    return values[order], v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]


def _distance(columns: Sequence[str], centre: Sequence[float]) -> Column:
    out = F.lit(0.0)
    for c, m in zip(columns, centre, strict=True):
        out = out + (F.col(c) - float(m)) * (F.col(c) - float(m))
    return out


def assign(df: DataFrame, columns: Sequence[str], centres: Sequence[Sequence[float]]) -> DataFrame:
    """df with `label` (nearest centre, ties to the first) and `d2`."""
    d = F.array(*[_distance(columns, c) for c in centres])
    out = df.withColumn("__d", d).withColumn("d2", F.array_min("__d"))
    return out.withColumn("label", (F.array_position("__d", F.col("d2")) - 1).cast("int")).drop("__d")


def kmeans_step(df: DataFrame, columns: Sequence[str], centres: Sequence[Sequence[float]]) -> DataFrame:
    """(label, n, inertia, mean of each column): one Lloyd step, one aggregate."""
    return assign(df, columns, centres).groupBy("label").agg(F.count("*").alias("n"), F.sum("d2").alias("inertia"), *[F.avg(c).alias(c) for c in columns])


def kmeans(df: DataFrame, columns: Sequence[str], centres: Sequence[Sequence[float]], steps: int = 20) -> list[list[float]]:
    """Centres after Lloyd steps; a centre without points stays where it is."""
    now = [list(map(float, c)) for c in centres]
    for _ in range(steps):
        new = list(now)
        for r in kmeans_step(df, columns, now).collect():  # a row for each centre
            new[r.label] = [r[c] for c in columns]
        if np.abs(np.array(new) - np.array(now)).max() < 1e-9:
            break
        now = new
    return now


def clusters_1d(df: DataFrame, x: str, id_col: str, gap: float) -> DataFrame:
    """(id, label): single-linkage clusters on a line, cut where neighbours are further apart than `gap`."""
    dealt, ranges = ranged(df.select(F.col(id_col).alias("id"), F.col(x).alias("x")), "x")
    before = F.lag("x").over(Window.partitionBy("__range").orderBy("x", "id"))
    tops = {r["__range"]: r.m for r in dealt.groupBy("__range").agg(F.max("x").alias("m")).collect()}  # a row for each range
    last = {i: max((tops[j] for j in tops if j < i), default=None) for i in range(ranges)}
    first = F.element_at(F.array(*[F.lit(last[i]).cast("double") for i in range(ranges)]), F.col("__range") + 1)
    cut = F.when(F.col("x") - F.coalesce(before, first) > gap, 1.0).otherwise(0.0)
    out = running(dealt.withColumn("__cut", cut), ranges, F.col("__cut"), [F.asc("x"), F.asc("id")], "sum", "__label")
    return out.select("id", F.col("__label").cast("long").alias("label"))


def _two_sum(a: Column, b: Column) -> tuple[Column, Column]:
    """a + b as doubles have it, and what it is off by."""
    s = a + b
    c = s - a
    return s, (a - (s - c)) + (b - c)


def _end(x: Column, eps: float, side: int) -> tuple[Column, Column]:
    """Where the rows within eps of x end above (side 1) or below (-1): a double and a place among what is equal to it, in which
    rows have 1. Differences are rounded, so rows lie within eps up to half a step of doubles beyond it."""
    half = float(np.nextafter(eps, np.inf) - eps) / 2
    far, off = _two_sum(x, F.lit(side * float(eps)))
    rest, least = _two_sum(off, F.lit(side * half))
    key, over = _two_sum(far, rest)
    even = int(np.float64(eps).view(np.int64)) % 2 == 0  # a tie is rounded to eps
    at = 2 if even == (side > 0) else 0
    return key + F.lit(0.0), (3 * F.signum(F.when(over != 0, over).otherwise(least)) + at).cast("int")


def neighbours_within(df: DataFrame, x: str, id_col: str, eps: float) -> DataFrame:
    """(id, n): rows with |x - x'| <= eps on a line, itself included: how many lie up to the upper end less how many lie before
    the lower one. Rows without a finite x are left out.

    Rows and their two ends are put in one order and counted by a running sum, so close rows don't meet one by one. Ends are
    those of the rounded difference, not of a rounded x + eps, so that counts are those of all pairs.
    """
    value = F.col(x).cast("double")
    rows = df.select(F.col(id_col).alias("id"), (value + F.lit(0.0)).alias("x")).where(F.abs("x") < float("inf"))
    low, high = _end(F.col("x"), eps, -1), _end(F.col("x"), eps, 1)
    ends = [(F.col("x"), F.lit(1), 1.0, 0.0), (*low, 0.0, -1.0), (*high, 0.0, 1.0)]
    parts = [rows.select("id", k.alias("k"), o.alias("o"), F.lit(c).alias("c"), F.lit(t).alias("t")) for k, o, c, t in ends]
    dealt, ranges = ranged(parts[0].union(parts[1]).union(parts[2]), "k")
    counted = running(dealt, ranges, F.col("c"), [F.asc("k"), F.asc("o")], "sum", "s")
    return counted.where("t <> 0").groupBy("id").agg(F.sum(F.col("t") * F.col("s")).cast("long").alias("n"))


def kde(df: DataFrame, x: str, points: Sequence[float], bandwidth: float, kernel: str) -> DataFrame:
    """(point, density): a kernel density at some points; one aggregate with a column for each."""
    k = KERNELS[kernel]
    sums = [F.avg(k((F.lit(float(p)) - F.col(x)) / bandwidth) / bandwidth) for p in points]
    row = df.agg(F.array(*[F.struct(F.lit(float(p)).alias("point"), s.alias("density")) for p, s in zip(points, sums, strict=True)]).alias("a"))
    return row.select(F.explode("a").alias("a")).select("a.point", "a.density")


def bandwidths(df: DataFrame, x: str) -> DataFrame:
    """(scott, silverman, nrd0) rules of thumb."""
    s = df.agg(F.stddev_samp(x).alias("s"), F.count("*").alias("n"), (F.percentile(x, 0.75) - F.percentile(x, 0.25)).alias("iqr"))
    fifth = F.pow(F.col("n").cast("double"), F.lit(-0.2))
    return s.select((F.col("s") * fifth).alias("scott"), (F.col("s") * F.pow(F.col("n") * 0.75, F.lit(-0.2))).alias("silverman"), (0.9 * F.least("s", F.col("iqr") / 1.34) * fifth).alias("nrd0"))


def kernel_regression(df: DataFrame, x: str, y: str, points: Sequence[float], bandwidth: float, kernel: str = "gaussian", linear: bool = False) -> DataFrame:
    """(point, fit): local constant or local linear regression at some points; one aggregate."""
    out = []
    for p in points:
        d = F.col(x) - float(p)
        w = KERNELS[kernel](d / bandwidth)
        s0, t0 = F.sum(w), F.sum(w * F.col(y))
        s1, s2, t1 = F.sum(w * d), F.sum(w * d * d), F.sum(w * d * F.col(y))
        fit = (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) if linear else t0 / s0
        out.append(F.struct(F.lit(float(p)).alias("point"), fit.alias("fit")))
    return df.agg(F.array(*out).alias("a")).select(F.explode("a").alias("a")).select("a.point", "a.fit")


def bspline(x: Column, knots: Sequence[float], degree: int, i: int) -> Column:
    """The i-th B-spline basis function of a degree on knots, by the Cox-de Boor recursion."""
    if degree == 0:
        return F.when((x >= knots[i]) & (x < knots[i + 1]), 1.0).otherwise(0.0)
    out = F.lit(0.0)
    if knots[i + degree] > knots[i]:
        out = out + (x - knots[i]) / (knots[i + degree] - knots[i]) * bspline(x, knots, degree - 1, i)
    if knots[i + degree + 1] > knots[i + 1]:
        out = out + (knots[i + degree + 1] - x) / (knots[i + degree + 1] - knots[i + 1]) * bspline(x, knots, degree - 1, i + 1)
    return out
