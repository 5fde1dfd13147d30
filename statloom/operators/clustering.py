"""Clusters of rows in several dimensions: density, linkage, k-means with seeding and small batches, normal mixtures."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import block_sums, doubles
from ..plans.components import components, kept
from ..plans.ranks import ranged, ranked, running
from .multivariate import assign, kmeans, kmeans_step
from .resampling import PRIME, mixed

#: Rows of a block of a dense cell, and the most dimensions that cells are cut in (distances use all).
CELL_BLOCK, CUT = 2048, 3
#: Rows of a block that meet another block at once; the first close pair ends the search.
NEAR_ROWS = 64
#: Rows that linkage takes at most, as its distances are held at once.
LINKAGE_ROWS = 10_000


def _distance2(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, t: s + t)


def dbscan(df: DataFrame, columns: Sequence[str], id_col: str, eps: float, min_samples: int) -> DataFrame:
    """(id, label, core): clusters by density, numbered from 0 by their smallest core id; -1 for noise.

    A row is core if at least min_samples rows, itself included, lie within eps. Core rows within eps share a cluster; other
    rows take that of the core row with the smallest id within eps. Rows are dealt into cells whose rows all lie within eps of
    each other (in the cut dimensions): a cell with min_samples rows or more is core as a whole and one cluster, so no pairs
    are made inside it. Rows of other cells, each of fewer rows, meet the rows of the cells around them. Two dense
    cells are linked by the first close pair of their rows, looked for in blocks.
    """
    cut = min(len(columns), CUT)
    whole = cut == len(columns)
    side = eps / math.sqrt(cut)
    v = F.array(*[F.col(c).cast("double") for c in columns])
    cells = F.array(*[F.floor(F.col(c).cast("double") / side).cast("long") for c in columns[:cut]])
    rows = df.select(F.col(id_col).alias("id"), v.alias("v"), cells.alias("cell")).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    sizes = rows.groupBy("cell").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    # where cells are cut in fewer dimensions than there are, no cell is dense as a whole
    dense = (F.col("size") >= min_samples) if whole else F.lit(False)
    rows = kept(rows.join(sizes, "cell").withColumn("dense", dense))
    reach = range(-math.ceil(math.sqrt(cut)), math.ceil(math.sqrt(cut)) + 1)
    around = [o for o in itertools.product(reach, repeat=cut) if sum(max(abs(x) - 1, 0) ** 2 for x in o) < cut + 1e-9]
    shifts = F.array(*[F.array(*[F.lit(x).cast("long") for x in o]) for o in around])
    near = lambda d: d.withColumn("o", F.explode(shifts)).withColumn("cell", F.zip_with("cell", "o", lambda a, b: a + b)).drop("o")
    sparse = rows.where("NOT dense").select("id", "v", "cell")
    met = near(sparse).toDF("a", "va", "cell").join(rows.select(F.col("id").alias("b"), F.col("v").alias("vb"), "cell", "dense", "first"), "cell")
    met = kept(met.where(_distance2("va", "vb") <= eps * eps).select("a", "b", "dense", "first"))
    core = met.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples).select(F.col("a").alias("id"))
    # a dense cell stands for its rows under its smallest id
    edges = met.join(core.withColumnRenamed("id", "a"), "a", "left_semi")
    to_sparse = edges.where("NOT dense").join(core.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")
    to_dense = edges.where("dense").select("a", F.col("first").alias("b")).distinct()
    links = to_sparse.union(to_dense).union(_dense_links(rows.where("dense"), near, eps))
    labels = components(links)
    members = rows.where("dense").select("id", F.col("first").alias("at")).union(core.select("id", F.col("id").alias("at")))
    found = members.join(labels.select(F.col("id").alias("at"), "component"), "at", "left").select("id", F.coalesce("component", "at").alias("cluster"))
    found = kept(found)
    border = met.join(found.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min_by("cluster", "b").alias("cluster")).withColumnRenamed("a", "id").join(found, "id", "left_anti")
    least = found.groupBy("cluster").agg(F.min("id").alias("first"))
    number = least.select("cluster", (F.row_number().over(Window.orderBy("first")) - 1).alias("label"))  # a row for each cluster
    labelled = found.select("id", "cluster", F.lit(True).alias("core")).union(border.select("id", "cluster", F.lit(False))).join(number, "cluster").select("id", "label", "core")
    return rows.select("id").join(labelled, "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("core", F.lit(False)).alias("core"))


def _dense_links(rows: DataFrame, near, eps: float) -> DataFrame:
    """(a, b): the first ids of dense cells that have a pair of rows within eps."""
    points = rows.select("cell", "first", "v").distinct()  # copies link nothing more
    sizes = points.groupBy("cell").agg(F.count("*").alias("points"))
    blocks = points.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("v"), F.ceil(F.col("points") / CELL_BLOCK)))
    packed = kept(blocks.groupBy("cell", "first", "block").agg(F.flatten(F.collect_list("v")).alias("vs"), F.first(F.size("v")).alias("d")))  # about CELL_BLOCK rows each
    other = packed.select("cell", F.col("first").alias("b"), F.col("vs").alias("wb"))
    pairs = near(packed.select(F.col("first").alias("a"), F.col("vs").alias("wa"), "d", "cell")).join(other, "cell").where("a < b").select("a", "b", "d", "wa", "wb")

    def close(batches):
        for p in batches:
            hit = []
            for x, y, k in zip(p.wa, p.wb, p.d, strict=True):
                x, y = x.reshape(-1, k), y.reshape(-1, k)
                hit.append(any(_meet(x[i : i + NEAR_ROWS], y, eps) for i in range(0, len(x), NEAR_ROWS)))
            yield p.loc[hit, ["a", "b"]]

    return pairs.mapInPandas(close, "a long, b long").distinct()


def _meet(x: np.ndarray, y: np.ndarray, eps: float) -> bool:
    """Whether a row of x lies within eps of one of y. Products tell who may, about a row of x, so that they keep their digits."""
    u, v = x - x[0], y - x[0]
    d = (u**2).sum(1)[:, None] + (v**2).sum(1)[None] - 2 * u @ v.T
    i, j = np.nonzero(d <= eps * eps * (1 + 1e-6))
    return bool((((x[i] - y[j]) ** 2).sum(1) <= eps * eps).any())


def agglomerative(df: DataFrame, columns: Sequence[str], id_col: str, clusters: int, linkage: str = "single", most: int = LINKAGE_ROWS) -> DataFrame:
    """(id, label): the rows merged pair by pair until so many clusters are left; numbered from 0 by their smallest id.

    linkage: single, complete, average or ward. Single linkage of one column takes any number of rows: it cuts the line at its
    widest gaps. Otherwise all distances are held on the driver, as a merge may need any of them: more than `most` rows are an error.
    """
    if linkage == "single" and len(columns) == 1:
        return _cut_line(df, columns[0], id_col, clusters)
    rows = df.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).na.drop()
    if (n := rows.count()) > most:
        raise ValueError(f"{n} rows; linkage takes at most {most}")
    data = rows.orderBy("id").toPandas()
    labels = link(data.drop(columns="id").to_numpy(), clusters, linkage)
    return df.sparkSession.createDataFrame([(i.item() if hasattr(i, "item") else i, int(k)) for i, k in zip(data.id, labels, strict=True)], f"id {rows.schema['id'].dataType.simpleString()}, label int")


def _cut_line(df: DataFrame, column: str, id_col: str, clusters: int) -> DataFrame:
    """(id, label): rows in the order of a column, then id, cut at the clusters - 1 widest gaps; of equal gaps, at the first."""
    rows = df.select(F.col(id_col).alias("id"), F.col(column).cast("double").alias("x")).na.drop()
    dealt, ranges = ranged(rows, "x", "__at")
    tops = {r["__at"]: r.m for r in dealt.groupBy("__at").agg(F.max("x").alias("m")).collect()}  # a row for each range
    last = F.element_at(F.array(*[F.lit(max((tops[j] for j in tops if j < i), default=None)).cast("double") for i in range(ranges)]), F.col("__at") + 1)
    before = F.coalesce(F.lag("x").over(Window.partitionBy("__at").orderBy("x", "id")), last)
    gaps = dealt.withColumn("__gap", F.coalesce(before - F.col("x"), F.lit(1.0)))  # falling; the first row has none and comes last
    cut = ranked(gaps, "__gap", "x", "id")[0].withColumn("__cut", ((F.col("rank") < clusters) & (F.col("__gap") <= 0)).cast("double"))
    cut = cut.drop("__range").withColumnRenamed("__at", "__range")
    parts = running(cut, ranges, F.col("__cut"), [F.asc("x"), F.asc("id")], "sum", "__part").select("id", "__part")
    least = parts.groupBy("__part").agg(F.min("id").alias("first"))
    number = least.select("__part", (F.row_number().over(Window.orderBy("first")) - 1).alias("label"))  # a row for each cluster
    return parts.join(number, "__part").select("id", "label")


def link(x: np.ndarray, clusters: int, linkage: str) -> np.ndarray:
    """Labels by first row, from the Lance-Williams updates of a distance matrix (squared for ward)."""
    n = len(x)
    d = np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T, 0)
    if linkage != "ward":
        d = np.sqrt(d)
    np.fill_diagonal(d, np.inf)
    size, label, live = np.ones(n), np.arange(n), n
    while live > max(1, clusters):
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        a, b = d[i].copy(), d[j].copy()
        if linkage == "single":
            new = np.minimum(a, b)
        elif linkage == "complete":
            new = np.maximum(a, b)
        elif linkage == "average":
            new = (size[i] * a + size[j] * b) / (size[i] + size[j])
        elif linkage == "ward":
            with np.errstate(invalid="ignore"):
                new = ((size[i] + size) * a + (size[j] + size) * b - size * d[i, j]) / (size[i] + size[j] + size)
        else:
            raise ValueError(linkage)
        dead = np.isinf(a) & np.isinf(b)
        new[dead] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        d[i, i] = np.inf
        size[i] += size[j]
        label[label == j] = i
        live -= 1
    return np.unique(label, return_inverse=True)[1]


def seeds(df: DataFrame, columns: Sequence[str], id_col: str, k: int, seed: int = 0) -> list[list[float]]:
    """k starting centres: each next row is drawn with a chance in proportion to its squared distance from the nearest centre.

    The draw is a race: the row with the least -log(u) / weight wins, with u a function of its id, so it is one aggregate.
    """
    x = [F.col(c).cast("double") for c in columns]
    rows = df.select(F.col(id_col).alias("id"), *[c.alias(f"c{i}") for i, c in enumerate(x)]).na.drop()
    names, centres = [f"c{i}" for i in range(len(columns))], []
    for step in range(k):
        u = (mixed(F.col("id"), F.lit(seed + step)) + 1) / (float(PRIME) * float(PRIME))
        weight = F.lit(1.0) if not centres else F.array_min(F.array(*[sum(((F.col(n) - float(m)) * (F.col(n) - float(m)) for n, m in zip(names, c, strict=True)), F.lit(0.0)) for c in centres]))
        race = rows.withColumn("w", weight).where("w > 0").withColumn("t", -F.log(u) / F.col("w"))
        best = race.agg(F.min_by(F.array(*names), F.struct("t", "id"))).first()[0]
        if best is None:  # fewer distinct rows than centres
            break
        centres.append([float(b) for b in best])
    return centres


def kmeans_fit(df: DataFrame, columns: Sequence[str], id_col: str, k: int, seed: int = 0, steps: int = 300) -> list[list[float]]:
    return kmeans(df, columns, seeds(df, columns, id_col, k, seed), steps)


class MiniBatchKMeans:
    """Centres moved by batches, each centre by its share of all rows it was given so far."""

    def __init__(self, centres: Sequence[Sequence[float]]):
        self.centres, self.counts = np.array(centres, float), np.zeros(len(centres))

    def partial_fit(self, batch: DataFrame, columns: Sequence[str]) -> MiniBatchKMeans:
        for r in kmeans_step(batch, columns, self.centres.tolist()).collect():  # a row for each centre
            self.counts[r.label] += r.n
            self.centres[r.label] += r.n / self.counts[r.label] * (np.array([r[c] for c in columns]) - self.centres[r.label])
        return self

    def fit(self, df: DataFrame, columns: Sequence[str], id_col: str, batches: int = 8, polish: int = 2) -> MiniBatchKMeans:
        """All rows once, in batches drawn by a hash of the id, then some steps over all rows."""
        dealt = df.withColumn("__batch", mixed(F.col(id_col), F.lit(0)) % batches)
        for i in range(batches):
            self.partial_fit(dealt.where(F.col("__batch") == i), columns)
        self.centres = np.array(kmeans(df, columns, self.centres.tolist(), polish))
        return self

    def predict(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        return assign(df, columns, self.centres.tolist())


class GaussianMixture:
    """A mixture of normal parts with full, tied, diag or spherical covariances, by EM: one pass of blocks a step."""

    def __init__(self, parts: int, kind: str = "full", floor: float = 1e-6, tol: float = 1e-3, steps: int = 100):
        self.parts, self.kind, self.floor, self.tol, self.steps = parts, kind, floor, tol, steps

    def _shaped(self, s: np.ndarray, weight: np.ndarray) -> np.ndarray:
        k, p = self.parts, s.shape[1]
        if self.kind == "tied":
            s = np.broadcast_to(np.einsum("k,kij->ij", weight, s), s.shape)
        if self.kind == "diag":
            s = np.stack([np.diag(np.diag(x)) for x in s])
        if self.kind == "spherical":
            s = np.stack([np.eye(p) * np.trace(x) / p for x in s])
        return s + self.floor * np.eye(p) * np.ones((k, 1, 1))

    @staticmethod
    def _logs(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> np.ndarray:
        out = []
        for w, m, c in zip(weights, means, covariances, strict=True):
            root = np.linalg.cholesky(c)
            z = np.linalg.solve(root, x - m[:, None])
            out.append(np.log(w) - 0.5 * (len(m) * np.log(2 * np.pi) + (z**2).sum(0)) - np.log(np.diag(root)).sum())
        return np.stack(out)

    def fit(self, df: DataFrame, columns: Sequence[str], means: Sequence[Sequence[float]], variance: Sequence[float] | None = None) -> GaussianMixture:
        """From means, equal weights, and the columns' variances (given, or the whole table's)."""
        rows = doubles(df, columns).persist()
        k, p = self.parts, len(columns)
        try:
            n = rows.count()
            if variance is None:
                variance = [r or 1.0 for r in rows.agg(*[F.var_pop(c) for c in rows.columns]).first()]
            weights, mean, cov = np.full(k, 1 / k), np.array(means, float), np.stack([np.diag(variance)] * k).astype(float)
            last = -np.inf
            for step in range(1, self.steps + 1):

                def sums(x: np.ndarray, weights=weights, mean=mean, cov=cov) -> np.ndarray:
                    logs = self._logs(x, weights, mean, cov)
                    top = logs.max(0)
                    total = top + np.log(np.exp(logs - top).sum(0))
                    r = np.exp(logs - total)
                    return np.concatenate([r.sum(1), (r @ x.T).ravel(), np.einsum("kn,in,jn->kij", r, x, x, optimize=True).ravel(), [total.sum()]])

                got = block_sums(rows, sums, k + k * p + k * p * p + 1)
                count = got[:k] + 10 * np.finfo(float).eps
                weights, mean = count / n, got[k : k + k * p].reshape(k, p) / count[:, None]
                second = got[k + k * p : -1].reshape(k, p, p) / count[:, None, None]
                cov = self._shaped(second - np.einsum("ki,kj->kij", mean, mean), weights)
                gain, last = got[-1] / n - last, got[-1] / n
                if gain < self.tol:
                    break
        finally:
            rows.unpersist()
        self.weights, self.means, self.covariances, self.mean_loglik, self.iterations = weights, mean, cov, last, step
        return self

    def predict(self, df: DataFrame, columns: Sequence[str], id_col: str) -> DataFrame:
        """(id, label, p): the likeliest part and its posterior."""
        rows = df.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).na.drop()

        def label(batches):
            for b in batches:
                logs = self._logs(b.drop(columns="id").to_numpy().T, self.weights, self.means, self.covariances)
                r = np.exp(logs - logs.max(0))
                yield pd.DataFrame({"id": b.id, "label": logs.argmax(0), "p": (r / r.sum(0)).max(0)})

        return rows.mapInPandas(label, f"id {rows.schema['id'].dataType.simpleString()}, label int, p double")
