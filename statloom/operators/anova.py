"""Analysis of variance and group comparisons: one aggregate by group, then algebra over groups."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import f_sf, studentized_range_quantile, studentized_range_sf, t_quantile, t_sf_two_sided


def group_moments(df: DataFrame, y: str, by: str) -> DataFrame:
    """(g, n, m, v): size, mean and sample variance of each group; null and NaN values are left out."""
    ok = df.where(F.col(y).isNotNull() & ~F.isnan(y) & F.col(by).isNotNull())
    return ok.groupBy(F.col(by).alias("g")).agg(F.count("*").alias("n"), F.avg(y).alias("m"), F.var_samp(y).alias("v"))


def moments_list(df: DataFrame, y: str, by: str) -> list[tuple[object, float, float, float]]:
    """(group, size, mean, variance) of each group, in order; a group is a row, however many rows it has."""
    rows = group_moments(df, y, by).orderBy("g").collect()
    return [(r.g, float(r.n), r.m, r.v or 0.0) for r in rows]


def _f_test(ss: float, d1: float, sse: float, d2: float) -> tuple[float, float]:
    """F and its p; 0/0 is nan, x/0 infinite."""
    if sse <= 0:
        return (float("nan"), float("nan")) if ss <= 0 else (float("inf"), 0.0)
    f = ss / d1 / (sse / d2)
    return f, f_sf(f, d1, d2)


def f_oneway(df: DataFrame, y: str, by: str) -> DataFrame:
    """(k, n, ss_between, ss_within, f, p, df_between, df_within, eta_squared, cohens_f), one row."""
    g = moments_list(df, y, by)
    k, n = len(g), sum(x[1] for x in g)
    mean = sum(x[1] * x[2] for x in g) / n
    ssb, ssw = sum(x[1] * (x[2] - mean) ** 2 for x in g), sum((x[1] - 1) * x[3] for x in g)
    f, p = _f_test(ssb, k - 1, ssw, n - k)
    eta = partial_eta_squared(ssb, ssw)
    names = "k long, n long, ss_between double, ss_within double, f double, p double, df_between long, df_within long, eta_squared double, cohens_f double"
    return df.sparkSession.createDataFrame([(k, int(n), ssb, ssw, f, p, k - 1, int(n) - k, eta, cohens_f(eta))], names)


def partial_eta_squared(effect: float, error: float) -> float:
    return effect / (effect + error) if effect + error > 0 else float("nan")


def cohens_f(eta_squared: float) -> float:
    return float("inf") if eta_squared >= 1 else math.sqrt(eta_squared / (1 - eta_squared)) if eta_squared == eta_squared else eta_squared


def f_welch(df: DataFrame, y: str, by: str) -> DataFrame:
    """(f, df1, df2, p) of Welch's test, one row. Groups without variance: an error, unless none has any."""
    g = moments_list(df, y, by)
    k = len(g)
    if any(x[3] == 0 for x in g):
        if not all(x[3] == 0 for x in g):
            raise ValueError("a group has no variance")
        same = len({x[2] for x in g}) == 1
        row = (float("nan"), float(k - 1), float("nan"), float("nan")) if same else (float("inf"), float(k - 1), float("nan"), 0.0)
    else:
        w = [x[1] / x[3] for x in g]
        total = sum(w)
        mean = sum(a * x[2] for a, x in zip(w, g, strict=True)) / total
        a = sum(b * (x[2] - mean) ** 2 for b, x in zip(w, g, strict=True))
        lam = sum((1 - b / total) ** 2 / (x[1] - 1) for b, x in zip(w, g, strict=True))
        f, df2 = a / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * lam), (k * k - 1) / (3 * lam)
        row = (f, float(k - 1), df2, f_sf(f, k - 1, df2))
    return df.sparkSession.createDataFrame([row], "f double, df1 double, df2 double, p double")


def tukey(df: DataFrame, y: str, by: str, alpha: float = 0.05) -> DataFrame:
    """(a, b, diff, q, t, p, low, high, reject) for each pair of groups a < b: Tukey and Kramer's test with the pooled variance."""
    g = moments_list(df, y, by)
    k, dfe = len(g), sum(x[1] - 1 for x in g)
    mse = sum((x[1] - 1) * x[3] for x in g) / dfe
    crit, out = studentized_range_quantile(1 - alpha, k, dfe), []
    for i, (a, na, ma, _) in enumerate(g):
        for b, nb, mb, _ in g[i + 1 :]:
            d, se = mb - ma, math.sqrt(mse / 2 * (1 / na + 1 / nb))
            q = abs(d) / se
            p = studentized_range_sf(q, k, dfe)
            out.append((str(a), str(b), d, q, d / se / math.sqrt(2), p, d - crit * se, d + crit * se, p < alpha))
    return df.sparkSession.createDataFrame(out, "a string, b string, diff double, q double, t double, p double, low double, high double, reject boolean")


def bonferroni(df: DataFrame, y: str, by: str, alpha: float = 0.05) -> DataFrame:
    """(a, b, diff, t, df, p, low, high, reject) for each pair of groups: Welch's t. p is raw, and is held against alpha / pairs;
    intervals are at that level too."""
    g = moments_list(df, y, by)
    level, out = alpha / max(1, len(g) * (len(g) - 1) // 2), []
    for i, (a, na, ma, va) in enumerate(g):
        for b, nb, mb, vb in g[i + 1 :]:
            d, se2 = mb - ma, va / na + vb / nb
            dof = se2**2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1))
            t = d / math.sqrt(se2)
            p, half = t_sf_two_sided(t, dof), t_quantile(1 - level / 2, dof) * math.sqrt(se2)
            out.append((str(a), str(b), d, t, dof, p, d - half, d + half, p < level))
    return df.sparkSession.createDataFrame(out, "a string, b string, diff double, t double, df double, p double, low double, high double, reject boolean")


def f_twoway_unequal(df: DataFrame, y: str, a: str, b: str) -> list[tuple[str, float, float, float]]:
    """(term, ss, df, f) of the two-way layout with interaction, for cells of any size, with sums of squares of type III.

    Each term is tested after all others, under contrasts that sum to 0; equal cells give what f_twoway gives. Rows with
    nulls are left out; every level of a must meet every level of b.
    """
    cells = df.where(F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b"))
    rows = cells.agg(F.count("*").alias("n"), F.avg(y).alias("m"), F.var_samp(y).alias("v")).collect()  # a row for each cell
    la, lb = sorted({r.a for r in rows}), sorted({r.b for r in rows})
    ka, kb, dfe = len(la), len(lb), sum(r.n - 1 for r in rows)
    if min(ka, kb) < 2 or len(rows) < ka * kb or not dfe:
        raise ValueError("two-way analysis needs two levels of each factor, no empty cell, and repeats")
    at = {(r.a, r.b): r for r in rows}
    n, m = (np.array([[float(at[i, j][k]) for j in lb] for i in la]) for k in ("n", "m"))
    mse = sum((r.n - 1) * r.v for r in rows if r.n > 1) / dfe

    def main(axis: int) -> float:
        mean, w = m.mean(axis), m.shape[axis] ** 2 / (1 / n).sum(axis)  # weighted squares of means
        return float((w * (mean - (w * mean).sum() / w.sum()) ** 2).sum())

    x = np.hstack([np.repeat(np.eye(ka), kb, 0), np.tile(np.eye(kb), (ka, 1))])  # levels of a cell
    root = np.sqrt(n.ravel())
    fit = x @ np.linalg.lstsq(x * root[:, None], m.ravel() * root, rcond=None)[0]
    terms = [("a", main(1), ka - 1), ("b", main(0), kb - 1), ("ab", float((n.ravel() * (m.ravel() - fit) ** 2).sum()), (ka - 1) * (kb - 1))]
    return [(t, ss, float(k), ss / k / mse) for t, ss, k in terms]


def f_twoway(df: DataFrame, y: str, a: str, b: str, interaction: bool = True) -> DataFrame:
    """(term, ss, df, f, p, eta_squared) of the two-way layout, for cells of one size; other cells are an error.

    Without interaction its sum of squares goes to the residuals. The last row holds the residuals.
    """
    cells = df.where(F.col(y).isNotNull() & ~F.isnan(y)).groupBy(F.col(a).alias("a"), F.col(b).alias("b"))
    rows = cells.agg(F.count("*").alias("n"), F.avg(y).alias("m"), F.var_samp(y).alias("v")).collect()  # a row for each cell
    la, lb = sorted({r.a for r in rows}), sorted({r.b for r in rows})
    ka, kb, n = len(la), len(lb), rows[0].n if rows else 0
    if len(rows) != ka * kb or any(r.n != n for r in rows):
        raise ValueError("cells differ in size; see f_twoway_unequal")
    at = {(r.a, r.b): r.m for r in rows}
    m = np.array([[at[i, j] for j in lb] for i in la])
    sse, dfe = sum((r.n - 1) * (r.v or 0.0) for r in rows), float(ka * kb * (n - 1))
    ra, rb = m.mean(1) - m.mean(), m.mean(0) - m.mean()
    ss = {"a": n * kb * (ra**2).sum(), "b": n * ka * (rb**2).sum(), "ab": n * ((m - m.mean() - ra[:, None] - rb[None, :]) ** 2).sum()}
    dof, total = {"a": ka - 1, "b": kb - 1, "ab": (ka - 1) * (kb - 1)}, sum(ss.values()) + sse
    if not interaction:
        sse, dfe = sse + ss.pop("ab"), dfe + dof["ab"]
    out = [(t, float(v), float(dof[t]), *map(float, _f_test(v, dof[t], sse, dfe)), float(v / total)) for t, v in ss.items()]
    return df.sparkSession.createDataFrame([*out, ("residual", float(sse), float(dfe), None, None, None)], "term string, ss double, df double, f double, p double, eta_squared double")
