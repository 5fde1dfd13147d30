"""Multiple testing and classification metrics.

Ranks over a whole table come from ranges of the value (see plans.ranks). Metrics first sum rows by distinct score, so only
distinct scores are ordered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from ..plans.ranks import ranged, ranked, running


METHODS = {"fdr_bh": "bh", "benjamini_hochberg": "bh", "fdr_by": "by", "benjamini_yekutieli": "by", "bonf": "bonferroni"}


def harmonic(m: int) -> float:
    """1 + 1/2 + ... + 1/m."""
    if m < 1000:
        return math.fsum(1 / i for i in range(1, m + 1))
    return math.log(m) + 0.57721566490153286061 + 1 / (2 * m) - 1 / (12 * m * m) + 1 / (120 * m**4)


def adjust(df: DataFrame, p: str, method: str, id_col: str, by: tuple[str, ...] = (), alpha: float = 0.05) -> DataFrame:
    """df with p_adj by bonferroni, holm, hochberg, bh or by, and reject (p_adj <= alpha).

    Without `by` the list is the whole table, dealt into ranges of p (see ranks); with it each group is a list of its own,
    which a task sorts. Either way each value is visited once.
    """
    method = METHODS.get(method, method)
    if method not in ("bonferroni", "holm", "hochberg", "bh", "by"):
        raise ValueError(method)
    v, r = F.col(p), F.col("__r")
    if by:
        over = Window.partitionBy(*by)
        ranked_, m, ranges = df.withColumn("__m", F.count("*").over(over)).withColumn("__r", F.row_number().over(over.orderBy(p, id_col))), F.col("__m"), 1
        c = F.sum(1.0 / r).over(over)
        if method == "by":
            ranked_ = ranked_.withColumn("__c", c)
    else:
        ranked_, n, ranges = ranked(df, p, id_col, rank="__r")
        m, c = F.lit(n), F.lit(harmonic(n))
        ranked_ = ranked_.withColumn("__c", c)
    scaled = {"bonferroni": v * m, "holm": v * (m - r + 1), "hochberg": v * (m - r + 1), "bh": v * m / r, "by": v * m * F.col("__c") / r}[method]
    if method == "bonferroni":
        out = ranked_.withColumn("__a", scaled)
    else:
        up = method == "holm"
        order, how = ([F.col(p).asc(), F.col(id_col).asc()], "max") if up else ([F.col(p).desc(), F.col(id_col).desc()], "min")
        if by:
            f = F.max if up else F.min
            out = ranked_.withColumn("__a", f(scaled).over(over.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        else:
            out = running(ranked_, ranges, scaled, order, how, "__a", last_first=not up)
    adj = F.least(F.col("__a"), F.lit(1.0))
    return out.withColumn("p_adj", adj).withColumn("reject", F.col("p_adj") <= alpha).select(*df.columns, "p_adj", "reject")


def combine(df: DataFrame, p: str, by: str, weight: str | None = None) -> DataFrame:
    """(by, k, fisher, fisher_p, cauchy_p, z, stouffer_p) for each family of p-values.

    Fisher's statistic has a chi-square distribution with 2k degrees, whose tail is a finite sum; p is at least the smallest
    double there, and between machine precision and 1 less it in the other two. Weights are scaled to sum to 1.
    """
    eps = 2.220446049250313e-16
    low, mid = F.greatest(F.col(p), F.lit(2.2250738585072014e-308)), F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(F.col(by), F.log(low).alias("l"), F.tan((0.5 - mid) * math.pi).alias("t"), special.norm_ppf(1 - mid).alias("z"), w.alias("w"))
    g = rows.groupBy(by).agg(F.count("*").alias("k"), (-2 * F.sum("l")).alias("fisher"), (F.sum(F.col("w") * F.col("t")) / F.sum("w")).alias("t"), (F.sum(F.col("w") * F.col("z")) / F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("z"))
    half = F.col("fisher") / 2
    # exp(-h) * sum of h^j / j! for j < k, by logarithms, so that long lists don't overflow
    terms = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda j: j * F.log(half) - half - special.log_gamma(j + 1.0))
    tail = F.aggregate(terms, F.lit(0.0), lambda s, x: s + F.exp(x))
    return g.select(by, "k", "fisher", F.least(F.when(half <= 0, 1.0).otherwise(tail), F.lit(1.0)).alias("fisher_p"), (0.5 - F.atan("t") / math.pi).alias("cauchy_p"), "z", special.norm_cdf(-F.col("z")).alias("stouffer_p"))


def confusion(df: DataFrame, y: str, predicted: Column) -> DataFrame:
    """(tp, fp, tn, fn, accuracy, precision, recall, f1, mcc), one row."""
    one, hit = F.col(y) == 1, predicted == 1
    c = df.agg(*[F.count_if(x).cast("double").alias(n) for n, x in (("tp", one & hit), ("fp", ~one & hit), ("tn", ~one & ~hit), ("fn", one & ~hit))])
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select(
        "*", ((tp + tn) / (tp + fp + tn + fn)).alias("accuracy"), (tp / (tp + fp)).alias("precision"), (tp / (tp + fn)).alias("recall"),
        (2 * tp / (2 * tp + fp + fn)).alias("f1"), ((tp * tn - fp * fn) / F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"))


def curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, tp, fp, pos, neg) at each distinct score, from the highest down."""
    at = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(y)).alias("p"), F.sum(1 - F.col(y)).alias("n"))
    total = at.agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    dealt, ranges = ranged(at, "threshold")
    for name in ("p", "n"):
        dealt = running(dealt, ranges, F.col(name), [F.desc("threshold")], "sum", f"__{name}", last_first=True)
    return dealt.crossJoin(F.broadcast(total)).select("threshold", F.col("__p").cast("long").alias("tp"), F.col("__n").cast("long").alias("fp"), "pos", "neg")


def roc_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, tpr, fpr) at each distinct score, after the point (0, 0) at an infinite threshold."""
    c = curve(df, y, score).select("threshold", (F.col("tp") / F.col("pos")).alias("tpr"), (F.col("fp") / F.col("neg")).alias("fpr"))
    return c.union(df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, tpr double, fpr double"))


def precision_recall_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, precision, recall) at each distinct score, after the point (1, 0) at an infinite threshold."""
    c = curve(df, y, score).select("threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("pos")).alias("recall"))
    return c.union(df.sparkSession.createDataFrame([(float("inf"), 1.0, 0.0)], "threshold double, precision double, recall double"))


def auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """(auc, average_precision), one row: the trapezoid area under the curve, and precision averaged over recall steps.

    Each score's own counts are its step, so no row looks at another.
    """
    at = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(y)).alias("p"), F.sum(1 - F.col(y)).alias("n"))
    c = curve(df, y, score).join(at, "threshold")
    area = F.sum(F.col("n") * (2 * F.col("tp") - F.col("p")) / 2.0 / (F.col("pos") * F.col("neg")))
    ap = F.sum(F.col("p") / F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    return c.agg(area.alias("auc"), ap.alias("average_precision"))
