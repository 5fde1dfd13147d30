"""Survival of (time, event, x): everything is summed by distinct time first; risk sets are running sums over times."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranks import ranged, running


def over_times(at: DataFrame, sums: dict[str, str], later: bool) -> DataFrame:
    """A table of distinct times with running sums of columns (new name: column), from the last time back or from the first on,
    made in ranges of time."""
    dealt, ranges = ranged(at, "time")
    for name, of in sums.items():
        dealt = running(dealt, ranges, F.col(of), [F.desc("time") if later else F.asc("time")], "sum", name, last_first=later)
    return dealt.drop("__range")


def risk_table(df: DataFrame, beta: float) -> DataFrame:
    """(time, d, dx, s0, s1, s2, n) of each distinct time: events, their sum of x, and risk-set sums of exp(beta x) x^k."""
    w = F.exp(F.col("x") * beta)
    at = df.groupBy("time").agg(F.sum("event").alias("d"), F.sum(F.col("event") * F.col("x")).alias("dx"), F.sum(w).alias("w0"), F.sum(w * F.col("x")).alias("w1"), F.sum(w * F.col("x") * F.col("x")).alias("w2"), F.count("*").alias("k"))
    out = over_times(at, {"s0": "w0", "s1": "w1", "s2": "w2", "n": "k"}, later=True)
    return out.select("time", "d", "dx", "s0", "s1", "s2", F.col("n").cast("long").alias("n"))


def cox_breslow(df: DataFrame, beta: float) -> DataFrame:
    """(loglik, gradient, information) at beta, one row."""
    r = risk_table(df, beta).where("d > 0")
    m = F.col("s1") / F.col("s0")
    return r.agg(F.sum(F.col("dx") * beta - F.col("d") * F.log("s0")).alias("loglik"), F.sum(F.col("dx") - F.col("d") * m).alias("gradient"), F.sum(F.col("d") * (F.col("s2") / F.col("s0") - m * m)).alias("information"))


def cox_fit(df: DataFrame, steps: int = 12) -> float:
    """The slope that maximizes Breslow's partial likelihood, by Newton's method: one aggregate a step."""
    beta = 0.0
    for _ in range(steps):
        r = cox_breslow(df, beta).first()
        if not r.information:
            break
        step = r.gradient / r.information
        beta += max(-2.0, min(2.0, step))
        if abs(step) < 1e-10:
            break
    return beta


def baseline(df: DataFrame, beta: float) -> DataFrame:
    """(time, hazard, survival): Breslow's cumulative baseline hazard at event times."""
    h = over_times(risk_table(df, beta).where("d > 0").withColumn("h", F.col("d") / F.col("s0")), {"hazard": "h"}, later=False)
    return h.select("time", "hazard", F.exp(-F.col("hazard")).alias("survival"))


def kaplan_meier(df: DataFrame) -> DataFrame:
    """(time, survival, n_at_risk) at event times."""
    all_ = F.col("d") >= F.col("n")
    r = risk_table(df, 0.0).where("d > 0").withColumn("l", F.when(all_, 0.0).otherwise(F.log(F.when(all_, 1.0).otherwise(1 - F.col("d") / F.col("n"))))).withColumn("g", all_.cast("double"))
    out = over_times(r, {"keep": "l", "gone": "g"}, later=False)
    return out.select("time", F.when(F.col("gone") > 0, 0.0).otherwise(F.exp("keep")).alias("survival"), F.col("n").alias("n_at_risk"))


def survival_at(df: DataFrame, times: DataFrame, beta: float) -> DataFrame:
    """(time, survival): the baseline survival at requested times, as of the last event before; one merge of both by time."""
    both = baseline(df, beta).select("time", "survival", F.lit(0).alias("asked")).union(times.select("time", F.lit(None).cast("double"), F.lit(1)))
    # survival only falls, so the last one is the least so far
    dealt, ranges = ranged(both, "time")
    out = running(dealt, ranges, F.coalesce("survival", F.lit(1.0)), [F.asc("time"), F.asc("asked")], "min", "s")
    return out.where("asked = 1").select("time", F.col("s").alias("survival"))


def log_rank(df: DataFrame, group: str) -> DataFrame:
    """(observed, expected, variance, chi2) of the two-sample log-rank test; group is 0 or 1."""
    at = df.groupBy("time").agg(F.sum("event").alias("d"), F.sum(F.col("event") * F.col(group)).alias("d1"), F.count("*").alias("k"), F.sum(group).alias("k1"))
    r = over_times(at, {"n": "k", "n1": "k1"}, later=True).select("d", "d1", "n", "n1").where("d > 0")
    p = F.col("n1") / F.col("n")
    v = F.when(F.col("n") > 1, F.col("d") * p * (1 - p) * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
    t = r.agg(F.sum("d1").cast("double").alias("observed"), F.sum(F.col("d") * p).alias("expected"), F.sum(v).alias("variance"))
    return t.withColumn("chi2", F.pow(F.col("observed") - F.col("expected"), F.lit(2.0)) / F.col("variance"))


def cox_efron(df: DataFrame, beta: float) -> DataFrame:
    """(loglik, gradient, information) with Efron's ties: the k-th of d tied events takes k/d of their weight out of the risk set."""
    w = F.exp(F.col("x") * beta) * F.col("event")
    tied = df.groupBy("time").agg(*[F.sum(w * F.pow(F.col("x"), F.lit(float(i)))).alias(f"e{i}") for i in range(3)])
    r = risk_table(df, beta).where("d > 0").join(tied, "time")
    each = r.withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("d") - 1).cast("int"))))  # as many rows as events
    s0, s1, s2 = (F.col(f"s{i}") - F.col("k") / F.col("d") * F.col(f"e{i}") for i in range(3))
    dx = F.col("dx") / F.col("d")
    return each.agg(F.sum(dx * beta - F.log(s0)).alias("loglik"), F.sum(dx - s1 / s0).alias("gradient"), F.sum(s2 / s0 - s1 * s1 / (s0 * s0)).alias("information"))


def score_residuals(df: DataFrame, beta: float) -> DataFrame:
    """(id, residual): Breslow's score residuals. Sums over earlier event times are made by distinct time and joined back."""
    m, x = F.col("s1") / F.col("s0"), F.col("x")
    at = risk_table(df, beta).withColumn("m", m).withColumn("h0", F.col("d") / F.col("s0")).withColumn("h1", F.col("h0") * F.col("m"))
    at = over_times(at, {"h": "h0", "hm": "h1"}, later=False).select("time", "m", "h", "hm")
    return df.join(at, "time").select("id", (F.col("event") * (x - F.col("m")) - F.exp(x * beta) * (x * F.col("h") - F.col("hm"))).alias("residual"))


def chi2_sf_1(x: float) -> float:
    return math.erfc(math.sqrt(max(x, 0.0) / 2))
