"""Cox's model with any number of covariates, delayed entry, ties by Breslow or Efron, strata of the ridge path, and concordance.

A step sums the rows by distinct time: events, their covariates, and weights with their first and second moments; a row also
leaves the risk set at its entry, as a negative share there. Risk sets are running sums over times from the last one back,
made in ranges of time (plans.ranks). What reaches the driver are the score and the information.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi2_sf
from ..plans import gram, linear
from ..plans.ranks import ranged, running
from .glm import result_rows

#: Rows of a range of times whose risks one task holds when pairs are counted.
PAIR_ROWS = 200_000


def _rows(df: DataFrame, time: str, event: str, x: Sequence[str], entry: str | None, cluster: str | None = None) -> DataFrame:
    cols = [F.col(time).cast("double").alias("time"), F.col(event).cast("int").alias("event"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x)]]
    cols.append((F.lit(float("-inf")) if entry is None else F.col(entry).cast("double")).alias("entry"))
    if cluster is not None:
        cols.append(F.col(cluster).alias("cluster"))
    return df.select(*cols).na.drop()


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _running(rows: DataFrame, beta: np.ndarray, entry: bool, order: int) -> DataFrame:
    """By distinct time: d, dx0.., tied sums (t), and risk-set sums s, s0.., s0_0.. up to the order of moments."""
    p = len(beta)
    x = [F.col(f"x{i}") for i in range(p)]
    w = F.exp(linear(x, beta))
    moments = [("s", w), *[(f"s{i}", w * x[i]) for i in range(p) if order > 0], *[(f"s{i}_{j}", w * x[i] * x[j]) for i, j in _pairs(p) if order > 1]]
    named = rows.select("time", "entry", "event", *x, *[m.alias(n) for n, m in moments])
    stop = named.select("time", "event", *x, *[F.col(n) for n, _ in moments], F.lit(1).alias("k"))
    if entry:
        start = named.select(F.col("entry").alias("time"), F.lit(0).alias("event"), *[F.lit(0.0).alias(f"x{i}") for i in range(p)], *[(-F.col(n)).alias(n) for n, _ in moments], F.lit(0).alias("k"))
        stop = stop.union(start)
    sums = [F.sum("event").cast("double").alias("d"), *[F.sum(F.col("event") * x[i]).alias(f"dx{i}") for i in range(p)], *[F.sum(F.col("event") * F.col(n)).alias(f"t{n}") for n, _ in moments], *[F.sum(n).alias(n) for n, _ in moments]]
    at = stop.groupBy("time").agg(*sums)
    dealt, ranges = ranged(at, "time")
    for n, _ in moments:
        dealt = running(dealt, ranges, F.col(n), [F.desc("time")], "sum", n, last_first=True)
    return dealt


@dataclass
class CoxFit:
    names: list[str]
    beta: np.ndarray
    information: np.ndarray
    loglik: float
    null_loglik: float
    null_score: float
    events: float
    ties: str
    iterations: int

    def covariance(self) -> np.ndarray:
        return np.linalg.pinv(self.information)

    def tests(self) -> dict[str, tuple[float, float]]:
        """Wald's, the likelihood ratio and the score test that all coefficients are 0: chi-square and p."""
        p = len(self.beta)
        wald = float(self.beta @ self.information @ self.beta)
        return {n: (v, chi2_sf(v, p)) for n, v in (("wald", wald), ("likelihood_ratio", 2 * (self.loglik - self.null_loglik)), ("score", self.null_score))}

    def risk(self, columns: Sequence[str]) -> Column:
        return linear([F.col(c).cast("double") for c in columns], self.beta)

    def hazard_ratio(self, columns: Sequence[str]) -> Column:
        return F.exp(self.risk(columns))


def _score(rows: DataFrame, beta: np.ndarray, entry: bool, ties: str, penalty: float) -> tuple[float, np.ndarray, np.ndarray, float]:
    """(log-likelihood less penalty, score, information, events) at beta."""
    p, pairs = len(beta), _pairs(len(beta))
    r = _running(rows, beta, entry, 2).where("d > 0")
    names = ["s", *[f"s{i}" for i in range(p)], *[f"s{i}_{j}" for i, j in pairs]]
    if ties == "efron":  # the k-th of d tied events takes k / d of the ties' weight out of the risk set
        r = r.withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("d") - 1).cast("int"))))
        r = r.select("d", *[(F.col(f"dx{i}") / F.col("d")).alias(f"dx{i}") for i in range(p)], F.lit(1.0).alias("e"), *[(F.col(n) - F.col("k") / F.col("d") * F.col(f"t{n}")).alias(n) for n in names])
    else:
        r = r.withColumn("e", F.col("d"))
    e, s = F.col("e"), F.greatest(F.col("s"), F.lit(1e-300))
    m = [F.col(f"s{i}") / s for i in range(p)]
    eta = linear([F.col(f"dx{i}") for i in range(p)], beta)
    got = r.agg(
        F.sum(eta - e * F.log(s)), F.sum(e), *[F.sum(F.col(f"dx{i}") - e * m[i]) for i in range(p)], *[F.sum(e * (F.col(f"s{i}_{j}") / s - m[i] * m[j])) for i, j in pairs]).first()
    value, events, g = got[0] or 0.0, got[1] or 0.0, np.array([v or 0.0 for v in got[2 : 2 + p]])
    h = np.zeros((p, p))
    for (i, j), v in zip(pairs, got[2 + p :], strict=True):
        h[i, j] = h[j, i] = v or 0.0
    return value - penalty * float(beta @ beta), g - 2 * penalty * beta, h + 2 * penalty * np.eye(p), events


def fit(df: DataFrame, time: str, event: str, x: Sequence[str], entry: str | None = None, ties: str = "breslow", penalty: float = 0.0, steps: int = 100, tol: float = 1e-9, start: Sequence[float] | None = None) -> CoxFit:
    """Newton's steps with halving on the partial log-likelihood less penalty * |beta|^2. Rows with nulls are left out."""
    rows, p = _rows(df, time, event, x, entry).persist(), len(x)
    beta = np.zeros(p) if start is None else np.asarray(start, float)
    try:
        value, g, h, events = _score(rows, beta, entry is not None, ties, penalty)
        null, null_score, i = value, float(g @ np.linalg.pinv(h) @ g), 0
        for i in range(1, steps + 1):
            if not events or np.abs(g).max() <= max(1e-3 * tol, 1e-9) * max(events, 1):
                break
            step, size = np.linalg.pinv(h) @ g, 1.0
            while True:
                trial = beta + size * step
                after = _score(rows, trial, entry is not None, ties, penalty)
                if after[0] >= value - 1e-10 * (1 + abs(value)) or size < 1e-6:
                    break
                size /= 2
            moved = np.abs(trial - beta).max()
            beta, (value, g, h, events) = trial, after
            if moved < tol:
                break
    finally:
        rows.unpersist()
    return CoxFit(list(x), beta, h, value, null, null_score, events, ties, i)


def score_residuals(df: DataFrame, time: str, event: str, x: Sequence[str], beta: np.ndarray, keep: Sequence[str] = (), entry: str | None = None) -> DataFrame:
    """df's `keep` columns with u0, u1, ...: each row's share in Breslow's score. Sums over times up to a row's own are made by
    distinct time and joined back, those up to its entry taken off."""
    p = len(x)
    cols = _rows(df, time, event, x, entry).columns
    rows = df.select(*[F.col(k) for k in keep], *[c for c in _exprs(time, event, x, entry)]).na.drop(subset=cols)
    r = _running(_rows(df, time, event, x, entry), beta, entry is not None, 1)
    m = [F.when(F.col("d") > 0, F.col(f"s{i}") / F.col("s")).otherwise(0.0) for i in range(p)]
    h = F.when(F.col("d") > 0, F.col("d") / F.col("s")).otherwise(0.0)
    at = r.select("time", "d", *[m[i].alias(f"m{i}") for i in range(p)], h.alias("h"), *[(h * m[i]).alias(f"hm{i}") for i in range(p)])
    dealt, ranges = ranged(at, "time")
    for n in ["h", *[f"hm{i}" for i in range(p)]]:
        dealt = running(dealt, ranges, F.col(n), [F.asc("time")], "sum", n)
    dealt = dealt.select("time", *[f"m{i}" for i in range(p)], "h", *[f"hm{i}" for i in range(p)])
    out = rows.join(dealt, "time")
    w = F.exp(linear([F.col(f"x{i}") for i in range(p)], beta))
    if entry is not None:
        before = dealt.select(F.col("time").alias("entry"), F.col("h").alias("bh"), *[F.col(f"hm{i}").alias(f"bhm{i}") for i in range(p)])
        out = out.join(before, "entry", "left").withColumn("h", F.col("h") - F.coalesce("bh", F.lit(0.0)))
        for i in range(p):
            out = out.withColumn(f"hm{i}", F.col(f"hm{i}") - F.coalesce(f"bhm{i}", F.lit(0.0)))
    return out.select(*keep, *[(F.col("event") * (F.col(f"x{i}") - F.col(f"m{i}")) - w * (F.col(f"x{i}") * F.col("h") - F.col(f"hm{i}"))).alias(f"u{i}") for i in range(p)])


def _exprs(time: str, event: str, x: Sequence[str], entry: str | None) -> list[Column]:
    return [F.col(time).cast("double").alias("time"), F.col(event).cast("int").alias("event"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x)], (F.lit(float("-inf")) if entry is None else F.col(entry).cast("double")).alias("entry")]


def inference(df: DataFrame, time: str, event: str, x: Sequence[str], m: CoxFit, kind: str = "nonrobust", cluster: str | None = None, alpha: float = 0.05) -> DataFrame:
    """(term, estimate, std_err, stat, p, low, high). hc0, hc1 and cluster: products of score residuals between the inverse
    information (for Efron's ties too, with Breslow's residuals)."""
    cov = m.covariance()
    if kind != "nonrobust":
        u = score_residuals(df, time, event, x, m.beta, [cluster] if kind == "cluster" else [])
        names = [f"u{i}" for i in range(len(x))]
        if kind == "cluster":
            u = u.groupBy(cluster).agg(*[F.sum(n).alias(n) for n in names])
        cov = cov @ gram(u, [F.col(n) for n in names]) @ cov
        if kind == "hc1":
            n = df.count()
            cov = cov * n / (n - len(x))
    return result_rows(df, x, m.beta, np.sqrt(np.diag(cov)), None, alpha)


def baseline(df: DataFrame, time: str, event: str, x: Sequence[str], beta: np.ndarray, entry: str | None = None) -> DataFrame:
    """(time, hazard): Breslow's cumulative hazard at covariates of 0, at event times."""
    r = _running(_rows(df, time, event, x, entry), beta, entry is not None, 0).where("d > 0").select("time", (F.col("d") / F.col("s")).alias("h"))
    dealt, ranges = ranged(r, "time")
    return running(dealt, ranges, F.col("h"), [F.asc("time")], "sum", "hazard").select("time", "hazard")


def predict_survival(hazard: DataFrame, rows: DataFrame, risk: Column, times: Sequence[float], id_col: str) -> DataFrame:
    """(id, time, survival) of rows at a list of times, 1 before the first event."""
    last = [F.max_by("hazard", F.when(F.col("time") <= t, F.col("time"))).alias(f"h{i}") for i, t in enumerate(times)]
    at = hazard.agg(*last).first()
    cells = [F.struct(F.lit(float(t)).alias("time"), F.exp(-float(at[i] if at[i] is not None else 0.0) * F.exp(risk)).alias("survival")) for i, t in enumerate(times)]
    return rows.select(F.col(id_col).alias("id"), F.explode(F.array(*cells)).alias("c")).select("id", "c.time", "c.survival")


def concordance(df: DataFrame, time: str, event: str, risk: Column) -> DataFrame:
    """(concordant, tied, permissible, c), one row. A pair counts if the row with the earlier time had an event, or, at equal
    times, if the other had none; it agrees if the earlier one's risk is higher, and by half if risks are equal.

    Rows are dealt into ranges of time. Each range's events are held against each later range's sorted risks, and within
    a range against its own rows in order of time, so no pair is written.
    """
    rows = df.select(F.col(time).cast("double").alias("time"), F.col(event).cast("int").alias("event"), risk.cast("double").alias("risk")).na.drop()
    dealt, ranges = ranged(rows, "time", rows=PAIR_ROWS)
    # a range is three arrays of numbers, of about PAIR_ROWS rows each
    packed = dealt.groupBy("__range").agg(F.collect_list(F.struct("time", F.col("event").cast("double").alias("event"), "risk")).alias("r"))
    packed = packed.select("__range", *[F.col(f"r.{n}").alias(n) for n in ("time", "event", "risk")])
    a = packed.select(F.col("__range").alias("a"), *[F.col(n).alias(f"{n}_a") for n in ("time", "event", "risk")])
    b = packed.select(F.col("__range").alias("b"), *[F.col(n).alias(f"{n}_b") for n in ("time", "event", "risk")])

    def count(batches):
        for batch in batches:
            out = []
            for _, m in batch.iterrows():
                x, y = (np.column_stack([m[f"{n}_{side}"] for n in ("time", "event", "risk")]) for side in "ab")
                out.append(_between(x, y) if m.a < m.b else _within(x))
            yield pd.DataFrame(out, columns=["concordant", "tied", "permissible"])

    met = a.join(F.broadcast(b) if ranges <= 8 else b, F.col("a") <= F.col("b")).mapInPandas(count, "concordant double, tied double, permissible double")
    t = met.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("concordant", "tied", "permissible")])
    return t.withColumn("c", F.when(F.col("permissible") > 0, (F.col("concordant") + F.col("tied") / 2) / F.col("permissible")))


def _between(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Pairs of an event in x and any row of y, whose times are all later."""
    e, risks = x[x[:, 1] == 1, 2], np.sort(y[:, 2])
    low, high = np.searchsorted(risks, e, "left"), np.searchsorted(risks, e, "right")
    return float(low.sum()), float((high - low).sum()), float(len(e) * len(risks))


def _within(x: np.ndarray) -> tuple[float, float, float]:
    """Pairs of rows of one range, by halves: an event in the earlier half against the later half's risks, then each half."""
    if len(x) < 2:
        return 0.0, 0.0, 0.0
    x = x[np.lexsort((-x[:, 1], x[:, 0]))]  # at equal times events come first
    if len(x) <= 512:
        t, e, r = x.T
        ok = (e[:, None] == 1) & ((t[:, None] < t[None]) | ((t[:, None] == t[None]) & (e[None] == 0)))
        return float((ok & (r[:, None] > r[None])).sum()), float((ok & (r[:, None] == r[None])).sum()), float(ok.sum())
    mid = len(x) // 2
    a, b = x[:mid], x[mid:]
    out = np.array(_between(a, b))
    # events of the first half tied in time with events of the second don't count
    t = b[0, 0]
    if (ta := a[(a[:, 0] == t) & (a[:, 1] == 1)]).size and (tb := b[(b[:, 0] == t) & (b[:, 1] == 1)]).size:
        out -= _between(ta, tb)
    return tuple(out + np.array(_within(a)) + np.array(_within(b)))


def cross_validated(df: DataFrame, time: str, event: str, x: Sequence[str], fold: Column, penalties: Sequence[float], ties: str = "breslow") -> DataFrame:
    """(penalty, score): mean over folds of the whole table's partial log-likelihood less the training rows', at fits without the
    fold, per event held out."""
    rows = df.withColumn("__f", fold).persist()
    out = []
    try:
        folds = [r[0] for r in rows.select("__f").distinct().orderBy("__f").collect()]  # a row for each fold
        for penalty in penalties:
            scores = []
            for f in folds:
                train = rows.where(F.col("__f") != f)
                m = fit(train, time, event, x, ties=ties, penalty=penalty)
                whole = _score(_rows(rows, time, event, x, None), m.beta, False, ties, 0.0)
                part = _score(_rows(train, time, event, x, None), m.beta, False, ties, 0.0)
                scores.append((whole[0] - part[0]) / max(whole[3] - part[3], 1.0))
            out.append((float(penalty), float(np.mean(scores))))
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame(out, "penalty double, score double")


def penalty_grid(df: DataFrame, event: str, x: Sequence[str], n: int = 10, least: float = 1e-3) -> list[float]:
    """Falling penalties from a tenth of the largest column variance times the events."""
    r = df.agg(F.sum(event), *[F.var_pop(c) for c in x]).first()
    top = max(v or 0.0 for v in r[1:]) * (r[0] or 0) * 0.1
    return [top * least ** (i / max(n - 1, 1)) for i in range(n)]


def summary(df: DataFrame, time: str, event: str, x: Sequence[str], m: CoxFit) -> str:
    lines = [f"{r.term:<16}{r.estimate:>12.6g}{math.exp(r.estimate):>12.6g}{r.std_err:>12.4g}{r.stat:>10.3f}{r.p:>10.4f}" for r in inference(df, time, event, x, m).collect()]
    tests = "  ".join(f"{k} {v:.4g} (p {p:.4g})" for k, (v, p) in m.tests().items())
    return "\n".join([f"{'term':<16}{'estimate':>12}{'exp':>12}{'std err':>12}{'z':>10}{'p':>10}", *lines, f"events {m.events:g}  log-likelihood {m.loglik:.6g}  {tests}"])
