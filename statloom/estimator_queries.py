"""Queries of panel, survival, clustering and decomposition estimators, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from .operators import clustering, cox, decomposition, kernels, multivariate, panel_models, robust_covariance, selection
from .operators.resampling import mixed_sql
from .registry import from_row, register
from .sources import panel as panel_view
from .sources import spells, table

# --- panels ------------------------------------------------------------------------------------------------------------


def _gaps(s: SparkSession, d: str) -> DataFrame:
    """(entity, period, y, x) of customers and years: a panel with gaps."""
    o = table(s, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("period")).agg((F.avg("o_totalprice") / 1000).alias("y"), F.count("*").cast("double").alias("x"))


GAPS = "gaps AS (SELECT o_custkey AS entity, year(o_orderdate) AS period, avg(o_totalprice)/1000 AS y, count(*)::DOUBLE AS x FROM orders GROUP BY 1, 2)"


def _panel_row(s: SparkSession, m: panel_models.PanelFit, *more: str) -> DataFrame:
    at = m.names.index("x")
    values = {"beta": m.beta[at], "se": float(np.sqrt(max(m.cov[at, at], 0.0))), "df": m.df_resid, "n": m.n, "intercept": m.beta[0], **m.extra}
    names = ["beta", "se", *more]
    return from_row(s, names, [tuple(float(values[n]) for n in names)], "d" * len(names))


WITHIN = {
    "fe_entity": ("panel", dict(entity="entity"), "y-avg(y) OVER e", "WINDOW e AS (PARTITION BY entity)", "(SELECT count(DISTINCT entity) FROM panel)-1"),
    "fe_time": ("panel", dict(time="period"), "y-avg(y) OVER e", "WINDOW e AS (PARTITION BY period)", "(SELECT count(DISTINCT period) FROM panel)-1"),
    "fe_two_way": ("panel", dict(entity="entity", time="period"), "y-avg(y) OVER e-avg(y) OVER p+avg(y) OVER ()", "WINDOW e AS (PARTITION BY entity), p AS (PARTITION BY period)", "(SELECT count(DISTINCT entity)+count(DISTINCT period) FROM panel)-2"),
}
for _n, (_v, _keys, _dm, _w, _lost) in WITHIN.items():
    register(_n, "beta:d se:d df:i n:i", lambda s, d, k=_keys: _panel_row(s, panel_models.fixed_effects(panel_view(s, d), "y", ["x"], **k), "df", "n"), f"""
WITH w AS (SELECT {_dm} AS y, {_dm.replace('y', 'x').replace('xvg', 'avg').replace('OVER x', 'OVER y')} AS x FROM panel {_w}), t AS (SELECT sum(x*x) AS xx, sum(x*y) AS xy, sum(y*y) AS yy, count(*) AS n FROM w)
SELECT xy/xx AS beta, sqrt((yy-xy*xy/xx)/(n-1-({_lost}))/xx) AS se, n-1-({_lost}) AS df, n FROM t""", 5)
#: Panel with gaps: SQL centres by both effects in turn until nothing moves; one Gram matrix with a column for each year here.
register("fe_two_way_gaps", "beta:d se:d df:i n:i", lambda s, d: _panel_row(s, panel_models.fixed_effects(_gaps(s, d), "y", ["x"], "entity", "period"), "df", "n"), f"""
WITH RECURSIVE {GAPS}, it(k, entity, period, y, x) AS (SELECT 0, entity, period, y, x FROM gaps UNION ALL
SELECT k+1, entity, period, y-avg(y) OVER (PARTITION BY period), x-avg(x) OVER (PARTITION BY period) FROM (SELECT k, entity, period, y-avg(y) OVER (PARTITION BY entity) AS y, x-avg(x) OVER (PARTITION BY entity) AS x FROM it WHERE k < 40)),
t AS (SELECT sum(x*x) AS xx, sum(x*y) AS xy, sum(y*y) AS yy, count(*) AS n, count(*)-1-(count(DISTINCT entity)-1)-(count(DISTINCT period)-1) AS df FROM it WHERE k = 40)
SELECT xy/xx AS beta, sqrt((yy-xy*xy/xx)/df/xx) AS se, df, n FROM t""", 5)
W1 = "w AS (SELECT entity, period, y-avg(y) OVER e AS y, x-avg(x) OVER e AS x FROM panel WINDOW e AS (PARTITION BY entity)), b AS (SELECT sum(x*y)/sum(x*x) AS b, sum(x*x) AS xx, count(*) AS n, count(*)-1-(count(DISTINCT entity)-1) AS df FROM w), u AS (SELECT entity, period, x*(y-b*x) AS u FROM w, b)"
register("fe_robust", "beta:d se:d", lambda s, d: _panel_row(s, panel_models.fixed_effects(panel_view(s, d), "y", ["x"], "entity", kind="robust")), f"WITH {W1} SELECT any_value(b) AS beta, sqrt(sum(u*u)*any_value(n)/any_value(df))/any_value(xx) AS se FROM u, b", 5)
register("fe_clustered", "beta:d se:d", lambda s, d: _panel_row(s, panel_models.fixed_effects(panel_view(s, d), "y", ["x"], "entity", kind="clustered", clusters=["entity"])), f"WITH {W1}, c AS (SELECT sum(u) AS u FROM u GROUP BY entity) SELECT any_value(b) AS beta, sqrt(sum(u*u))/any_value(xx) AS se FROM c, b", 5)
register("fe_clustered_both", "beta:d se:d", lambda s, d: _panel_row(s, panel_models.fixed_effects(panel_view(s, d), "y", ["x"], "entity", kind="clustered", clusters=["period", "entity"])), f"""
WITH {W1}, c AS (SELECT sum(u)*sum(u) AS v FROM u GROUP BY entity UNION ALL SELECT sum(u)*sum(u) FROM u GROUP BY period UNION ALL SELECT -sum(u)*sum(u) FROM u GROUP BY entity, period)
SELECT any_value(b) AS beta, sqrt(greatest(sum(v), 0))/any_value(xx) AS se FROM c, b""", 5)
OLS = "f AS (SELECT regr_slope(y,x) AS b, regr_intercept(y,x) AS a, avg(x) AS m, regr_sxx(y,x) AS sxx, regr_syy(y,x) AS syy, regr_sxy(y,x) AS sxy, count(*) AS n FROM {t})"
P = OLS.format(t="panel")
register("panel_pooled", "beta:d se:d intercept:d", lambda s, d: _panel_row(s, panel_models.pooled(panel_view(s, d), "y", ["x"]), "intercept"), f"WITH {P} SELECT b AS beta, sqrt((syy-sxy*sxy/sxx)/(n-2)/sxx) AS se, a AS intercept FROM f", 5)
register("panel_pooled_clustered", "beta:d se:d", lambda s, d: _panel_row(s, panel_models.pooled(panel_view(s, d), "y", ["x"], "clustered", ["entity"])), f"""
WITH {P}, u AS (SELECT sum((x-m)*(y-a-b*x)) AS u FROM panel, f GROUP BY entity) SELECT any_value(b) AS beta, sqrt(sum(u*u))/any_value(sxx) AS se FROM u, f""", 5)
register("panel_two_way_cluster", "beta:d se:d", lambda s, d: _panel_row(s, panel_models.pooled(panel_view(s, d), "y", ["x"], "clustered", ["entity", "period"])), f"""
WITH {P}, u AS (SELECT entity, period, (x-m)*(y-a-b*x) AS u FROM panel, f),
v AS (SELECT sum(u)*sum(u) AS v FROM u GROUP BY entity UNION ALL SELECT sum(u)*sum(u) FROM u GROUP BY period UNION ALL SELECT -sum(u)*sum(u) FROM u GROUP BY entity, period)
SELECT any_value(b) AS beta, sqrt(greatest(sum(v), 0))/any_value(sxx) AS se FROM v, f""", 5)
register("panel_pooled_hac", "beta:d se:d", lambda s, d: _panel_row(s, panel_models.pooled(panel_view(s, d), "y", ["x"], "hac", order="period", lags=2)), f"""
WITH {P}, u AS (SELECT period, sum((x-m)*(y-a-b*x)) AS u FROM panel, f GROUP BY period), l AS (SELECT u, coalesce(lag(u,1) OVER w,0) AS u1, coalesce(lag(u,2) OVER w,0) AS u2 FROM u WINDOW w AS (ORDER BY period))
SELECT any_value(b) AS beta, sqrt(sum(u*u)+2*sum(u*u1)*2/3+2*sum(u*u2)/3)/any_value(sxx) AS se FROM l, f""", 5)
register("panel_between", "beta:d se:d intercept:d", lambda s, d: _panel_row(s, panel_models.between(panel_view(s, d), "y", ["x"], "entity"), "intercept"), f"WITH g AS (SELECT avg(y) AS y, avg(x) AS x FROM panel GROUP BY entity), {OLS.format(t='g')} SELECT b AS beta, sqrt((syy-sxy*sxy/sxx)/(n-2)/sxx) AS se, a AS intercept FROM f", 5)
register("panel_first_difference", "beta:d se:d n:i", lambda s, d: _panel_row(s, panel_models.first_difference(panel_view(s, d), "y", ["x"], "entity", "period"), "n"), """
WITH w AS (SELECT y-lag(y) OVER e AS y, x-lag(x) OVER e AS x FROM panel WINDOW e AS (PARTITION BY entity ORDER BY period)), t AS (SELECT sum(x*x) AS xx, sum(x*y) AS xy, sum(y*y) AS yy, count(*) AS n FROM w WHERE x IS NOT NULL)
SELECT xy/xx AS beta, sqrt((yy-xy*xy/xx)/(n-1)/xx) AS se, n FROM t""", 5)
FM = "b AS (SELECT period, regr_slope(y,x) AS b FROM panel GROUP BY period), e AS (SELECT period, b, b-avg(b) OVER () AS e, count(*) OVER () AS t FROM b), l AS (SELECT b, t, e, lag(e) OVER (ORDER BY period) AS e1 FROM e)"
register("fama_macbeth", "beta:d se:d n:i", lambda s, d: _panel_row(s, panel_models.fama_macbeth(panel_view(s, d), "y", ["x"], "period", lags=1), "n"), f"WITH {FM} SELECT avg(b) AS beta, sqrt((sum(e*e)+sum(e*e1))/count(*)/count(*)) AS se, count(*) AS n FROM l", 5)
register("fama_macbeth_plain", "beta:d se:d n:i", lambda s, d: _panel_row(s, panel_models.fama_macbeth(panel_view(s, d), "y", ["x"], "period", "nonrobust"), "n"), f"WITH {FM} SELECT avg(b) AS beta, sqrt(sum(e*e)/(count(*)-1)/count(*)) AS se, count(*) AS n FROM l", 5)
register("panel_random_effects", "beta:d sigma2_e:d sigma2_a:d", lambda s, d: _panel_row(s, panel_models.random_effects(panel_view(s, d), "y", ["x"], "entity"), "sigma2_e", "sigma2_a"), """
WITH g AS (SELECT entity, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM panel GROUP BY entity), j AS (SELECT p.entity, n, x, y, mx, my FROM panel p JOIN g USING (entity)),
bb AS (SELECT sum(mx*my)/sum(mx*mx) AS b, count(*) AS g, count(*)/sum(1.0/n) AS h, sum(n) AS total FROM g), wb AS (SELECT sum((x-mx)*(y-my))/sum((x-mx)*(x-mx)) AS b FROM j),
e AS (SELECT sum(((y-my)-wb.b*(x-mx))*((y-my)-wb.b*(x-mx)))/(any_value(total)-any_value(bb.g)) AS se FROM j, wb, bb),
a AS (SELECT greatest(0.0, (sum((my-b*mx)*(my-b*mx))/(any_value(bb.g)-1)-any_value(se))/any_value(h)) AS sa FROM g, bb, e),
q AS (SELECT se, sa, x-(1-sqrt(se/(se+n*sa)))*mx AS x, y-(1-sqrt(se/(se+n*sa)))*my AS y FROM j, e, a)
SELECT sum(x*y)/sum(x*x) AS beta, any_value(se) AS sigma2_e, any_value(sa) AS sigma2_a FROM q""", 5)


def _effects(s: SparkSession, d: str) -> DataFrame:
    p = panel_view(s, d)
    m = panel_models.fixed_effects(p, "y", ["x"], "entity")
    return panel_models.predict(p, ["x"], m, panel_models.effects(p, "y", ["x"], m, "entity"), "entity")


register("fe_predict", "entity:i period:i predicted:d", _effects, f"""
WITH {W1}, r AS (SELECT entity, period, y-b*x AS u, b*x AS f FROM panel, b), e AS (SELECT entity, avg(u)-(SELECT avg(u) FROM r) AS e FROM r GROUP BY entity) SELECT entity, period, f+e AS predicted FROM r JOIN e USING (entity)""", 5)

# --- survival ----------------------------------------------------------------------------------------------------------


def _two(s: SparkSession, d: str) -> DataFrame:
    """Spells with a second covariate and a delayed entry."""
    return spells(s, d).withColumn("z", (F.col("id") % 7) / 7.0).withColumn("entry", F.floor(F.col("time") * (F.col("id") % 4) / 10.0).cast("double"))


TWO = "two AS (SELECT *, (id % 7)/7.0::DOUBLE AS z, floor(time*(id % 4)/10.0::DOUBLE) AS entry FROM spells)"


def _cox_sql(entry: bool, ties: str = "breslow", penalty: float = 0.0, steps: int = 10) -> str:
    """Newton's steps with two covariates."""
    m = ["s", "sx", "sz", "sxx", "sxz", "szz"]
    e = ["exp(b0*x+b1*z)", "exp(b0*x+b1*z)*x", "exp(b0*x+b1*z)*z", "exp(b0*x+b1*z)*x*x", "exp(b0*x+b1*z)*x*z", "exp(b0*x+b1*z)*z*z"]
    at = f"SELECT k, b0, b1, time, event, event*x AS dx, event*z AS dz, {', '.join(f'{v} AS {n}, event*{v} AS t{n}' for n, v in zip(m, e, strict=True))} FROM it, two WHERE k < {steps}"
    if entry:
        at += f" UNION ALL SELECT k, b0, b1, entry, 0, 0, 0, {', '.join(f'-{v}, 0' for v in e)} FROM it, two WHERE k < {steps}"
    risk = f"SELECT k, b0, b1, d, dx, dz, {', '.join(f'sum({n}) OVER w AS {n}, t{n}' for n in m)} FROM (SELECT k, any_value(b0) AS b0, any_value(b1) AS b1, time, sum(event)::DOUBLE AS d, sum(dx) AS dx, sum(dz) AS dz, {', '.join(f'sum({n}) AS {n}, sum(t{n}) AS t{n}' for n in m)} FROM ({at}) GROUP BY k, time) WINDOW w AS (PARTITION BY k ORDER BY time DESC ROWS UNBOUNDED PRECEDING)"
    if ties == "efron":
        each = f"SELECT k, b0, b1, 1.0::DOUBLE AS c, dx/d AS dx, dz/d AS dz, {', '.join(f'{n}-j/d*t{n} AS {n}' for n in m)} FROM (SELECT *, unnest(range(CAST(d AS BIGINT)))::DOUBLE AS j FROM ({risk}) WHERE d > 0)"
    else:
        each = f"SELECT k, b0, b1, d AS c, dx, dz, {', '.join(m)} FROM ({risk}) WHERE d > 0"
    return f"""WITH RECURSIVE spells_ AS (SELECT 1), {TWO}, it(k, b0, b1, h00, h01, h11) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
SELECT k+1, b0+(h11*g0-h01*g1)/(h00*h11-h01*h01), b1+(h00*g1-h01*g0)/(h00*h11-h01*h01), h00, h01, h11 FROM (
SELECT k, any_value(b0) AS b0, any_value(b1) AS b1, sum(dx-c*sx/s)-2*{penalty}*any_value(b0) AS g0, sum(dz-c*sz/s)-2*{penalty}*any_value(b1) AS g1, sum(c*(sxx/s-sx*sx/s/s))+2*{penalty} AS h00, sum(c*(sxz/s-sx*sz/s/s)) AS h01, sum(c*(szz/s-sz*sz/s/s))+2*{penalty} AS h11 FROM ({each}) GROUP BY k)),
f AS (SELECT * FROM it WHERE k = {steps}) SELECT 'x' AS term, b0 AS estimate, sqrt(h11/(h00*h11-h01*h01)) AS std_err FROM f UNION ALL SELECT 'z', b1, sqrt(h00/(h00*h11-h01*h01)) FROM f"""


def _cox(s: SparkSession, d: str, **how) -> DataFrame:
    df = _two(s, d)
    m = cox.fit(df, "time", "event", ["x", "z"], **how)
    return cox.inference(df, "time", "event", ["x", "z"], m)


register("cox_two", "term:s estimate:d std_err:d", lambda s, d: _cox(s, d), _cox_sql(False), 4)
register("cox_two_efron", "term:s estimate:d std_err:d", lambda s, d: _cox(s, d, ties="efron"), _cox_sql(False, "efron"), 4)
register("cox_delayed_entry", "term:s estimate:d std_err:d", lambda s, d: _cox(s, d, entry="entry"), _cox_sql(True), 4)
register("cox_ridge", "term:s estimate:d std_err:d", lambda s, d: _cox(s, d, penalty=50.0), _cox_sql(False, penalty=50.0), 4)
register("cox_concordance", "concordant:i tied:i permissible:i c:d", lambda s, d: cox.concordance(_two(s, d), "time", "event", F.round(F.col("x") - F.col("z"), 1)), f"""
WITH {TWO}, r AS (SELECT time, event, round(x-z, 1) AS r FROM two), p AS (SELECT a.r AS ra, b.r AS rb FROM r a JOIN r b ON a.event = 1 AND (a.time < b.time OR (a.time = b.time AND b.event = 0)))
SELECT *, (concordant+tied/2)/permissible AS c FROM (SELECT count(*) FILTER (ra > rb) AS concordant, count(*) FILTER (ra = rb) AS tied, count(*) AS permissible FROM p)""")


def _survival(s: SparkSession, d: str) -> DataFrame:
    df = _two(s, d)
    return cox.predict_survival(cox.baseline(df, "time", "event", ["x"], np.array([0.1])), table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 10000).alias("x")), F.col("x") * 0.1, [30.0, 300.0], "id")


register("cox_predict_survival", "id:i time:d survival:d", _survival, """
WITH a AS (SELECT time, sum(event) AS d, sum(exp(0.1*x)) AS w FROM spells GROUP BY 1), r AS (SELECT time, d, sum(w) OVER (ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS s FROM a), t AS (SELECT unnest([30.0, 300.0])::DOUBLE AS t),
h AS (SELECT t, sum(d/s) AS h FROM t, r WHERE time <= t GROUP BY t) SELECT s_suppkey AS id, t AS time, exp(-h*exp(0.1*s_acctbal/10000)) AS survival FROM supplier, h""")

# --- clusters ----------------------------------------------------------------------------------------------------------

POINTS = "pts AS (SELECT p_partkey AS id, p_size/5.0::DOUBLE AS a, p_retailprice/100.0::DOUBLE AS b FROM part)"


def _points(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 5.0).alias("a"), (F.col("p_retailprice") / 100.0).alias("b"))


#: SQL passes the smallest label along pairs of core rows until nothing changes; cells and stars here.
register("dbscan", "id:i label:i core:t", lambda s, d: clustering.dbscan(_points(s, d), ["a", "b"], "id", 0.35, 8), f"""
WITH RECURSIVE {POINTS}, e AS MATERIALIZED (SELECT x.id AS i, y.id AS j FROM pts x JOIN pts y ON (x.a-y.a)*(x.a-y.a)+(x.b-y.b)*(x.b-y.b) <= 0.35::DOUBLE*0.35::DOUBLE), c AS MATERIALIZED (SELECT i FROM e GROUP BY i HAVING count(*) >= 8),
g AS MATERIALIZED (SELECT i, j FROM e WHERE i IN (SELECT i FROM c) AND j IN (SELECT i FROM c)), it(k, id, l) AS (SELECT 0, i, i FROM c UNION ALL SELECT k+1, g.i, min(it.l) FROM it JOIN g ON it.id = g.j WHERE k < 60 GROUP BY k, g.i),
f AS (SELECT id, l FROM it WHERE k = 60), n AS (SELECT l, row_number() OVER (ORDER BY l)-1 AS label FROM (SELECT DISTINCT l FROM f)),
b AS (SELECT e.i AS id, arg_min(f.l, f.id) AS l FROM e JOIN f ON e.j = f.id WHERE e.i NOT IN (SELECT i FROM c) GROUP BY e.i)
SELECT id, label, true AS core FROM f JOIN n USING (l) UNION ALL SELECT id, label, false FROM b JOIN n USING (l) UNION ALL SELECT id, -1, false FROM pts WHERE id NOT IN (SELECT id FROM f) AND id NOT IN (SELECT id FROM b)""")
register("agglomerative_single", "id:i label:i", lambda s, d: clustering.agglomerative(table(s, d, "supplier"), ["s_acctbal"], "s_suppkey", 4), """
WITH g AS (SELECT s_suppkey AS id, s_acctbal AS x, s_acctbal-lag(s_acctbal) OVER (ORDER BY s_acctbal, s_suppkey) AS gap FROM supplier), c AS (SELECT id, x, CASE WHEN row_number() OVER (ORDER BY gap DESC NULLS LAST) <= 3 THEN 1 ELSE 0 END AS cut FROM g),
k AS (SELECT id, sum(cut) OVER (ORDER BY x, id ROWS UNBOUNDED PRECEDING) AS k FROM c), f AS (SELECT k, row_number() OVER (ORDER BY min(id))-1 AS label FROM k GROUP BY k) SELECT id, label FROM k JOIN f USING (k)""")
D2 = "(a-{a})*(a-{a})+(b-{b})*(b-{b})"
U = f"(({mixed_sql('id', '{r}')}+1)/(2147483647.0::DOUBLE*2147483647.0::DOUBLE))"
register("kmeans_seeds", "a0:d b0:d a1:d b1:d a2:d b2:d", lambda s, d: from_row(s, ["a0", "b0", "a1", "b1", "a2", "b2"], [tuple(v for c in clustering.seeds(_points(s, d), ["a", "b"], "id", 3) for v in c)], "d" * 6), f"""
WITH {POINTS}, c0 AS (SELECT a AS a0, b AS b0 FROM pts ORDER BY -ln({U.format(r='0')}), id LIMIT 1), w1 AS (SELECT id, a, b, {D2.format(a='a0', b='b0')} AS w, a0, b0 FROM pts, c0),
c1 AS (SELECT a AS a1, b AS b1 FROM w1 WHERE w > 0 ORDER BY -ln({U.format(r='1')})/w, id LIMIT 1), w2 AS (SELECT id, a, b, least(w, {D2.format(a='a1', b='b1')}) AS w FROM w1, c1),
c2 AS (SELECT a AS a2, b AS b2 FROM w2 WHERE w > 0 ORDER BY -ln({U.format(r='2')})/w, id LIMIT 1) SELECT * FROM c0, c1, c2""")
CENTRES = [[2.0, 9.2], [5.0, 9.5], [8.0, 9.8]]


def _minibatch(s: SparkSession, d: str) -> DataFrame:
    m = clustering.MiniBatchKMeans(CENTRES).fit(_points(s, d), ["a", "b"], "id", 4)
    return from_row(s, ["label", "a", "b"], [(float(i), *map(float, c)) for i, c in enumerate(m.centres)], "ddd")


def _minibatch_sql() -> str:
    """Four batches one after the other, each centre moved to the mean of the rows it was given so far; then two Lloyd steps."""
    def label(t: str) -> str:
        d = [f"(p.a-{t}.a{i})*(p.a-{t}.a{i})+(p.b-{t}.b{i})*(p.b-{t}.b{i})" for i in range(3)]
        return "CASE " + " ".join(f"WHEN {d[i]}=least({', '.join(d)}) THEN {i}" for i in range(3)) + " END"

    out = [f"WITH {POINTS}", f"q AS (SELECT id, a, b, {mixed_sql('id', '0')}%4 AS batch FROM pts)", "s0 AS (SELECT " + ", ".join(f"{a}::DOUBLE AS a{i}, {b}::DOUBLE AS b{i}, 0.0::DOUBLE AS n{i}" for i, (a, b) in enumerate(CENTRES)) + ")"]
    for t in range(4):
        out.append(f"l{t} AS (SELECT p.a, p.b, {label('s' + str(t))} AS l FROM q p, s{t} WHERE batch = {t})")
        new = ", ".join(f"s{t}.n{i}+coalesce((SELECT count(*) FROM l{t} WHERE l={i}),0) AS n{i}, CASE WHEN (SELECT count(*) FROM l{t} WHERE l={i})=0 THEN s{t}.a{i} ELSE (s{t}.n{i}*s{t}.a{i}+(SELECT sum(a) FROM l{t} WHERE l={i}))/(s{t}.n{i}+(SELECT count(*) FROM l{t} WHERE l={i})) END AS a{i}, CASE WHEN (SELECT count(*) FROM l{t} WHERE l={i})=0 THEN s{t}.b{i} ELSE (s{t}.n{i}*s{t}.b{i}+(SELECT sum(b) FROM l{t} WHERE l={i}))/(s{t}.n{i}+(SELECT count(*) FROM l{t} WHERE l={i})) END AS b{i}" for i in range(3))
        out.append(f"s{t + 1} AS (SELECT {new} FROM s{t})")
    for t in (4, 5):
        out.append(f"l{t} AS (SELECT p.a, p.b, {label('s' + str(t))} AS l FROM pts p, s{t})")
        out.append(f"s{t + 1} AS (SELECT " + ", ".join(f"coalesce((SELECT avg(a) FROM l{t} WHERE l={i}), a{i}) AS a{i}, coalesce((SELECT avg(b) FROM l{t} WHERE l={i}), b{i}) AS b{i}" for i in range(3)) + f" FROM s{t})")
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT {i} AS label, a{i} AS a, b{i} AS b FROM s6" for i in range(3))


register("minibatch_kmeans", "label:i a:d b:d", _minibatch, _minibatch_sql(), 6)
MIX_STEPS = 12


def _mixture_sql(kind: str) -> str:
    """EM steps of two normal parts in two dimensions with full covariances, or those shaped otherwise."""
    det = "(v{i}aa*v{i}bb-v{i}ab*v{i}ab)"
    logs = [f"ln(w{i})-ln(2*pi())-0.5*ln({det.format(i=i)})-0.5*(v{i}bb*(a-m{i}a)*(a-m{i}a)-2*v{i}ab*(a-m{i}a)*(b-m{i}b)+v{i}aa*(b-m{i}b)*(b-m{i}b))/{det.format(i=i)}" for i in range(2)]
    names = ", ".join(f"w{i}, m{i}a, m{i}b, v{i}aa, v{i}ab, v{i}bb" for i in range(2))
    start = ", ".join(f"0.5::DOUBLE, {m[0]}::DOUBLE, {m[1]}::DOUBLE, va, 0.0::DOUBLE, vb" for m in ([3.0, 9.1], [7.0, 9.1]))
    raw = ", ".join(f"sum(r{i})/count(*) AS w{i}, sum(r{i}*a)/sum(r{i}) AS m{i}a, sum(r{i}*b)/sum(r{i}) AS m{i}b, sum(r{i}*a*a)/sum(r{i})-pow(sum(r{i}*a)/sum(r{i}),2) AS v{i}aa, sum(r{i}*a*b)/sum(r{i})-sum(r{i}*a)/sum(r{i})*sum(r{i}*b)/sum(r{i}) AS v{i}ab, sum(r{i}*b*b)/sum(r{i})-pow(sum(r{i}*b)/sum(r{i}),2) AS v{i}bb" for i in range(2))
    shape = {"full": "v{i}{c}", "diag": "CASE WHEN '{c}'='ab' THEN 0.0 ELSE v{i}{c} END", "spherical": "CASE WHEN '{c}'='ab' THEN 0.0 ELSE (v{i}aa+v{i}bb)/2 END", "tied": "w0*v0{c}+w1*v1{c}"}[kind]
    cov = lambda i, c: f"({shape.format(i=i, c=c)})" + ("" if c == "ab" else "+1e-6")
    shaped = ", ".join(f"w{i}, m{i}a, m{i}b, {cov(i, 'aa')}, {cov(i, 'ab')}, {cov(i, 'bb')}" for i in range(2))
    out = " UNION ALL ".join(f"SELECT {i} AS label, w{i} AS weight, m{i}a AS a, m{i}b AS b, v{i}aa AS aa, v{i}ab AS ab, v{i}bb AS bb FROM it WHERE k = {MIX_STEPS}" for i in range(2))
    return f"""WITH RECURSIVE {POINTS}, v AS (SELECT var_pop(a) AS va, var_pop(b) AS vb FROM pts), it(k, {names}) AS (SELECT 0, {start} FROM v UNION ALL
SELECT k+1, {shaped} FROM (SELECT k, {raw} FROM (SELECT k, a, b, exp(p)/(exp(p)+exp(q)) AS r0, exp(q)/(exp(p)+exp(q)) AS r1 FROM (SELECT k, a, b, {logs[0]} AS p, {logs[1]} AS q FROM it, pts WHERE k < {MIX_STEPS})) GROUP BY k)) {out}"""


def _mixture(s: SparkSession, d: str, kind: str) -> DataFrame:
    m = clustering.GaussianMixture(2, kind, tol=-np.inf, steps=MIX_STEPS).fit(_points(s, d), ["a", "b"], [[3.0, 9.1], [7.0, 9.1]])
    return from_row(s, ["label", "weight", "a", "b", "aa", "ab", "bb"], [(float(i), *map(float, (m.weights[i], *m.means[i], m.covariances[i][0, 0], m.covariances[i][0, 1], m.covariances[i][1, 1]))) for i in range(2)], "d" * 7)


for _k in ("full", "tied", "diag", "spherical"):
    register(f"gaussian_mixture_{_k}", "label:i weight:d a:d b:d aa:d ab:r bb:d", lambda s, d, k=_k: _mixture(s, d, k), _mixture_sql(_k), 5)

# --- decompositions ----------------------------------------------------------------------------------------------------

ANGLE = "0.5*atan2(2*c12, c11-c22)"


def _flipped(x: str) -> str:
    """The first axis (cos, sin) with its larger entry positive, times x."""
    return f"(CASE WHEN abs(cos(t)) >= abs(sin(t)) THEN sign(cos(t)) ELSE sign(sin(t)) END)*({x})"


def _scores(s: SparkSession, d: str, batches: int) -> DataFrame:
    df, m = _points(s, d), decomposition.PCA(1)
    for i in range(batches):
        m.partial_fit(df.where(F.col("id") % batches == i), ["a", "b"])
    return df.select("id", m.transform(["a", "b"])[0].alias("score"))


PCA_SQL = f"WITH {POINTS}, c AS (SELECT covar_samp(a,a) AS c11, covar_samp(a,b) AS c12, covar_samp(b,b) AS c22, avg(a) AS ma, avg(b) AS mb FROM pts), t AS (SELECT *, {ANGLE} AS t FROM c) SELECT id, {_flipped('cos(t)*(a-ma)+sin(t)*(b-mb)')} AS score FROM pts, t"
register("pca_scores", "id:i score:r", lambda s, d: _scores(s, d, 1), PCA_SQL)
register("incremental_pca_scores", "id:i score:r", lambda s, d: _scores(s, d, 3), PCA_SQL)


def _svd(s: SparkSession, d: str) -> DataFrame:
    df = _points(s, d)
    return df.select("id", decomposition.TruncatedSVD(1).fit(df, ["a", "b"]).transform(["a", "b"])[0].alias("score"))


register("truncated_svd_scores", "id:i score:r", _svd, f"WITH {POINTS}, c AS (SELECT sum(a*a) AS c11, sum(a*b) AS c12, sum(b*b) AS c22 FROM pts), t AS (SELECT *, {ANGLE} AS t FROM c) SELECT id, {_flipped('cos(t)*a+sin(t)*b')} AS score FROM pts, t")
register("randomized_svd", "s1:d s2:d", lambda s, d: from_row(s, ["s1", "s2"], [tuple(map(float, decomposition.randomized_svd(_points(s, d), ["a", "b"], 2)[0]))], "dd"), f"""
WITH {POINTS}, c AS (SELECT sum(a*a) AS p, sum(a*b) AS q, sum(b*b) AS r FROM pts), e AS (SELECT (p+r)/2+sqrt((p-r)*(p-r)/4+q*q) AS l, p*r-q*q AS d FROM c) SELECT sqrt(l) AS s1, sqrt(d/l) AS s2 FROM e""", 5)

# --- kernels, densities, selection, likelihoods ------------------------------------------------------------------------

VECTORS = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
PAIRED = f"{VECTORS}, j AS (SELECT a.id AS a, b.id AS b, a.v AS x, b.v AS y FROM v a, v b WHERE b.id % 50 = 0)"


def _pairs(s: SparkSession, d: str, name: str) -> DataFrame:
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda e: F.abs(e.cast("double")) if name == "chi2" else e.cast("double")).alias("v"))
    return kernels.pairwise(v, v.where("id % 50 = 0"), "id", "v", name)


for _n, _sql in {
    "rbf": "exp(-list_sum(list_transform(list_zip(x, y), lambda z: (z[1]-z[2])*(z[1]-z[2])))/len(x))", "polynomial": "pow(list_dot_product(x, y)/len(x)+1, 3)", "sigmoid": "tanh(list_dot_product(x, y)/len(x)+1)",
    "laplacian": "exp(-list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1]-z[2])))/len(x))", "linear": "list_dot_product(x, y)", "cosine": "list_dot_product(x, y)/(sqrt(list_dot_product(x, x))*sqrt(list_dot_product(y, y))+1e-10)",
    "chi2": "exp(-list_sum(list_transform(list_zip(x, y), lambda z: CASE WHEN abs(z[1])+abs(z[2]) > 0 THEN pow(abs(z[1])-abs(z[2]), 2)/(abs(z[1])+abs(z[2])) ELSE 0 END)))",
}.items():
    register(f"pairwise_{_n}", "a:i b:i value:r", lambda s, d, n=_n: _pairs(s, d, n), f"WITH {PAIRED} SELECT a, b, {_sql} AS value FROM j")

GRID = [(2.0, 9.2), (5.0, 9.5), (9.0, 9.9)]


def _density(s: SparkSession, d: str, weight: str | None) -> DataFrame:
    df = _points(s, d).withColumn("w", (F.col("id") % 3 + 1).cast("double"))
    got = kernels.kde_multivariate(df, ["a", "b"], np.array(GRID), "scott", weight)
    return from_row(s, ["point", "density"], [(float(i), float(v)) for i, v in enumerate(got)], "dd")


for _n, _w in (("kde_two_columns", "1.0"), ("kde_weighted", "(id % 3 + 1)")):
    register(_n, "point:i density:d", lambda s, d, w=None if _w == "1.0" else "w": _density(s, d, w), f"""
WITH {POINTS}, u AS (SELECT a, b, {_w}/(SELECT sum({_w}::DOUBLE) FROM pts) AS w FROM pts), m AS (SELECT sum(w*a) AS ma, sum(w*b) AS mb, sum(w*w) AS q FROM u),
c AS (SELECT sum(w*(a-ma)*(a-ma))/(1-any_value(q))*any_value(pow(q, 1.0/3)) AS aa, sum(w*(a-ma)*(b-mb))/(1-any_value(q))*any_value(pow(q, 1.0/3)) AS ab, sum(w*(b-mb)*(b-mb))/(1-any_value(q))*any_value(pow(q, 1.0/3)) AS bb FROM u, m),
g AS (SELECT unnest({list(range(len(GRID)))}) AS point, unnest({[p[0] for p in GRID]})::DOUBLE AS pa, unnest({[p[1] for p in GRID]})::DOUBLE AS pb)
SELECT point, sum(w*exp(-0.5*(bb*(pa-a)*(pa-a)-2*ab*(pa-a)*(pb-b)+aa*(pb-b)*(pb-b))/(aa*bb-ab*ab)))/(2*pi()*sqrt(any_value(aa*bb-ab*ab))) AS density FROM u, c, g GROUP BY point""", 5)


def _steps(s: SparkSession, d: str, kind: str) -> DataFrame:
    df = table(s, d, "part").withColumn("y", F.col("p_retailprice") / 10 + F.col("p_size") * 0.3)
    got, best = selection.stepwise(df.withColumn("z", F.col("p_partkey") % 11), "y", ["p_size", "z"], kind)
    return from_row(s, ["size", "z", "best"], [(float("p_size" in got), float("z" in got), best)], "ddd")


for _k, _cost in (("aic", "2"), ("bic", "ln(n)")):
    register(f"stepwise_{_k}", "size:i z:i best:d", lambda s, d, k=_k: _steps(s, d, k), f"""
WITH p AS (SELECT p_retailprice/10 + p_size*0.3::DOUBLE AS y, p_size::DOUBLE AS a, (p_partkey % 11)::DOUBLE AS b FROM part),
t AS (SELECT count(*) AS n, regr_syy(y,a) AS yy, regr_sxx(y,a) AS aa, regr_sxy(y,a) AS ay, regr_sxx(y,b) AS bb, regr_sxy(y,b) AS byy, regr_sxy(b,a) AS ab FROM p),
r AS (SELECT 0 AS size, 0 AS z, yy AS rss, 1 AS k, n FROM t UNION ALL SELECT 1, 0, yy-ay*ay/aa, 2, n FROM t UNION ALL SELECT 0, 1, yy-byy*byy/bb, 2, n FROM t UNION ALL SELECT 1, 1, yy-(ay*ay*bb-2*ay*byy*ab+byy*byy*aa)/(aa*bb-ab*ab), 3, n FROM t)
SELECT size, z, n*(ln(2*pi()*rss/n)+1)+{_cost}*k AS best FROM r ORDER BY best LIMIT 1""", 6)


def _likelihood(s: SparkSession, d: str) -> DataFrame:
    df = _points(s, d)
    c, mean, _ = multivariate.covariance(df, ["a", "b"])
    return from_row(s, ["score"], [(robust_covariance.score(df.where("id % 2 = 0"), ["a", "b"], mean, c),)], "d")


register("cov_score", "score:d", _likelihood, f"""
WITH {POINTS}, m AS (SELECT avg(a) AS ma, avg(b) AS mb, covar_pop(a,a) AS aa, covar_pop(a,b) AS ab, covar_pop(b,b) AS bb FROM pts)
SELECT avg(-0.5*(2*ln(2*pi())+ln(aa*bb-ab*ab)+(bb*(a-ma)*(a-ma)-2*ab*(a-ma)*(b-mb)+aa*(b-mb)*(b-mb))/(aa*bb-ab*ab))) AS score FROM pts, m WHERE id % 2 = 0""", 6)
