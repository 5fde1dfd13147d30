"""Queries of the statistical operators, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import functions as fn
from .functions.distributions import get_distribution
from .functions.losses import get_loss
from . import estimator_queries, fit_sql, model_queries, streaming  # noqa: F401  some add their queries to the catalogue
from .operators import anova, linear, multivariate, panel, resampling, survival, testing
from .plans import gram
from .registry import ORACLES, QUERIES, f_sf_sql, from_row, register, t_two_sided_sql  # noqa: F401
from .sources import p_values, scores, spells, table

# --- analysis of variance ----------------------------------------------------------------------------------------------

G = "g AS (SELECT {by} AS g, count(*) AS n, avg({y}) AS m, var_samp({y}) AS v FROM {t} GROUP BY ALL)"
GL = G.format(by="l_returnflag", y="l_extendedprice", t="lineitem")
GC = G.format(by="c_mktsegment", y="c_acctbal", t="customer")
#: Three groups: the tail of F with 2 and d degrees is (1 + 2f/d)^(-d/2).
register("anova_oneway", "k:i n:i ss_between:d ss_within:d f:d p:r df_between:i df_within:i eta_squared:d cohens_f:d", lambda s, d: anova.f_oneway(table(s, d, "lineitem"), "l_extendedprice", "l_returnflag"), f"""
WITH {GL}, t AS (SELECT count(*) AS k, sum(n) AS n, sum(n*m)/sum(n) AS gm, sum((n-1)*v) AS ss_within FROM g),
b AS (SELECT t.*, (SELECT sum(g.n*(g.m-t.gm)*(g.m-t.gm)) FROM g) AS ss_between FROM t), f AS (SELECT *, (ss_between/(k-1))/(ss_within/(n-k)) AS f FROM b)
SELECT *, pow(1+2*f/(n-k), -(n-k)/2.0::DOUBLE) AS p, k-1 AS df_between, n-k AS df_within, ss_between/(ss_between+ss_within) AS eta_squared, sqrt(ss_between/ss_within) AS cohens_f FROM f""", 7)
register("anova_welch", "f:d df1:d df2:d p:r", lambda s, d: anova.f_welch(table(s, d, "lineitem"), "l_extendedprice", "l_returnflag"), f"""
WITH {GL}, w AS (SELECT *, n/v AS w FROM g), t AS (SELECT count(*) AS k, sum(w) AS sw, sum(w*m)/sum(w) AS gm FROM w),
a AS (SELECT any_value(k) AS k, sum(w*(m-gm)*(m-gm)) AS a, sum((1-w/sw)*(1-w/sw)/(n-1)) AS l FROM w, t),
f AS (SELECT (a/(k-1))/(1+2*(k-2)/(k*k-1)*l) AS f, k-1 AS df1, (k*k-1)/(3*l) AS df2 FROM a) SELECT *, pow(1+2*f/df2, -df2/2) AS p FROM f""", 7)
register("tukey_pairs", "a:s b:s diff:d q:d t:d", lambda s, d: anova.tukey(table(s, d, "customer"), "c_acctbal", "c_mktsegment"), f"""
WITH {GC}, e AS (SELECT sum((n-1)*v)/sum(n-1) AS mse FROM g)
SELECT a.g AS a, b.g AS b, b.m-a.m AS diff, abs(b.m-a.m)/sqrt(mse*(1.0/a.n+1.0/b.n)/2) AS q, (b.m-a.m)/sqrt(mse*(1.0/a.n+1.0/b.n)) AS t FROM g a, g b, e WHERE a.g < b.g""", 7)
register("bonferroni_pairs", "a:s b:s diff:d t:d df:d p:r reject:t", lambda s, d: anova.bonferroni(table(s, d, "customer"), "c_acctbal", "c_mktsegment"), f"""
WITH {GC}, j AS (SELECT a.g AS a, b.g AS b, b.m-a.m AS diff, a.v/a.n AS va, b.v/b.n AS vb, a.n AS na, b.n AS nb FROM g a, g b WHERE a.g < b.g),
t AS (SELECT a, b, diff, diff/sqrt(va+vb) AS t, pow(va+vb,2)/(va*va/(na-1)+vb*vb/(nb-1)) AS df FROM j), p AS (SELECT *, {t_two_sided_sql('t', 'df')} AS p FROM t)
SELECT a, b, diff, t, df, p, p < 0.05/(SELECT count(*) FROM t) AS reject FROM p""", 7)


def _cells(s: SparkSession, d: str) -> DataFrame:
    """Mean price by line number, month and remainder of the quantity: as many rows in each line number x month."""
    return table(s, d, "lineitem").groupBy(F.col("l_linenumber").alias("a"), F.month("l_shipdate").alias("b"), (F.col("l_quantity") % 3).cast("int").alias("r")).agg(F.avg("l_extendedprice").alias("y"))


TWOWAY = """WITH x AS (SELECT l_linenumber AS a, month(l_shipdate) AS b, CAST(l_quantity % 3 AS INTEGER) AS r, avg(l_extendedprice) AS y FROM lineitem GROUP BY 1, 2, 3),
c AS (SELECT a, b, count(*) AS n, avg(y) AS m, var_samp(y) AS v FROM x GROUP BY a, b),
j AS (SELECT *, avg(m) OVER (PARTITION BY a) AS ma, avg(m) OVER (PARTITION BY b) AS mb, avg(m) OVER () AS g FROM c),
t AS (SELECT count(DISTINCT a) AS ka, count(DISTINCT b) AS kb, sum((n-1)*v) AS sse, sum(n-1) AS dfe, sum(n*(ma-g)*(ma-g)) AS sa, sum(n*(mb-g)*(mb-g)) AS sb, sum(n*(m-ma-mb+g)*(m-ma-mb+g)) AS sab FROM j)"""
for _inter in (True, False):
    _e = "sse, dfe" if _inter else "sse+sab, dfe+(ka-1)*(kb-1)"
    register("anova_twoway" if _inter else "anova_twoway_additive", "term:s ss:d df:d f:d p:r eta_squared:d", lambda s, d, i=_inter: anova.f_twoway(_cells(s, d), "y", "a", "b", i), f"""
{TWOWAY}, e AS (SELECT *, sa+sb+sab+sse AS total FROM t), o AS (SELECT ka, kb, sa, sb, sab, total, {_e.replace(',', ' AS se,')} AS de FROM e),
u AS (SELECT 'a' AS term, sa AS ss, ka-1 AS df, se, de, total FROM o UNION ALL SELECT 'b', sb, kb-1, se, de, total FROM o {"UNION ALL SELECT 'ab', sab, (ka-1)*(kb-1), se, de, total FROM o" if _inter else ""}),
f AS (SELECT term, ss, df, ss/df/(se/de) AS f, de, total FROM u)
SELECT term, ss, df, f, {f_sf_sql('f', 'df', 'de')} AS p, ss/total AS eta_squared FROM f UNION ALL SELECT 'residual', se, de, NULL, NULL, NULL FROM o""", 6)

#: All orders, whatever their cells' sizes. Main effects are weighted squares of means; the interaction is what an additive fit leaves.
register("anova_twoway_unequal", "term:s ss:d df:d f:d", lambda s, d: from_row(s, ["term", "ss", "df", "f"], anova.f_twoway_unequal(table(s, d, "orders"), "o_totalprice", "o_orderstatus", "o_orderpriority"), "sddd"), f"""
WITH RECURSIVE {fit_sql.additive_cells('SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1, 2')},
e AS (SELECT sum((n-1)*coalesce(v,0)) FILTER (n>1)/sum(n-1) AS mse, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb FROM cells_),
ma AS (SELECT avg(m) AS m, count(*)*count(*)/sum(1.0::DOUBLE/n) AS w FROM cells_ GROUP BY a), mb AS (SELECT avg(m) AS m, count(*)*count(*)/sum(1.0::DOUBLE/n) AS w FROM cells_ GROUP BY b),
s AS (SELECT 'a' AS term, sum(w*m*m)-pow(sum(w*m),2)/sum(w) AS ss, (SELECT ka-1 FROM e) AS df FROM ma UNION ALL SELECT 'b', sum(w*m*m)-pow(sum(w*m),2)/sum(w), (SELECT kb-1 FROM e) FROM mb UNION ALL SELECT 'ab', sum(n*(m-f)*(m-f)), (SELECT (ka-1)*(kb-1) FROM e) FROM fit_)
SELECT term, ss, df, ss/df/mse AS f FROM s, e""", digits=6)

# --- least squares -----------------------------------------------------------------------------------------------------

R1 = "SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) AS sxy, avg(l_quantity) AS mx, count(*) AS n FROM lineitem"
LI = lambda s, d: table(s, d, "lineitem")
X1 = ["l_quantity"]
X2 = ["l_quantity", "l_discount"]


def _ols(s: SparkSession, d: str, x: list[str], weight: str | None = None, alpha: float = 0.0) -> DataFrame:
    df = LI(s, d).withColumn("w", F.col("l_tax") + 0.01)
    return linear.coefficients(df, linear.ols(df, "l_extendedprice", x, weight, alpha))


register("ols_simple", "term:s estimate:d std_err:d", lambda s, d: _ols(s, d, X1), f"""
WITH r AS ({R1}), e AS (SELECT *, (syy-sxy*sxy/sxx)/(n-2) AS s2 FROM r)
SELECT 'intercept' AS term, a AS estimate, sqrt(s2*(1.0/n+mx*mx/sxx)) AS std_err FROM e UNION ALL SELECT 'l_quantity', b, sqrt(s2/sxx) FROM e""", 6)
TWO = """m AS (SELECT count(*) AS n, covar_pop(l_quantity,l_quantity) AS s11, covar_pop(l_discount,l_discount) AS s22, covar_pop(l_quantity,l_discount) AS s12,
covar_pop(l_quantity,l_extendedprice) AS s1y, covar_pop(l_discount,l_extendedprice) AS s2y, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my FROM lineitem)"""
register("ols_two", "term:s estimate:d", lambda s, d: _ols(s, d, X2), f"""
WITH {TWO}, b AS (SELECT *, (s1y*s22-s2y*s12)/(s11*s22-s12*s12) AS b1, (s2y*s11-s1y*s12)/(s11*s22-s12*s12) AS b2 FROM m)
SELECT 'intercept' AS term, my-b1*m1-b2*m2 AS estimate FROM b UNION ALL SELECT 'l_quantity', b1 FROM b UNION ALL SELECT 'l_discount', b2 FROM b""", 6)
register("ridge_two", "term:s estimate:d", lambda s, d: _ols(s, d, X2, alpha=0.5), f"""
WITH {TWO}, r AS (SELECT *, n*s11+0.5*n AS a11, n*s22+0.5*n AS a22, n*s12 AS a12, n*s1y AS a1, n*s2y AS a2 FROM m),
b AS (SELECT *, (a1*a22-a2*a12)/(a11*a22-a12*a12) AS b1, (a2*a11-a1*a12)/(a11*a22-a12*a12) AS b2 FROM r)
SELECT 'intercept' AS term, my-b1*m1-b2*m2 AS estimate FROM b UNION ALL SELECT 'l_quantity', b1 FROM b UNION ALL SELECT 'l_discount', b2 FROM b""", 5)
register("wls_simple", "term:s estimate:d", lambda s, d: _ols(s, d, X1, "w"), """
WITH w AS (SELECT l_tax+0.01 AS w, l_quantity AS x, l_extendedprice AS y FROM lineitem), m AS (SELECT sum(w*x)/sum(w) AS mx, sum(w*y)/sum(w) AS my FROM w),
b AS (SELECT any_value(mx) AS mx, any_value(my) AS my, sum(w*(x-mx)*(y-my))/sum(w*(x-mx)*(x-mx)) AS b FROM w, m)
SELECT 'intercept' AS term, my-b*mx AS estimate FROM b UNION ALL SELECT 'l_quantity', b FROM b""", 6)
STATS = ["r2", "adj_r2", "f", "f_p", "llf", "aic", "bic", "sigma2"]


def _fit_stats(s: SparkSession, d: str) -> DataFrame:
    st = linear.ols(LI(s, d), "l_extendedprice", X1).stats()
    return from_row(s, STATS, [tuple(float(st[k]) for k in STATS)], "d" * 8)


register("ols_fit_stats", " ".join(f"{k}:{'r' if k == 'f_p' else 'd'}" for k in STATS), _fit_stats, f"""
WITH r AS ({R1}), e AS (SELECT *, syy-sxy*sxy/sxx AS rss FROM r), l AS (SELECT *, 1-rss/syy AS r2, -n/2.0*(ln(2*pi()*rss/n)+1) AS llf FROM e)
SELECT r2, 1-(1-r2)*(n-1)/(n-2) AS adj_r2, r2/((1-r2)/(n-2)) AS f, {t_two_sided_sql("sqrt(r2/((1-r2)/(n-2)))", "(n-2)")} AS f_p, llf, -2*llf+4 AS aic, -2*llf+2*ln(n) AS bic, rss/(n-2) AS sigma2 FROM l""", 4)
for _kind, _factor in (("hc0", "1"), ("hc1", "n/(n-2.0)"), ("hc2", "1/(1-h)"), ("hc3", "1/((1-h)*(1-h))")):
    register(f"ols_{_kind}", "se:d", lambda s, d, kind=_kind: from_row(s, ["se"], [(float(linear.robust(LI(s, d), "l_extendedprice", X1, kind)[1]),)], "d"), f"""
WITH r AS ({R1}), e AS (SELECT (l_quantity-mx) AS u, l_extendedprice-a-b*l_quantity AS e, 1.0/n+(l_quantity-mx)*(l_quantity-mx)/sxx AS h, n, sxx FROM lineitem, r)
SELECT sqrt(sum(u*u*e*e*{_factor}))/any_value(sxx) AS se FROM e""", 6)


def _shifted(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", (F.col("p_partkey") / 1000).alias("x"), (F.col("p_retailprice") + F.col("p_partkey") * 7919 % 100).alias("y"))


def _influence(s: SparkSession, d: str) -> DataFrame:
    df = _shifted(s, d)
    return linear.leverage(df, "y", ["x"], linear.ols(df, "y", ["x"]))


register("ols_influence", "p_partkey:i h:r standard:r student:r external:r cooks:r", _influence, """
WITH p AS (SELECT p_partkey, p_partkey/1000 AS x, p_retailprice + p_partkey * 7919 % 100 AS y FROM part), r AS (SELECT regr_slope(y,x) AS b, regr_intercept(y,x) AS a, avg(x) AS mx, regr_sxx(y,x) AS sxx, count(*) AS n, regr_syy(y,x)-regr_sxy(y,x)*regr_sxy(y,x)/regr_sxx(y,x) AS rss FROM p),
e AS (SELECT p_partkey, 1.0/n+(x-mx)*(x-mx)/sxx AS h, y-a-b*x AS e, rss/(n-2) AS s2 FROM p, r), t AS (SELECT p_partkey, h, e/sqrt(s2) AS standard, e/sqrt(s2*(1-h)) AS student, n FROM e, (SELECT count(*) AS n FROM p))
SELECT p_partkey, h, standard, student, student*sqrt((n-3)/(n-2-student*student)) AS external, student*student*h/(1-h)/2 AS cooks FROM t""", 5)
register("ols_hac", "se:d", lambda s, d: from_row(s, ["se"], [(float(linear.robust(_shifted(s, d), "y", ["x"], "hac", "p_partkey")[1]),)], "d"), """
WITH p AS (SELECT p_partkey, p_partkey/1000 AS x, p_retailprice + p_partkey * 7919 % 100 AS y FROM part), r AS (SELECT regr_slope(y,x) AS b, regr_intercept(y,x) AS a, avg(x) AS mx, regr_sxx(y,x) AS sxx, floor(4*pow(count(*)/100.0, 2.0/9)) AS lags FROM p),
u AS (SELECT row_number() OVER (ORDER BY p_partkey) AS i, (x-mx)*(y-a-b*x) AS u, lags, sxx FROM p, r), g AS (SELECT a.u*a.u AS v, a.sxx FROM u a UNION ALL SELECT 2*(1-h/(a.lags+1))*a.u*b.u, a.sxx FROM u a, range(1, 30) q(h), u b WHERE h <= a.lags AND b.i = a.i-h)
SELECT sqrt(sum(v))/any_value(sxx) AS se FROM g""", 5)
register("vif", "term:s vif:d", lambda s, d: linear.vif(table(s, d, "part").withColumn("z", F.col("p_size") + F.col("p_partkey") % 9), ["p_size", "z"]), """
WITH p AS (SELECT p_size AS a, p_size + p_partkey % 9 AS b FROM part), v AS (SELECT 1/(1-pow(corr(a,b),2)) AS v FROM p) SELECT 'p_size' AS term, v AS vif FROM v UNION ALL SELECT 'z', v FROM v""", 6)
register("ols_categorical", "level:s contrast:d", lambda s, d: LI(s, d).groupBy(F.col("l_returnflag").alias("level")).agg(F.avg("l_extendedprice").alias("m")).withColumn("contrast", F.col("m") - F.min_by("m", "level").over(Window.partitionBy())), """
SELECT l_returnflag AS level, avg(l_extendedprice) - (SELECT avg(l_extendedprice) FROM lineitem WHERE l_returnflag = (SELECT min(l_returnflag) FROM lineitem)) AS contrast FROM lineitem GROUP BY 1""", 5)


# --- scalar functions --------------------------------------------------------------------------------------------------

LOSS_ROWS = "SELECT l_quantity/10 AS y, 0.4 + l_discount - l_tax AS e FROM lineitem"


def _loss(s: SparkSession, d: str, name: str) -> DataFrame:
    rows = LI(s, d).select((F.col("l_quantity") / 10).alias("y"), (0.4 + F.col("l_discount") - F.col("l_tax")).alias("e"))
    how = {"quantile": {"quantile": 0.3}, "huber": {"delta": 1.345}, "bisquare": {"delta": 4.685}, "fair": {"delta": 1.3998}, "tweedie": {"power": 1.5}, "negative_binomial": {"alpha": 1.0}}
    return rows.agg(F.avg(get_loss("squared_error" if name == "squared" else name, **how.get(name, {})).value(F.col("y"), F.col("e"))).alias("loss"))


for _n, _q in fn.SQL["loss"].items():
    register(f"loss_{_n}", "loss:d", lambda s, d, n=_n: _loss(s, d, n), f"SELECT avg({_q}) AS loss FROM ({LOSS_ROWS})")


def _grid(s: SparkSession, name: str, low: float, step: float, n: int) -> DataFrame:
    return s.range(n).select(F.col("id").alias("i"), (F.lit(low) + F.col("id") * step).alias(name))


def _grid_sql(name: str, low: float, step: float, n: int) -> str:
    return f"(SELECT i, CAST({low} AS DOUBLE) + i * CAST({step} AS DOUBLE) AS {name} FROM range({n}) t(i))"


for _family, _table, _var, _low, _step, _count in (("link", fn.LINKS, "m", 0.05, 0.05, 19), ("variance", fn.VARIANCES, "m", 0.05, 0.05, 19), ("prox", fn.PROX, "z", -6.03, 0.31, 40), ("kernel", fn.KERNELS, "u", -1.53, 0.11, 29)):
    for _n, _f in _table.items():
        if _n == "probit":  # see below
            continue
        register(f"{_family}_{_n}", "i:i value:d", lambda s, d, f=_f, v=_var, a=_low, b=_step, c=_count: _grid(s, v, a, b, c).select("i", f(F.col(v)).alias("value")), f"SELECT i, {fn.SQL[_family][_n]} AS value FROM {_grid_sql(_var, _low, _step, _count)}")

#: Distribution function, density and the quantile of the function's own value, with place 0.4 and scale 1.7. Of each: shape
#: parameters, function and density at z, and where the density is positive.
SHAPES = {
    "uniform": ((), "least(greatest(z,0.0),1.0)", "CASE WHEN z BETWEEN 0 AND 1 THEN 1.0 ELSE 0 END", "z > 0 AND z < 1"), "expon": ((), "CASE WHEN z>0 THEN 1-exp(-z) ELSE 0 END", "CASE WHEN z>=0 THEN exp(-z) ELSE 0 END", "z > 0"),
    "cauchy": ((), "0.5+atan(z)/pi()", "1/(pi()*(1+z*z))", "true"), "laplace": ((), "CASE WHEN z<0 THEN 0.5*exp(z) ELSE 1-0.5*exp(-z) END", "0.5*exp(-abs(z))", "true"), "logistic": ((), "1/(1+exp(-z))", "exp(-z)/pow(1+exp(-z),2)", "true"),
    "weibull_min": ((1.5,), "CASE WHEN z>0 THEN 1-exp(-pow(greatest(z,0),1.5)) ELSE 0 END", "CASE WHEN z>0 THEN 1.5*pow(greatest(z,0),0.5)*exp(-pow(greatest(z,0),1.5)) ELSE 0 END", "z > 0"),
    "t": ((2.0,), "0.5+z/(2*sqrt(2+z*z))", "pow(2+z*z,-1.5)", "true"), "chi2": ((4.0,), "CASE WHEN z>0 THEN 1-exp(-z/2)*(1+z/2) ELSE 0 END", "CASE WHEN z>0 THEN z/4*exp(-z/2) ELSE 0 END", "z > 0"),
}


def _shape(s: SparkSession, d: str, name: str) -> DataFrame:
    dist, x = get_distribution(name, *SHAPES[name][0]), F.col("x")
    g = _grid(s, "x", -3.03, 0.17, 40)
    z = (x - 0.4) / 1.7
    inside = F.expr("true") if SHAPES[name][3] == "true" else (z > 0) & (z < 1) if "AND" in SHAPES[name][3] else z > 0
    return g.select("i", dist.cdf(x, 0.4, 1.7).alias("cdf"), dist.sf(x, 0.4, 1.7).alias("sf"), F.when(inside, dist.pdf(x, 0.4, 1.7)).otherwise(0.0).alias("pdf"), F.when(inside, dist.ppf(dist.cdf(x, 0.4, 1.7), 0.4, 1.7)).alias("back"))


for _n, (_a, _cdf, _pdf, _in) in SHAPES.items():
    register(f"distribution_{_n}", "i:i cdf:r sf:r pdf:r back:r", lambda s, d, n=_n: _shape(s, d, n), f"SELECT i, {_cdf} AS cdf, 1-({_cdf}) AS sf, CASE WHEN {_in} THEN ({_pdf})/1.7::DOUBLE ELSE 0.0 END AS pdf, CASE WHEN {_in} THEN x END AS back FROM (SELECT i, x, (x-0.4::DOUBLE)/1.7::DOUBLE AS z FROM {_grid_sql('x', -3.03, 0.17, 40)})")
register("distribution_poisson", "i:i cdf:r pdf:r back:i", lambda s, d: s.range(15).select(F.col("id").alias("i"), *(lambda q: [q.cdf(F.col("id")).alias("cdf"), q.pdf(F.col("id")).alias("pdf"), q.ppf(q.cdf(F.col("id")) - 1e-9).alias("back")])(get_distribution("poisson", 4.5))), """
SELECT a.i, sum(exp(-4.5+b.i*ln(4.5)-lgamma(b.i+1.0))) AS cdf, any_value(exp(-4.5+a.i*ln(4.5)-lgamma(a.i+1.0))) AS pdf, a.i AS back FROM range(15) a(i), range(15) b(i) WHERE b.i <= a.i GROUP BY a.i""")
register("distribution_binom", "i:i cdf:r pdf:r back:i", lambda s, d: s.range(13).select(F.col("id").alias("i"), *(lambda q: [q.cdf(F.col("id")).alias("cdf"), q.pdf(F.col("id")).alias("pdf"), q.ppf(q.cdf(F.col("id")) - 1e-9).alias("back")])(get_distribution("binom", 12, 0.3))), """
SELECT a.i, sum(exp(lgamma(13.0)-lgamma(b.i+1.0)-lgamma(13.0-b.i)+b.i*ln(0.3)+(12-b.i)*ln(0.7))) AS cdf, any_value(exp(lgamma(13.0)-lgamma(a.i+1.0)-lgamma(13.0-a.i)+a.i*ln(0.3)+(12-a.i)*ln(0.7))) AS pdf, a.i AS back FROM range(13) a(i), range(13) b(i) WHERE b.i <= a.i GROUP BY a.i""")

# --- metrics and multiple testing --------------------------------------------------------------------------------------

CM = "SELECT count(*) FILTER (y=1 AND score>=2000)::DOUBLE AS tp, count(*) FILTER (y=0 AND score>=2000)::DOUBLE AS fp, count(*) FILTER (y=0 AND score<2000)::DOUBLE AS tn, count(*) FILTER (y=1 AND score<2000)::DOUBLE AS fn FROM scores"
register("confusion", "tp:i fp:i tn:i fn:i accuracy:d precision:d recall:d f1:d mcc:d", lambda s, d: testing.confusion(scores(s, d), "y", (F.col("score") >= 2000).cast("int")), f"""
WITH c AS ({CM}) SELECT *, (tp+tn)/(tp+fp+tn+fn) AS accuracy, tp/(tp+fp) AS precision, tp/(tp+fn) AS recall, 2*tp/(2*tp+fp+fn) AS f1, (tp*tn-fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)) AS mcc FROM c""")
CURVE = "c AS (SELECT score AS threshold, sum(y) AS p, sum(1-y) AS n FROM scores GROUP BY 1), k AS (SELECT threshold, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM c WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))"
register("roc_curve", "threshold:t tpr:d fpr:d", lambda s, d: testing.roc_curve(scores(s, d), "y", "score"), f"WITH {CURVE} SELECT threshold, tp/pos AS tpr, fp/neg AS fpr FROM k UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0")
register("pr_curve", "threshold:t precision:d recall:d", lambda s, d: testing.precision_recall_curve(scores(s, d), "y", "score"), f"WITH {CURVE} SELECT threshold, tp/(tp+fp) AS precision, tp/pos AS recall FROM k UNION ALL SELECT 'inf'::DOUBLE, 1.0, 0.0")
register("roc_auc_ap", "auc:d average_precision:d", lambda s, d: testing.auc(scores(s, d), "y", "score"), f"""
WITH {CURVE}, z AS (SELECT *, coalesce(lag(tp) OVER (ORDER BY threshold DESC), 0) AS tp0, coalesce(lag(fp) OVER (ORDER BY threshold DESC), 0) AS fp0 FROM k)
SELECT sum((fp-fp0)*(tp+tp0)/2.0/(pos*neg)) AS auc, sum((tp-tp0)/pos*(tp/(tp+fp))) AS average_precision FROM z""")
ADJ = {
    "bonferroni": "p*m", "holm": "max(p*(m-r+1)) OVER (ORDER BY p, id ROWS UNBOUNDED PRECEDING)", "hochberg": "min(p*(m-r+1)) OVER (ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
    "bh": "min(p*m/r) OVER (ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", "by": "min(p*m*c/r) OVER (ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
}
for _m, _q in ADJ.items():
    register(f"padj_{_m}", "id:i p_adj:d reject:t", lambda s, d, m=_m: testing.adjust(p_values(s, d), "p", m, "id"), f"""
WITH r AS (SELECT id, p, count(*) OVER () AS m, row_number() OVER (ORDER BY p, id) AS r FROM pvals), h AS (SELECT *, sum(1.0::DOUBLE/r) OVER () AS c FROM r), a AS (SELECT id, least({_q}, 1.0) AS p_adj FROM h)
SELECT id, p_adj, p_adj <= 0.05 AS reject FROM a""")
register("padj_bh_by_family", "id:i p_adj:d reject:t", lambda s, d: testing.adjust(p_values(s, d), "p", "fdr_bh", "id", ("family",)), """
WITH r AS (SELECT id, family, p, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, id) AS r FROM pvals),
a AS (SELECT id, least(min(p*m/r) OVER (PARTITION BY family ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS p_adj FROM r) SELECT id, p_adj, p_adj <= 0.05 AS reject FROM a""")
#: Fisher's tail by Simpson's rule over the chi-square density with 2k degrees; Stouffer's z is checked by its own tail.
register("pcombine", "family:s k:i fisher:d fisher_p:r cauchy_p:d", lambda s, d: testing.combine(p_values(s, d), "p", "family"), """
WITH c AS (SELECT family, count(*) AS k, -2*sum(ln(p)) AS fisher, 0.5-atan(avg(tan((0.5-p)*pi())))/pi() AS cauchy_p FROM pvals GROUP BY 1)
SELECT *, 1-fisher/12000.0::DOUBLE*(SELECT sum(CASE WHEN j=4000 THEN 1 WHEN j%2=1 THEN 4 ELSE 2 END*exp((k-1)*ln(fisher*j/4000)-fisher*j/8000-k*ln(2)-lgamma(k::DOUBLE))) FROM range(1,4001) q(j)) AS fisher_p FROM c""", 6)

# --- panel -------------------------------------------------------------------------------------------------------------

def _daily(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.sum("o_totalprice").alias("y"))


register("hac_mean", "mean:d se:d", lambda s, d: panel.newey_west_mean(_daily(s, d), "y", "day", 4), """
WITH s AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS y FROM orders GROUP BY 1), e AS (SELECT day, y-avg(y) OVER () AS e, avg(y) OVER () AS m FROM s),
l AS (SELECT m, e, lag(e,1) OVER w AS e1, lag(e,2) OVER w AS e2, lag(e,3) OVER w AS e3, lag(e,4) OVER w AS e4 FROM e WINDOW w AS (ORDER BY day))
SELECT any_value(m) AS mean, sqrt(sum(e*e)+2*0.8*sum(e*e1)+2*0.6*sum(e*e2)+2*0.4*sum(e*e3)+2*0.2*sum(e*e4))/count(*) AS se FROM l""", 6)

# --- survival ----------------------------------------------------------------------------------------------------------

BETA = 0.1
RISK = f"a AS (SELECT time, sum(event) AS d, sum(event*x) AS dx, sum(exp({BETA}*x)) AS w0, sum(exp({BETA}*x)*x) AS w1, sum(exp({BETA}*x)*x*x) AS w2, count(*) AS k FROM spells GROUP BY 1), r AS (SELECT time, d, dx, sum(w0) OVER w AS s0, sum(w1) OVER w AS s1, sum(w2) OVER w AS s2, sum(k) OVER w AS n FROM a WINDOW w AS (ORDER BY time DESC ROWS UNBOUNDED PRECEDING))"
register("cox_breslow", "loglik:d gradient:d information:d", lambda s, d: survival.cox_breslow(spells(s, d), BETA), f"WITH {RISK} SELECT sum(dx*{BETA}-d*ln(s0)) AS loglik, sum(dx-d*s1/s0) AS gradient, sum(d*(s2/s0-(s1/s0)*(s1/s0))) AS information FROM r WHERE d > 0", 6)
register("cox_baseline", "time:d hazard:d survival:d", lambda s, d: survival.baseline(spells(s, d), BETA), f"WITH {RISK}, h AS (SELECT time, sum(d/s0) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING) AS hazard FROM r WHERE d > 0) SELECT time, hazard, exp(-hazard) AS survival FROM h")
register("cox_survival_at", "time:d survival:d", lambda s, d: survival.survival_at(spells(s, d), s.range(20).select((F.col("id") * 37.5).alias("time")), BETA), f"""
WITH {RISK}, h AS (SELECT time, exp(-sum(d/s0) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING)) AS s FROM r WHERE d > 0), q AS (SELECT i*37.5::DOUBLE AS time FROM range(20) t(i))
SELECT q.time, coalesce((SELECT arg_max(h.s, h.time) FROM h WHERE h.time <= q.time), 1.0) AS survival FROM q""")
register("kaplan_meier", "time:d survival:d n_at_risk:i", lambda s, d: survival.kaplan_meier(spells(s, d)), f"WITH {RISK} SELECT time, CASE WHEN max((d>=n)::INT) OVER w = 1 THEN 0.0 ELSE exp(sum(CASE WHEN d<n THEN ln(1-d/n) END) OVER w) END AS survival, n AS n_at_risk FROM r WHERE d > 0 WINDOW w AS (ORDER BY time ROWS UNBOUNDED PRECEDING)", 7)
register("log_rank", "observed:d expected:d variance:d chi2:d", lambda s, d: survival.log_rank(spells(s, d).withColumn("g", (F.col("x") > 2.5).cast("int")), "g"), """
WITH a AS (SELECT time, sum(event) AS d, sum(event*(x>2.5)::INT) AS d1, count(*) AS k, sum((x>2.5)::INT) AS k1 FROM spells GROUP BY 1),
r AS (SELECT d, d1, sum(k) OVER w AS n, sum(k1) OVER w AS n1 FROM a WINDOW w AS (ORDER BY time DESC ROWS UNBOUNDED PRECEDING)),
t AS (SELECT sum(d1) AS observed, sum(d*n1/n) AS expected, sum(CASE WHEN n>1 THEN d*(n1/n)*(1-n1/n)*(n-d)/(n-1) ELSE 0 END) AS variance FROM r WHERE d > 0)
SELECT *, (observed-expected)*(observed-expected)/variance AS chi2 FROM t""", 5)
register("cox_fit", "beta:d", lambda s, d: from_row(s, ["beta"], [(survival.cox_fit(spells(s, d)),)], "d"), fit_sql.cox(), digits=6)

# --- covariance, clusters, kernels, resampling -------------------------------------------------------------------------

C3 = ["l_quantity", "l_discount", "l_tax"]
CELLS = ", ".join(f"covar_pop({a},{b}) AS s{i}{j}" for i, a in enumerate(C3) for j, b in enumerate(C3) if j >= i)


def _matrix(s: SparkSession, m: np.ndarray) -> DataFrame:
    return from_row(s, ["cell", "value"], [(f"{i}{j}", float(m[i, j])) for i in range(len(m)) for j in range(i, len(m))], "sd")


def _cells_sql(diagonal: str, off: str) -> str:
    return " UNION ALL ".join(f"SELECT '{i}{j}' AS cell, {(diagonal if i == j else off).format(c=f's{i}{j}')} AS value FROM t" for i in range(3) for j in range(i, 3))


register("cov_empirical", "cell:s value:d", lambda s, d: _matrix(s, multivariate.covariance(LI(s, d), C3)[0]), f"WITH t AS (SELECT {CELLS} FROM lineitem) {_cells_sql('{c}', '{c}')}", 5)
register("cov_shrunk", "cell:s value:d", lambda s, d: _matrix(s, multivariate.shrunk(multivariate.covariance(LI(s, d), C3)[0], 0.1)), f"WITH t AS (SELECT {CELLS} FROM lineitem) {_cells_sql('0.9*{c}+0.1*(s00+s11+s22)/3', '0.9*{c}')}", 5)


def _oas(s: SparkSession, d: str) -> DataFrame:
    c, _, n = multivariate.covariance(LI(s, d), C3)
    return from_row(s, ["shrinkage"], [(float(multivariate.oas(c, n)[1]),)], "d")


register("cov_oas", "shrinkage:d", _oas, f"""
WITH t AS (SELECT {CELLS}, count(*) AS n FROM lineitem), m AS (SELECT n, (s00+s11+s22)/3 AS mu, (s00*s00+s11*s11+s22*s22+2*(s01*s01+s02*s02+s12*s12))/9 AS al FROM t)
SELECT least((al+mu*mu)/((n+1)*(al-mu*mu/3)), 1.0) AS shrinkage FROM m""", 5)
register("mahalanobis", "key:i d2:d", lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("key"), multivariate.mahalanobis(table(s, d, "part"), ["p_size", "p_retailprice"]).alias("d2")), """
WITH t AS (SELECT covar_pop(p_size,p_size) AS a, covar_pop(p_size,p_retailprice) AS b, covar_pop(p_retailprice,p_retailprice) AS c, avg(p_size) AS m1, avg(p_retailprice) AS m2 FROM part)
SELECT p_partkey AS key, (c*(p_size-m1)*(p_size-m1)-2*b*(p_size-m1)*(p_retailprice-m2)+a*(p_retailprice-m2)*(p_retailprice-m2))/(a*c-b*b) AS d2 FROM part, t""", 5)


def _pca(s: SparkSession, d: str) -> DataFrame:
    return from_row(s, ["first", "second"], [tuple(map(float, multivariate.pca(LI(s, d), ["l_quantity", "l_tax"])[0]))], "dd")


register("pca_two", "first:d second:d", _pca, """
WITH t AS (SELECT covar_samp(l_quantity,l_quantity) AS a, covar_samp(l_quantity,l_tax) AS b, covar_samp(l_tax,l_tax) AS c FROM lineitem)
SELECT (a+c)/2+sqrt((a-c)*(a-c)/4+b*b) AS first, (a*c-b*b)/((a+c)/2+sqrt((a-c)*(a-c)/4+b*b)) AS second FROM t""", 5)
CENTRES = [[10.0, 0.02], [25.0, 0.05], [40.0, 0.08]]
DIST = ", ".join(f"(l_quantity-{a})*(l_quantity-{a})+(l_discount-{b})*(l_discount-{b}) AS d{i}" for i, (a, b) in enumerate(CENTRES))
register("kmeans_step", "label:i n:i inertia:d l_quantity:d l_discount:d", lambda s, d: multivariate.kmeans_step(LI(s, d), ["l_quantity", "l_discount"], CENTRES), f"""
WITH t AS (SELECT l_quantity, l_discount, {DIST} FROM lineitem), a AS (SELECT *, CASE WHEN d0<=d1 AND d0<=d2 THEN 0 WHEN d1<=d2 THEN 1 ELSE 2 END AS label, least(d0,d1,d2) AS d2_ FROM t)
SELECT label, count(*) AS n, sum(d2_) AS inertia, avg(l_quantity) AS l_quantity, avg(l_discount) AS l_discount FROM a GROUP BY 1""", 6)
register("kmeans_fit", "label:i a:d b:d", lambda s, d: from_row(s, ["label", "a", "b"], [(float(i), *map(float, c)) for i, c in enumerate(multivariate.kmeans(LI(s, d), ["l_quantity", "l_discount"], CENTRES))], "ddd"), fit_sql.kmeans("lineitem", "l_quantity", "l_discount", CENTRES), digits=6)
register("clusters_1d", "id:i label:i", lambda s, d: multivariate.clusters_1d(table(s, d, "supplier"), "s_acctbal", "s_suppkey", 100.0), """
WITH g AS (SELECT s_suppkey AS id, s_acctbal AS x, CASE WHEN s_acctbal-lag(s_acctbal) OVER (ORDER BY s_acctbal, s_suppkey) > 100 THEN 1 ELSE 0 END AS c FROM supplier)
SELECT id, sum(c) OVER (ORDER BY x, id ROWS UNBOUNDED PRECEDING) AS label FROM g""")
register("radius_neighbours", "id:i n:i", lambda s, d: multivariate.neighbours_within(table(s, d, "customer"), "c_acctbal", "c_custkey", 20.0), "SELECT a.c_custkey AS id, count(*) AS n FROM customer a JOIN customer b ON abs(a.c_acctbal-b.c_acctbal) <= 20.0 GROUP BY 1")
POINTS = [float(p) for p in range(-1000, 10001, 1000)]
for _n in fn.KERNELS:
    register(f"kde_{_n}", "point:d density:d", lambda s, d, n=_n: multivariate.kde(table(s, d, "customer"), "c_acctbal", POINTS, 500.0, n), f"SELECT point, avg(k)/500.0 AS density FROM (SELECT point, {fn.SQL['kernel'][_n]} AS k FROM (SELECT point, (point-c_acctbal)/500.0 AS u FROM customer, (SELECT unnest({POINTS}) AS point))) GROUP BY 1", 6)
register("bandwidths", "scott:d silverman:d nrd0:d", lambda s, d: multivariate.bandwidths(table(s, d, "customer"), "c_acctbal"), """
WITH t AS (SELECT stddev_samp(c_acctbal) AS s, count(*) AS n, quantile_cont(c_acctbal,0.75)-quantile_cont(c_acctbal,0.25) AS q FROM customer)
SELECT s*pow(n,-0.2) AS scott, s*pow(n*0.75,-0.2) AS silverman, 0.9*least(s,q/1.34)*pow(n,-0.2) AS nrd0 FROM t""")
SIZES = [float(p) for p in range(5, 50, 5)]
KR = f"w AS (SELECT point, p_size-point AS d, p_retailprice AS y, exp(-0.5*((p_size-point)/4.0)*((p_size-point)/4.0))/sqrt(2*pi()) AS w FROM part, (SELECT unnest({SIZES}) AS point)), t AS (SELECT point, sum(w) AS s0, sum(w*d) AS s1, sum(w*d*d) AS s2, sum(w*y) AS t0, sum(w*d*y) AS t1 FROM w GROUP BY 1)"
register("kreg_constant", "point:d fit:d", lambda s, d: multivariate.kernel_regression(table(s, d, "part"), "p_size", "p_retailprice", SIZES, 4.0), f"WITH {KR} SELECT point, t0/s0 AS fit FROM t")
register("kreg_linear", "point:d fit:d", lambda s, d: multivariate.kernel_regression(table(s, d, "part"), "p_size", "p_retailprice", SIZES, 4.0, linear=True), f"WITH {KR} SELECT point, (s2*t0-s1*t1)/(s0*s2-s1*s1) AS fit FROM t", 7)
DRAW = resampling.mixed_sql
AVG = lambda: F.avg("s_acctbal")
register("bootstrap_mean", "rep:i value:d", lambda s, d: resampling.bootstrap_values(table(s, d, "supplier"), AVG(), "s_suppkey", 50), f"""
WITH x AS (SELECT row_number() OVER (ORDER BY s_suppkey)-1 AS i, s_acctbal AS v FROM supplier), n AS (SELECT count(*) AS n FROM x),
d AS (SELECT rep, {DRAW('i', 'rep')}%n AS i FROM x, n, range(50) t(rep)) SELECT rep, avg(v) AS value FROM d JOIN x USING (i) GROUP BY 1""")
register("bootstrap_interval", "estimate:d mean:d std_err:d low:d high:d reps:i", lambda s, d: resampling.bootstrap(table(s, d, "supplier"), AVG(), "s_suppkey", 100), f"""
WITH x AS (SELECT row_number() OVER (ORDER BY s_suppkey)-1 AS i, s_acctbal AS v FROM supplier), n AS (SELECT count(*) AS n, avg(v) AS estimate FROM x),
d AS (SELECT rep, {DRAW('i', 'rep')}%n AS i FROM x, n, range(100) t(rep)), b AS (SELECT rep, avg(v) AS v FROM d JOIN x USING (i) GROUP BY 1)
SELECT any_value(estimate) AS estimate, avg(v) AS mean, stddev_samp(v) AS std_err, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high, count(*) AS reps FROM b, n""")
register("bootstrap_stratified", "rep:i value:d", lambda s, d: resampling.bootstrap_values(table(s, d, "supplier"), AVG(), "s_suppkey", 20, strategy="stratified", strata="s_nationkey"), f"""
WITH z AS (SELECT s_nationkey AS g, count(*) AS n, coalesce(sum(count(*)) OVER (ORDER BY s_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM supplier GROUP BY 1),
x AS (SELECT first + row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)-1 AS i, first, n, s_acctbal AS v FROM supplier JOIN z ON g = s_nationkey),
d AS (SELECT rep, first + {DRAW('i::BIGINT', 'rep')}%n AS i FROM x, range(20) t(rep)) SELECT rep, avg(v) AS value FROM d JOIN x USING (i) GROUP BY 1""")
register("bootstrap_block", "rep:i value:d", lambda s, d: resampling.bootstrap_values(table(s, d, "supplier"), AVG(), "s_suppkey", 20, strategy="block", block_size=4), f"""
WITH x AS (SELECT row_number() OVER (ORDER BY s_suppkey)-1 AS i, s_acctbal AS v FROM supplier), n AS (SELECT count(*) AS n FROM x),
d AS (SELECT rep, {DRAW('i//4', 'rep')}%(n-3) + i%4 AS i FROM x, n, range(20) t(rep)) SELECT rep, avg(v) AS value FROM d JOIN x USING (i) GROUP BY 1""")
register("kfold", "id:i fold:i", lambda s, d: resampling.folds(table(s, d, "part"), "p_partkey", 5), f"SELECT p_partkey AS id, ntile(5) OVER (ORDER BY {DRAW('p_partkey', '1')}, p_partkey)-1 AS fold FROM part")


def _bspline_sql(x: str, knots: list[float], degree: int, i: int) -> str:
    if degree == 0:
        return f"(CASE WHEN {x}>={knots[i]} AND {x}<{knots[i + 1]} THEN 1.0::DOUBLE ELSE 0.0 END)"
    a = f"({x}-{knots[i]})/{knots[i + degree] - knots[i]}*{_bspline_sql(x, knots, degree - 1, i)}"
    b = f"({knots[i + degree + 1]}-{x})/{knots[i + degree + 1] - knots[i + 1]}*{_bspline_sql(x, knots, degree - 1, i + 1)}"
    return f"({a}+{b})"


KNOTS = [float(k) for k in range(-20, 81, 10)]
register("bspline_cubic", "key:i b2:d b3:d b4:d", lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("key"), *[multivariate.bspline(F.col("p_size").cast("double"), KNOTS, 3, i).alias(f"b{i}") for i in (2, 3, 4)]), f"SELECT p_partkey AS key, {', '.join(f'{_bspline_sql('p_size::DOUBLE', KNOTS, 3, i)} AS b{i}' for i in (2, 3, 4))} FROM part")

# --- streams -----------------------------------------------------------------------------------------------------------

register("stream_window_moments", "start:t event_type:s n:i mean:d variance:d", lambda s, d: streaming.window_moments(table(s, d, "events")), "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, avg(value) AS mean, var_samp(value) AS variance FROM events GROUP BY ALL", 10)
register("stream_sessions", "user_id:i session:i n:i seconds:i", lambda s, d: streaming.sessions(table(s, d, "events")), """
WITH g AS (SELECT user_id, ts, event_id, CASE WHEN floor(epoch(ts))-floor(epoch(lag(ts) OVER w)) > 21600 THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, session, count(*) AS n, max(floor(epoch(ts)))-min(floor(epoch(ts))) AS seconds FROM s GROUP BY ALL""")
