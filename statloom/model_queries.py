"""Queries of distributions and of fits by reweighted sums, with their SQL.

A distribution's SQL integrates its density by Simpson's rule, so it shares nothing with the series that it is compared to.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fit_sql
from .functions import special
from .functions.penalties import L1, ElasticNet, get_penalty
from .operators import cv, glm, linear, models, multivariate, resampling, solvers, survival, testing
from .registry import from_row, register, t_two_sided_sql
from .sources import p_values, scores, spells, table

# --- distributions -----------------------------------------------------------------------------------------------------

#: name: (parameters, first grid point, step, where the integral starts, its value there, density in SQL)
GRIDS = {
    "norm": ((), -3.0, 0.25, 0.0, 0.5, "exp(-u*u/2)/sqrt(2*pi())"),
    "t": ((5.0,), -4.0, 0.35, 0.0, 0.5, "exp(lgamma(3.0)-lgamma(2.5))/sqrt(5*pi())*pow(1+u*u/5,-3)"),
    "chi2": ((6.0,), 0.5, 0.9, 0.0, 0.0, "u*u*exp(-u/2)/16"),
    "gamma": ((3.0,), 0.2, 0.5, 0.0, 0.0, "u*u*exp(-u)/2"),
    "beta": ((3.0, 4.0), 0.02, 0.04, 0.0, 0.0, "60*u*u*pow(1-u,3)"),
    "f": ((6.0, 10.0), 0.1, 0.25, 0.0, 0.0, "pow(0.6,3)*u*u*pow(1+0.6*u,-8)*exp(lgamma(8.0)-lgamma(3.0)-lgamma(5.0))"),
    "lognorm": ((0.5,), 0.1, 0.2, 0.0, 0.0, "CASE WHEN u<=0 THEN 0 ELSE exp(-2*ln(u)*ln(u))/(u*0.5*sqrt(2*pi())) END"),
}
STEPS = 24


def _points(s: SparkSession, low: float, step: float) -> DataFrame:
    return s.range(STEPS).select(F.col("id").alias("i"), (F.lit(low) + F.col("id") * step).alias("x"))


for _n, (_args, _low, _step, _base, _value, _density) in GRIDS.items():
    _grid = f"SELECT i, CAST({_low} AS DOUBLE) + i * CAST({_step} AS DOUBLE) AS x FROM range({STEPS}) t(i)"
    register(f"cdf_{_n}", "i:i value:d", lambda s, d, n=_n, a=_args, lo=_low, st=_step: _points(s, lo, st).select("i", special.CDF[n](F.col("x"), *a).alias("value")), f"""
WITH x AS ({_grid}), q AS (SELECT i, x, {_base}+(x-{_base})*k/2000 AS u, CASE WHEN k IN (0,2000) THEN 1 WHEN k%2=1 THEN 4 ELSE 2 END AS w FROM x, range(2001) t(k))
SELECT i, {_value} + any_value(x-{_base})/6000*sum(w*({_density})) AS value FROM q GROUP BY i""", 6)
    register(f"pdf_{_n}", "i:i value:d", lambda s, d, n=_n, a=_args, lo=_low, st=_step: _points(s, lo, st).select("i", special.PDF[n](F.col("x"), *a).alias("value")), f"SELECT i, {_density} AS value FROM (SELECT i, x AS u FROM ({_grid}))")
    _ends = (-40.0, 40.0) if _base < _value else (0.0, 1.0 if _n == "beta" else 200.0)
    register(f"ppf_{_n}", "i:i value:r", lambda s, d, n=_n, a=_args, e=_ends: s.range(1, 20).select(F.col("id").alias("i"), special.ppf(lambda x: special.CDF[n](x, *a), F.col("id") / 20.0, *e).alias("value")), fit_sql.bisected(_density, _base, _value, *_ends), digits=5)
register("cdf_poisson", "i:i value:d", lambda s, d: s.range(20).select(F.col("id").alias("i"), special.poisson_cdf(F.col("id"), 4.5).alias("value")), "SELECT a.i, sum(exp(-4.5+b.i*ln(4.5)-lgamma(b.i+1.0))) AS value FROM range(20) a(i), range(20) b(i) WHERE b.i <= a.i GROUP BY a.i")
register("cdf_binom", "i:i value:d", lambda s, d: s.range(13).select(F.col("id").alias("i"), special.binom_cdf(F.col("id"), 12, 0.3).alias("value")), "SELECT a.i, sum(exp(lgamma(13.0)-lgamma(b.i+1.0)-lgamma(13.0-b.i)+b.i*ln(0.3)+(12-b.i)*ln(0.7))) AS value FROM range(13) a(i), range(13) b(i) WHERE b.i <= a.i GROUP BY a.i")

# --- regression --------------------------------------------------------------------------------------------------------

X2 = ["l_quantity", "l_discount"]


def _prices(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000)


def _plain(s: SparkSession, d: str) -> DataFrame:
    return glm.inference(_prices(s, d), "y", glm.fit(_prices(s, d), "y", ["l_quantity"]))


register("ols_inference", "term:s estimate:d std_err:d stat:d p:r low:d high:d", _plain, f"""
WITH r AS (SELECT regr_slope(y,x) AS b, regr_intercept(y,x) AS a, regr_sxx(y,x) AS sxx, avg(x) AS mx, count(*) AS n, (regr_syy(y,x)-regr_sxy(y,x)*regr_sxy(y,x)/regr_sxx(y,x))/(count(*)-2) AS s2 FROM (SELECT l_quantity AS x, l_extendedprice/1000 AS y FROM lineitem)),
t AS (SELECT 'intercept' AS term, a AS estimate, sqrt(s2*(1.0/n+mx*mx/sxx)) AS std_err, n-2 AS df FROM r UNION ALL SELECT 'l_quantity', b, sqrt(s2/sxx), n-2 FROM r),
u AS (SELECT *, estimate/std_err AS stat FROM t), q AS (SELECT df, z+(z*z*z+z)/(4*df)+(5*pow(z,5)+16*pow(z,3)+3*z)/(96*df*df) AS q FROM (SELECT DISTINCT df, 1.959963984540054::DOUBLE AS z FROM t))
SELECT term, estimate, std_err, stat, {t_two_sided_sql('stat', 'df')} AS p, estimate-q*std_err AS low, estimate+q*std_err AS high FROM u JOIN q USING (df)""", digits=5)
PRICES = "SELECT l_quantity AS x, l_extendedprice/1000 AS y FROM lineitem"
SCALE = f"sc AS (SELECT quantile_disc(abs(y-a-b*x), 0.5)/0.6745 AS c FROM ({PRICES}), (SELECT regr_intercept(y,x) AS a, regr_slope(y,x) AS b FROM ({PRICES}))),"


def _line(s: SparkSession, m) -> DataFrame:
    return from_row(s, ["intercept", "slope"], [tuple(map(float, m))], "dd")


for _k, _c in models.TUNING.items():
    register(f"robust_{_k}", "intercept:d slope:d", lambda s, d, k=_k: _line(s, models.robust_fit(_prices(s, d), "y", ["l_quantity"], k).beta), fit_sql.reweighted(PRICES, _k, constant=f"(SELECT c FROM sc)*{_c}", start="(SELECT median(y) FROM rows_)", steps=60, views=SCALE), digits=3)
for _q in (0.25, 0.5, 0.9):
    register(f"quantile_{int(_q * 100)}", "intercept:d slope:d", lambda s, d, q=_q: _line(s, models.quantile_fit(_prices(s, d), "y", ["l_quantity"], q)), fit_sql.quantile(PRICES, _q), digits=2)



def _quantile_errors(s: SparkSession, d: str) -> DataFrame:
    df = _prices(s, d)
    return models.quantile_inference(df, "y", ["l_quantity"], [50.0, 0.1]).select("term", "std_err")


#: Errors at given coefficients. The median's normal quantile is 0; SQL finds that of half plus the share by Newton's steps.
register("quantile_errors", "term:s std_err:d", _quantile_errors, f"""
WITH RECURSIVE r AS (SELECT x, y-50.0-0.1*x AS r FROM ({PRICES})), g AS (SELECT count(*) AS n, stddev_samp(r) AS sd, quantile_disc(r, 0.75)-quantile_disc(r, 0.25) AS iqr FROM r),
h AS (SELECT *, least(pow(n, -1.0/3)*pow(1.959963984540054, 2.0/3)*pow(1.5/(2*pi()), 1.0/3), 0.4995) AS s FROM g),
z(k, s, z) AS (SELECT 0, s, s*sqrt(2*pi()) FROM h UNION ALL SELECT k+1, s, z-(z/1200.0*(SELECT sum(CASE WHEN j IN (0,400) THEN 1 WHEN j%2=1 THEN 4 ELSE 2 END*exp(-z*z*j*j/320000.0)) FROM range(401) q(j))/sqrt(2*pi())-s)*sqrt(2*pi())*exp(z*z/2) FROM z WHERE k < 30),
w AS (SELECT least(sd, iqr/1.34)*2*z AS h FROM h, z WHERE k = 30), d AS (SELECT x, CASE WHEN abs(r/h)<=1 THEN 0.75*(1-(r/h)*(r/h)) ELSE 0 END/h AS k FROM r, w),
t AS (SELECT sum(k) AS d0, sum(k*x) AS d1, sum(k*x*x) AS d2, count(*)::DOUBLE AS n, sum(x) AS s1, sum(x*x) AS s2 FROM d), i AS (SELECT *, d2/(d0*d2-d1*d1) AS a, -d1/(d0*d2-d1*d1) AS b, d0/(d0*d2-d1*d1) AS c FROM t)
SELECT 'intercept' AS term, sqrt(0.25*(a*a*n+2*a*b*s1+b*b*s2)) AS std_err FROM i UNION ALL SELECT 'l_quantity', sqrt(0.25*(b*b*n+2*b*c*s1+c*c*s2)) FROM i""", digits=4)
COUNTS = "SELECT count(*)::DOUBLE AS y, avg(value)/50 AS x FROM events GROUP BY user_id"
BINARY = "SELECT y, score/1000 AS x FROM scores"


def _counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("y"), (F.avg("value") / 50).alias("x"))


def _binary(s: SparkSession, d: str) -> DataFrame:
    return scores(s, d).withColumn("x", F.col("score") / 1000)


#: (loss, penalty, strength on the mean loss, the same in SQL, rows, rows in SQL): each family with its default strength, then
#: other penalties.
FITS = [
    *[(f"glm_{f}", f, "l2", 0.5, "0.5", _counts, COUNTS) for f in ("poisson", "gamma", "inverse_gaussian", "negative_binomial", "tweedie")],
    ("glm_logistic", "logistic", "l2", None, "1.0/n", _binary, BINARY),
    ("glm_poisson_plain", "poisson", "none", 0.0, "0.0", _counts, COUNTS),
    ("penalized_logistic_l1", "logistic", "l1", 0.02, "0.02", _binary, BINARY), ("penalized_logistic_elasticnet", "logistic", "elasticnet", 0.02, "0.02", _binary, BINARY),
    ("penalized_poisson_elasticnet", "poisson", "elasticnet", 0.3, "0.3", _counts, COUNTS), ("penalized_gamma_l1", "gamma", "l1", 0.005, "0.005", _counts, COUNTS),
    ("penalized_negative_binomial_l1", "negative_binomial", "l1", 0.01, "0.01", _counts, COUNTS), ("penalized_tweedie_elasticnet", "tweedie", "elasticnet", 0.05, "0.05", _counts, COUNTS),
    ("penalized_inverse_gaussian_l2", "inverse_gaussian", "l2", 0.01, "0.01", _counts, COUNTS),
    ("penalized_squared_mcp", "squared_error", "mcp", 1.0, "1.0", None, "SELECT l_quantity/10 AS x, l_extendedprice/1000 AS y FROM lineitem"), ("penalized_squared_scad", "squared_error", "scad", 1.0, "1.0", None, "SELECT l_quantity/10 AS x, l_extendedprice/1000 AS y FROM lineitem"),
]


def _fit(s: SparkSession, d: str, loss: str, penalty: str, alpha: float | None, rows) -> DataFrame:
    df = _prices(s, d).withColumn("x", F.col("l_quantity") / 10) if rows is None else rows(s, d)
    strength = 1.0 / df.count() if alpha is None else alpha
    return _line(s, glm.fit(df, "y", ["x"], loss, penalty, strength).beta)


for _n, _l, _p, _a, _sql_a, _rows, _sql in FITS:
    _start = {"logistic": "(SELECT ln(avg(y)/(1-avg(y))) FROM rows_)", "squared_error": "0.0"}.get(_l, "(SELECT ln(avg(y)) FROM rows_)")
    register(_n, "intercept:d slope:r", lambda s, d, a=(_l, _p, _a, _rows): _fit(s, d, *a), fit_sql.reweighted(_sql, _l, _p, _sql_a, _start), digits=5)


def _inference(s: SparkSession, d: str, kind: str) -> DataFrame:
    df = _counts(s, d)
    m = glm.fit(df, "y", ["x"], "poisson")
    out = glm.inference(df, "y", m, kind)
    return out.select("term", "estimate", "std_err", "stat")


#: Errors of a Poisson fit from its curvature and, robust, from products of slopes, at the fixed point that SQL finds.
_FIT = fit_sql.reweighted(COUNTS, "poisson", "none", "0.0", "(SELECT ln(avg(y)) FROM rows_)")
for _k in ("nonrobust", "hc0", "hc1"):
    _meat = {"nonrobust": "SELECT 1 AS f, h00 AS m00, h01 AS m01, h11 AS m11 FROM h", "hc0": "SELECT 1 AS f, m00, m01, m11 FROM h", "hc1": "SELECT n/(n-2) AS f, m00, m01, m11 FROM h"}[_k]
    register(f"glm_poisson_{_k}", "term:s estimate:d std_err:d stat:d", lambda s, d, k=_k: _inference(s, d, k), f"""
WITH b AS MATERIALIZED ({_FIT}), u AS (SELECT x, y, exp(intercept+slope*x) AS m FROM ({COUNTS}), b),
h AS (SELECT count(*)::DOUBLE AS n, sum(m) AS h00, sum(m*x) AS h01, sum(m*x*x) AS h11, sum((m-y)*(m-y)) AS m00, sum((m-y)*(m-y)*x) AS m01, sum((m-y)*(m-y)*x*x) AS m11 FROM u),
i AS (SELECT h11/(h00*h11-h01*h01) AS i00, -h01/(h00*h11-h01*h01) AS i01, h00/(h00*h11-h01*h01) AS i11 FROM h), z AS ({_meat}),
v AS (SELECT f*(i00*i00*m00+2*i00*i01*m01+i01*i01*m11) AS v0, f*(i01*i01*m00+2*i01*i11*m01+i11*i11*m11) AS v1 FROM i, z)
SELECT 'intercept' AS term, intercept AS estimate, sqrt(v0) AS std_err, intercept/sqrt(v0) AS stat FROM b, v UNION ALL SELECT 'x', slope, sqrt(v1), slope/sqrt(v1) FROM b, v""", digits=4)


def _ordered(s: SparkSession, d: str, link: str) -> DataFrame:
    df = table(s, d, "lineitem").select(F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("y"), (F.col("l_quantity") / 10).alias("x"))
    cuts, slopes, value = models.ordered_fit(df, "y", ["x"], 3, link)
    return from_row(s, ["first", "second", "slope", "loglik"], [(float(cuts[0]), float(cuts[1]), float(slopes[0]), value)], "dddd")


for _l in ("logit", "probit"):
    register(f"ordered_{_l}", "first:d second:d slope:r loglik:d", lambda s, d, li=_l: _ordered(s, d, li), fit_sql.ordered_logit("SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y, l_quantity/10 AS x FROM lineitem") if _l == "logit" else None, digits=3)
ALPHAS = [0.0, 0.1, 1.0, 10.0, 100.0]
register("ridge_cv", "alpha:d mse:d", lambda s, d: models.ridge_cv(_prices(s, d), "y", ["l_quantity"], F.col("l_orderkey") % 5, ALPHAS), f"""
WITH r AS (SELECT l_orderkey % 5 AS f, l_quantity AS x, l_extendedprice/1000 AS y FROM lineitem), k AS (SELECT unnest([0, 1, 2, 3, 4]) AS f),
t AS (SELECT k.f, count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y,x) AS sxx, regr_sxy(y,x) AS sxy FROM r, k WHERE r.f <> k.f GROUP BY k.f),
b AS (SELECT f, alpha, mx, my, sxy/(sxx+alpha*n) AS b FROM t, (SELECT unnest({ALPHAS})::DOUBLE AS alpha)),
e AS (SELECT f, alpha, avg((y-my-b*(x-mx))*(y-my-b*(x-mx))) AS e FROM b JOIN r USING (f) GROUP BY ALL) SELECT alpha, avg(e) AS mse FROM e GROUP BY alpha""", 6)
#: Each solver comes to the same fixed point as SQL's reweighted steps.
for _s, _p in [("fista", "l1"), ("fista_bb", "l1"), ("newton", "l2"), ("proximal_newton", "elasticnet"), ("lbfgs", "l2"), ("lbfgs_b", "l2"), ("admm", "l1"), ("irls", "l2")]:
    register(f"solver_{_s}", "intercept:d slope:d", lambda s, d, n=_s, p=_p: _line(s, solvers.solve(_binary(s, d), "y", ["x"], "logistic", get_penalty(p, alpha=0.02), n, tol=1e-4 if n in ("fista", "admm") else 1e-6)), fit_sql.reweighted(BINARY, "logistic", _p, "0.02", "(SELECT ln(avg(y)/(1-avg(y))) FROM rows_)"), digits=2)
STRENGTHS = [0.01, 0.1, 1.0, 10.0]
FOLDED = f"""r AS (SELECT l_orderkey % 5 AS f, l_quantity AS x, l_extendedprice/1000 AS y FROM lineitem), k AS (SELECT unnest([0, 1, 2, 3, 4]) AS f),
t AS (SELECT k.f, avg(x) AS mx, avg(y) AS my, var_pop(x) AS v, covar_pop(y,x) AS c FROM r, k WHERE r.f <> k.f GROUP BY k.f), g AS (SELECT unnest({STRENGTHS})::DOUBLE AS alpha)"""
ERRORS = "e AS (SELECT f, alpha, avg((y-my-b*(x-mx))*(y-my-b*(x-mx))) AS e FROM b JOIN r USING (f) GROUP BY ALL) SELECT alpha, avg(e) AS mse FROM e GROUP BY alpha"


def _path(s: SparkSession, d: str, penalty) -> DataFrame:
    g = cv.fold_grams(_prices(s, d), "y", ["l_quantity"], F.col("l_orderkey") % 5, 5)
    return from_row(s, ["alpha", "mse"], [(a, float(m)) for a, m in zip(STRENGTHS, cv.linear_cv(g, penalty, STRENGTHS)[1], strict=True)], "dd")


register("lasso_cv", "alpha:d mse:d", lambda s, d: _path(s, d, L1), f"WITH {FOLDED}, b AS (SELECT f, alpha, mx, my, sign(c)*greatest(abs(c)-alpha,0)/v AS b FROM t, g), {ERRORS}", 6)
register("elastic_net_cv", "alpha:d mse:d", lambda s, d: _path(s, d, lambda a: ElasticNet(a, 0.5)), f"WITH {FOLDED}, b AS (SELECT f, alpha, mx, my, sign(c)*greatest(abs(c)-alpha/2,0)/(v+alpha/2) AS b FROM t, g), {ERRORS}", 6)


def _logistic_cv(s: SparkSession, d: str) -> DataFrame:
    alphas = [0.5, 0.05, 0.005]
    _, mean, _ = cv.glm_cv(_binary(s, d), "y", ["x"], F.col("id") % 3, 3, "logistic", "l2", alphas)
    return from_row(s, ["alpha", "loss"], [(a, float(v)) for a, v in zip(alphas, mean, strict=True)], "dd")


register("logistic_cv", "alpha:d loss:d", _logistic_cv, """
WITH RECURSIVE r AS (SELECT id % 3 AS f, y, score/1000 AS x FROM scores), g AS (SELECT f, alpha FROM (SELECT unnest([0, 1, 2]) AS f), (SELECT unnest([0.5, 0.05, 0.005])::DOUBLE AS alpha)),
it(k, f, alpha, a, b) AS (SELECT 0, f, alpha, 0.0::DOUBLE, 0.0::DOUBLE FROM g UNION ALL SELECT k+1, f, alpha, ((s2+n*alpha)*t0-s1*t1)/((s2+n*alpha)*s0-s1*s1), (s0*t1-s1*t0)/((s2+n*alpha)*s0-s1*s1) FROM (
SELECT k, f, alpha, count(*) AS n, sum(w) AS s0, sum(w*x) AS s1, sum(w*x*x) AS s2, sum(w*z) AS t0, sum(w*x*z) AS t1 FROM (
SELECT k, f, alpha, x, p*(1-p) AS w, a+b*x+(y-p)/(p*(1-p)) AS z FROM (SELECT it.*, x, y, 1/(1+exp(-a-b*x)) AS p FROM it, r WHERE it.f <> r.f AND k < 25)) GROUP BY k, f, alpha)),
l AS (SELECT it.f, alpha, avg(greatest(a+b*x,0)+ln(1+exp(-abs(a+b*x)))-y*(a+b*x)) AS l FROM it JOIN r ON it.f = r.f WHERE k = 25 GROUP BY ALL) SELECT alpha, avg(l) AS loss FROM l GROUP BY alpha""", 5)
KNOTS = [float(k) for k in range(-30, 91, 10)]


def _spline(s: SparkSession, d: str) -> DataFrame:
    df = table(s, d, "part").select((F.col("p_size") - 0.5).alias("x"), (F.col("p_retailprice") / 100 + F.sin(F.col("p_size") / 8)).alias("y"))
    basis = [multivariate.bspline(F.col("x"), KNOTS, 3, i) for i in range(len(KNOTS) - 4)]
    beta, lam, size = models.penalized_spline(df, "y", basis, list(np.logspace(-4, 6, 41)))
    return from_row(s, ["term", "value"], [("strength", lam), ("size", size), *[(f"b{i}", float(b)) for i, b in enumerate(beta)]], "sd")


register("spline_gcv", "term:s value:d", _spline, digits=3)

# --- panels, survival, covariances, mixtures, resampling ---------------------------------------------------------------

BETA = 0.1
RISK = f"a AS (SELECT time, sum(event) AS d, sum(event*x) AS dx, sum(exp({BETA}*x)) AS w0, sum(exp({BETA}*x)*x) AS w1, sum(event*exp({BETA}*x)) AS e0, sum(event*exp({BETA}*x)*x) AS e1, sum(exp({BETA}*x)*x*x) AS w2, sum(event*exp({BETA}*x)*x*x) AS e2 FROM spells GROUP BY 1), r AS (SELECT time, d, dx, e0, e1, e2, sum(w0) OVER w AS s0, sum(w1) OVER w AS s1, sum(w2) OVER w AS s2 FROM a WINDOW w AS (ORDER BY time DESC ROWS UNBOUNDED PRECEDING))"
register("cox_efron", "loglik:d gradient:d information:d", lambda s, d: survival.cox_efron(spells(s, d), BETA), f"""
WITH {RISK}, k AS (SELECT dx/d AS dx, s0-j/d*e0 AS t0, s1-j/d*e1 AS t1, s2-j/d*e2 AS t2 FROM (SELECT *, unnest(range(CAST(d AS BIGINT)))::DOUBLE AS j FROM r WHERE d > 0))
SELECT sum(dx*{BETA}-ln(t0)) AS loglik, sum(dx-t1/t0) AS gradient, sum(t2/t0-t1*t1/(t0*t0)) AS information FROM k""", 5)
register("cox_score_residuals", "id:i residual:r", lambda s, d: survival.score_residuals(spells(s, d), BETA), f"""
WITH {RISK}, h AS (SELECT time, s1/s0 AS m, sum(d/s0) OVER w AS h, sum(d/s0*s1/s0) OVER w AS hm FROM r WINDOW w AS (ORDER BY time ROWS UNBOUNDED PRECEDING))
SELECT id, event*(x-m)-exp({BETA}*x)*(x*h-hm) AS residual FROM spells JOIN h USING (time)""")
C3 = ["l_quantity", "l_discount", "l_tax"]
register("cov_ledoit_wolf", "shrinkage:d", lambda s, d: from_row(s, ["shrinkage"], [(models.ledoit_wolf(table(s, d, "part"), ["p_size", "p_retailprice"])[1],)], "d"), """
WITH m AS (SELECT avg(p_size) AS a, avg(p_retailprice) AS b FROM part), t AS (SELECT count(*) AS n, covar_pop(p_size,p_size) AS aa, covar_pop(p_size,p_retailprice) AS ab, covar_pop(p_retailprice,p_retailprice) AS bb FROM part),
f AS (SELECT sum(pow((p_size-a)*(p_size-a)+(p_retailprice-b)*(p_retailprice-b), 2)) AS f FROM part, m), s AS (SELECT n, f, aa*aa+2*ab*ab+bb*bb AS ss, (aa+bb)*(aa+bb)/2 AS tt FROM t, f)
SELECT greatest(0.0, least(1.0, (f-n*ss)/(n*n)/(ss-tt))) AS shrinkage FROM s""", 5)


def _glasso(s: SparkSession, d: str) -> DataFrame:
    c = multivariate.covariance(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])[0]
    sd = np.sqrt(np.diag(c))
    _, p = models.graphical_lasso(c / np.outer(sd, sd), 0.05)
    return from_row(s, ["cell", "value"], [(f"{i}{j}", float(p[i, j])) for i in range(4) for j in range(i, 4)], "sd")


register("graphical_lasso", "cell:s value:r", _glasso)


def _glasso_two(s: SparkSession, d: str) -> DataFrame:
    c = multivariate.covariance(table(s, d, "part").select((F.col("p_size") / 10).alias("a"), ((F.col("p_size") + F.col("p_partkey") % 13) / 10).alias("b")), ["a", "b"])[0]
    _, p = models.graphical_lasso(c, 0.3)
    return from_row(s, ["cell", "value"], [(f"{i}{j}", float(p[i, j])) for i in range(2) for j in range(i, 2)], "sd")


#: Two columns have a closed form: the off-diagonal covariance is drawn towards 0 by the strength.
register("graphical_lasso_two", "cell:s value:d", _glasso_two, """
WITH p AS (SELECT p_size/10.0::DOUBLE AS a, (p_size + p_partkey % 13)/10.0::DOUBLE AS b FROM part), c AS (SELECT covar_pop(a,a) AS aa, covar_pop(b,b) AS bb, sign(covar_pop(a,b))*greatest(abs(covar_pop(a,b))-0.3, 0) AS ab FROM p), d AS (SELECT *, aa*bb-ab*ab AS d FROM c)
SELECT '00' AS cell, bb/d AS value FROM d UNION ALL SELECT '01', -ab/d FROM d UNION ALL SELECT '11', aa/d FROM d""", 5)
START = ([0.5, 0.5], [15.0, 35.0], [100.0, 100.0])
LOGS = [f"ln({w})-0.5*ln(2*pi()*{v})-(l_quantity-{m})*(l_quantity-{m})/{2 * v}" for w, m, v in zip(*START, strict=True)]
register("mixture_step", "label:i weight:d mean:d variance:d loglik:d", lambda s, d: models.mixture_step(table(s, d, "lineitem"), "l_quantity", *START), f"""
WITH l AS (SELECT l_quantity AS v, {LOGS[0]} AS a, {LOGS[1]} AS b FROM lineitem), p AS (SELECT v, ln(exp(a)+exp(b)) AS t, exp(a)/(exp(a)+exp(b)) AS r FROM l), q AS (SELECT 0 AS label, v, t, r FROM p UNION ALL SELECT 1, v, t, 1-r FROM p)
SELECT label, sum(r)/count(*) AS weight, sum(r*v)/sum(r) AS mean, sum(r*v*v)/sum(r)-pow(sum(r*v)/sum(r), 2) AS variance, sum(t) AS loglik FROM q GROUP BY label""", 5)
register("mixture_fit", "label:i weight:d mean:d variance:d", lambda s, d: models.mixture_fit(table(s, d, "lineitem"), "l_quantity", *START), fit_sql.mixture("lineitem", "l_quantity", *START), digits=4)
H = np.array([[1.0, 0.5, 0.2], [0.3, 1.0, 0.6]])
HH = H @ H.T
W = [f"({'+'.join(f'{float(H[i, j])}*{c}' for j, c in enumerate(C3))})/{float(HH[i].sum())}" for i in range(2)]
register("nmf_step", "cell:s value:d", lambda s, d: from_row(s, ["cell", "value"], [(f"{i}{j}", float(v)) for i, r in enumerate(models.factor_step(table(s, d, "lineitem"), C3, H)[1]) for j, v in enumerate(r)], "sd"), f"""
WITH w AS (SELECT {W[0]} AS w0, {W[1]} AS w1, {', '.join(C3)} FROM lineitem), g AS (SELECT sum(w0*w0) AS g00, sum(w0*w1) AS g01, sum(w0*w1) AS g10, sum(w1*w1) AS g11, {', '.join(f'sum(w{i}*{c}) AS x{i}{j}' for i in range(2) for j, c in enumerate(C3))} FROM w)
{' UNION ALL '.join(f"SELECT '{i}{j}' AS cell, {float(H[i, j])}*x{i}{j}/(g{i}0*{float(H[0, j])}+g{i}1*{float(H[1, j])}) AS value FROM g" for i in range(2) for j in range(3))}""", 5)
GROUPS = f"""x AS (SELECT row_number() OVER (ORDER BY p_partkey)-1 AS i, p_retailprice AS y, (p_size>25)::INT AS g FROM part),
d AS (SELECT rep, i, g, row_number() OVER (PARTITION BY rep ORDER BY {resampling.mixed_sql('i', 'rep')}, i)-1 AS j FROM x, range(100) t(rep)),
r AS (SELECT d.rep, x.y, d.g FROM d JOIN x ON d.j = x.i)"""


def _parts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", "p_retailprice", "p_size").withColumn("g", (F.col("p_size") > 25).cast("int"))


DIFFERENCE = lambda: resampling.mean_difference("p_retailprice", "g")
register("permuted_differences", "rep:i diff:d", lambda s, d: resampling.shuffled(_parts(s, d), "g", "p_partkey", 100).groupBy("rep").agg(DIFFERENCE().alias("diff")), f"""
WITH {GROUPS} SELECT rep, avg(y) FILTER (g=1) - avg(y) FILTER (g=0) AS diff FROM r GROUP BY rep""", 6)
register("permutation_p", "statistic:d p:d reps:i", lambda s, d: resampling.permutation_test(_parts(s, d), DIFFERENCE(), "g", "p_partkey", 100), f"""
WITH {GROUPS}, o AS (SELECT avg(y) FILTER (g=1) - avg(y) FILTER (g=0) AS o FROM x), v AS (SELECT rep, avg(y) FILTER (g=1) - avg(y) FILTER (g=0) AS v FROM r GROUP BY rep)
SELECT any_value(o) AS statistic, (count(*) FILTER (abs(v) >= abs(o)) + 1)/(count(*) + 1) AS p, count(*) AS reps FROM v, o""", 6)
register("glm_dispersion", "phi:d", lambda s, d: linear.pearson_dispersion(scores(s, d).withColumn("m", F.lit(0.25) + 0.5 / (1 + F.exp(-F.col("score") / 1000))), "y", F.col("m"), F.col("m") * (1 - F.col("m")), 2), """
WITH m AS (SELECT y, 0.25+0.5/(1+exp(-score/1000)) AS m FROM scores) SELECT sum((y-m)*(y-m)/(m*(1-m)))/greatest(count(*)-2, 1) AS phi FROM m""", 6)
#: SQL finds each z by Newton steps on Simpson's sums of the density.
register("pcombine_stouffer", "family:s z:d", lambda s, d: testing.combine(p_values(s, d), "p", "family"), """
WITH RECURSIVE n(id, family, p, k, z) AS (SELECT id, family, p, 0, 0.0::DOUBLE FROM pvals UNION ALL
SELECT id, family, p, k+1, z - (0.5 + z/1200.0*(SELECT sum(CASE WHEN j IN (0,400) THEN 1 WHEN j%2=1 THEN 4 ELSE 2 END*exp(-z*z*j*j/320000.0)) FROM range(401) q(j))/sqrt(2*pi()) - (1-p))*sqrt(2*pi())*exp(least(z*z/2, 8)) FROM n WHERE k < 40)
SELECT family, sum(z)/sqrt(count(*)) AS z FROM n WHERE k = 40 GROUP BY family""", digits=5)
