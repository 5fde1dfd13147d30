"""SQL of iterative fits with one regressor, for comparison: recursive queries that repeat a step to its fixed point.

A fit's rows are a query with columns x and y. A step sums weighted products over the rows and solves for intercept and
slope in closed form, which a Gram matrix and a solver do in the package.
"""

from __future__ import annotations

#: (weight, slope of the loss) at the linear predictor e, by loss.
STEPS = {
    "squared_error": ("1.0", "e-y"),
    "logistic": ("greatest(1/(1+exp(-e))*(1-1/(1+exp(-e))), 1e-10)", "1/(1+exp(-e))-y"),
    "poisson": ("exp(e)", "exp(e)-y"),
    "gamma": ("1.0", "1-y*exp(-e)"),
    "inverse_gaussian": ("exp(-e)", "(exp(e)-y)*exp(-2*e)"),
    "negative_binomial": ("exp(e)/(1+exp(e))", "(exp(e)-y)/(1+exp(e))"),
    "tweedie": ("exp(0.5*e)", "(exp(e)-y)*exp(-0.5*e)"),
    "huber": ("least(1.0, {c}/abs(y-e))", "greatest(least(e-y, {c}), -{c})"),
    "bisquare": ("greatest(pow(greatest(1-(y-e)*(y-e)/({c}*{c}), 0), 2), 1e-12)", "(e-y)*pow(greatest(1-(y-e)*(y-e)/({c}*{c}), 0), 2)"),
    "fair": ("1/(1+abs(y-e)/{c})", "(e-y)/(1+abs(y-e)/{c})"),
}


def soft(z: str, t: str) -> str:
    return f"(sign({z})*greatest(abs({z})-({t}),0))"


def penalized_slope(penalty: str, alpha: str) -> str:
    """The slope that minimizes v b^2 / 2 - t b + penalty(b)."""
    return {
        "none": "t/v",
        "l2": f"t/(v+{alpha})",
        "l1": f"{soft('t', alpha)}/v",
        "elasticnet": f"{soft('t', f'0.5*{alpha}')}/(v+0.5*{alpha})",
        "scad": f"CASE WHEN abs(t)<={alpha}*(v+1) THEN {soft('t', alpha)}/v WHEN abs(t)<=3.7*{alpha}*v THEN (2.7*t-sign(t)*3.7*{alpha})/(2.7*v-1) ELSE t/v END",
        "mcp": f"CASE WHEN abs(t)<=3*{alpha}*v THEN {soft('t', alpha)}/(v-1.0/3) ELSE t/v END",
    }[penalty]


def reweighted(rows: str, loss: str, penalty: str = "none", alpha: str = "0.0", start: str = "0.0", steps: int = 40, constant: str = "1.0", views: str = "") -> str:
    """(intercept, slope) after steps from (start, 0). alpha may use n, the number of rows; constant: the robust losses' width."""
    w, g = (f.format(c=f"({constant})") for f in STEPS[loss])
    return f"""WITH RECURSIVE {views} rows_ AS ({rows}), size_ AS (SELECT count(*)::DOUBLE AS n FROM rows_), it(k, a, b) AS (SELECT 0, CAST({start} AS DOUBLE), 0.0::DOUBLE UNION ALL
SELECT k+1, t0/s0-s1/s0*b, b FROM (SELECT k, s0, s1, t0, {penalized_slope(penalty, alpha)} AS b FROM (
SELECT k, n, s0, s1, t0, (s2-s1*s1/s0)/n AS v, (t1-s1*t0/s0)/n AS t FROM (
SELECT k, any_value(n) AS n, sum(w) AS s0, sum(w*x) AS s1, sum(w*x*x) AS s2, sum(w*e-g) AS t0, sum((w*e-g)*x) AS t1 FROM (
SELECT k, n, x, e, {w} AS w, {g} AS g FROM (SELECT k, n, x, y, a+b*x AS e FROM it, rows_, size_)) GROUP BY k))) WHERE k < {steps})
SELECT a AS intercept, b AS slope FROM it WHERE k = {steps}"""


def quantile(rows: str, q: float, steps: int = 80) -> str:
    """Majorized check loss whose width halves down to 1e-4 of the residuals' scale."""
    return f"""WITH RECURSIVE rows_ AS ({rows}), o AS (SELECT regr_intercept(y,x) AS a, regr_slope(y,x) AS b, sqrt((regr_syy(y,x)-regr_sxy(y,x)*regr_sxy(y,x)/regr_sxx(y,x))/count(*)) AS scale, count(*)::DOUBLE AS n, sum(x) AS sx FROM rows_),
it(k, a, b) AS (SELECT 0, a, b FROM o UNION ALL SELECT k+1, (s2*t0-s1*t1)/(s0*s2-s1*s1), (s0*t1-s1*t0)/(s0*s2-s1*s1) FROM (
SELECT k, sum(w) AS s0, sum(w*x) AS s1, sum(w*x*x) AS s2, sum(w*y)+any_value(n)*({2 * q - 1}) AS t0, sum(w*x*y)+any_value(sx)*({2 * q - 1}) AS t1 FROM (
SELECT k, n, sx, x, y, 1/(o.scale*greatest(1e-4, pow(0.5, k+1))+abs(y-it.a-it.b*x)) AS w FROM it, rows_, o) GROUP BY k) WHERE k < {steps})
SELECT a AS intercept, b AS slope FROM it WHERE k = {steps}"""


def cox(steps: int = 12) -> str:
    """Newton's steps of Breslow's partial likelihood over rows of the view spells."""
    return f"""WITH RECURSIVE it(k, b) AS (SELECT 0, 0.0::DOUBLE UNION ALL SELECT k+1, b+greatest(-2.0, least(2.0, g/h)) FROM (
SELECT k, any_value(b) AS b, sum(dx-d*s1/s0) AS g, sum(d*(s2/s0-(s1/s0)*(s1/s0))) AS h FROM (
SELECT k, b, d, dx, sum(w0) OVER w AS s0, sum(w1) OVER w AS s1, sum(w2) OVER w AS s2 FROM (
SELECT k, any_value(b) AS b, time, sum(event) AS d, sum(event*x) AS dx, sum(exp(b*x)) AS w0, sum(exp(b*x)*x) AS w1, sum(exp(b*x)*x*x) AS w2 FROM it, spells GROUP BY k, time)
WINDOW w AS (PARTITION BY k ORDER BY time DESC ROWS UNBOUNDED PRECEDING)) WHERE d > 0 GROUP BY k) WHERE k < {steps}) SELECT b AS beta FROM it WHERE k = {steps}"""


def kmeans(table: str, x: str, y: str, centres: list[list[float]], steps: int = 20) -> str:
    """Lloyd's steps in two dimensions; a centre without points stays."""
    n = range(len(centres))
    names = ", ".join(f"a{i}, b{i}" for i in n)
    start = ", ".join(f"{a}::DOUBLE, {b}::DOUBLE" for a, b in centres)
    dist = ", ".join(f"({x}-a{i})*({x}-a{i})+({y}-b{i})*({y}-b{i}) AS d{i}" for i in n)
    label = "CASE " + " ".join(f"WHEN d{i}=least({', '.join(f'd{j}' for j in n)}) THEN {i}" for i in n) + " END"
    means = ", ".join(f"coalesce(avg(px) FILTER (l={i}), any_value(a{i})), coalesce(avg(py) FILTER (l={i}), any_value(b{i}))" for i in n)
    rows = " UNION ALL ".join(f"SELECT {i} AS label, a{i} AS a, b{i} AS b FROM it WHERE k = {steps}" for i in n)
    return f"""WITH RECURSIVE it(k, {names}) AS (SELECT 0, {start} UNION ALL SELECT k+1, {means} FROM (SELECT *, {label} AS l FROM (SELECT it.*, {x} AS px, {y} AS py, {dist} FROM it, {table})) WHERE k < {steps} GROUP BY k) {rows}"""


def mixture(table: str, x: str, weights: list[float], means: list[float], variances: list[float], steps: int = 100, tol: float = 1e-3) -> str:
    """EM of two normal parts, ended when the mean log-likelihood gains less than tol."""
    dens = [f"ln(w{i})-0.5*ln(2*pi()*v{i})-(x-m{i})*(x-m{i})/(2*v{i})" for i in range(2)]
    return f"""WITH RECURSIVE rows_ AS (SELECT {x}::DOUBLE AS x FROM {table}), it(k, w0, m0, v0, w1, m1, v1, last, ll) AS (
SELECT 0, {weights[0]}::DOUBLE, {means[0]}::DOUBLE, {variances[0]}::DOUBLE, {weights[1]}::DOUBLE, {means[1]}::DOUBLE, {variances[1]}::DOUBLE, -1e300::DOUBLE, -1e299::DOUBLE UNION ALL
SELECT k+1, sum(r)/count(*), sum(r*x)/sum(r), greatest(sum(r*x*x)/sum(r)-pow(sum(r*x)/sum(r),2), 1e-6), sum(1-r)/count(*), sum((1-r)*x)/sum(1-r), greatest(sum((1-r)*x*x)/sum(1-r)-pow(sum((1-r)*x)/sum(1-r),2), 1e-6), any_value(ll), avg(t)
FROM (SELECT k, ll, x, exp(a)/(exp(a)+exp(b)) AS r, ln(exp(a)+exp(b)) AS t FROM (SELECT k, ll, x, {dens[0]} AS a, {dens[1]} AS b FROM it, rows_ WHERE k < {steps} AND ll-last >= {tol})) GROUP BY k),
f AS (SELECT * FROM it ORDER BY k DESC LIMIT 1) SELECT 0 AS label, w0 AS weight, m0 AS mean, v0 AS variance FROM f UNION ALL SELECT 1, w1, m1, v1 FROM f"""


def bisected(density: str, base: float, value: float, low: float, high: float, points: int = 19) -> str:
    """Quantiles i / 20 by bisection of Simpson's sums of a density of u from base, where the distribution has a value."""
    return f"""WITH RECURSIVE it(k, i, a, b) AS (SELECT 0, i, {low}::DOUBLE, {high}::DOUBLE FROM range(1, {points + 1}) t(i) UNION ALL
SELECT k+1, i, CASE WHEN c < i/20.0::DOUBLE THEN (a+b)/2 ELSE a END, CASE WHEN c < i/20.0::DOUBLE THEN b ELSE (a+b)/2 END FROM (
SELECT k, i, any_value(a) AS a, any_value(b) AS b, {value} + (any_value(a+b)/2-{base})/6000*sum(w*({density})) AS c FROM (
SELECT k, i, a, b, {base}+((a+b)/2-{base})*j/2000 AS u, CASE WHEN j IN (0,2000) THEN 1 WHEN j%2=1 THEN 4 ELSE 2 END AS w FROM it, range(2001) q(j) WHERE k < 45) GROUP BY k, i))
SELECT i, (a+b)/2 AS value FROM it WHERE k = 45"""


def ordered_logit(rows: str, steps: int = 40) -> str:
    """Scoring steps on products of scores, for three categories y of 0, 1, 2 and one regressor x."""
    f = "1/(1+exp(-({})))"
    det = "(gaa*(gcc*gbb-gcb*gcb)-gac*(gac*gbb-gcb*gab)+gab*(gac*gcb-gcc*gab))"
    da = "(sa*(gcc*gbb-gcb*gcb)-gac*(sc*gbb-gcb*sb)+gab*(sc*gcb-gcc*sb))"
    dc = "(gaa*(sc*gbb-gcb*sb)-sa*(gac*gbb-gcb*gab)+gab*(gac*sb-sc*gab))"
    db = "(gaa*(gcc*sb-sc*gcb)-gac*(gac*sb-sc*gab)+sa*(gac*gcb-gcc*gab))"
    return f"""WITH RECURSIVE rows_ AS ({rows}), p AS (SELECT avg((y=0)::INT) AS p0, avg((y<=1)::INT) AS p1 FROM rows_),
it(k, a, c, b, ll) AS (SELECT 0, ln(p0/(1-p0)), ln(p1/(1-p1)), 0.0::DOUBLE, 0.0::DOUBLE FROM p UNION ALL
SELECT k+1, a+{da}/{det}, c+{dc}/{det}, b+{db}/{det}, ll FROM (SELECT k, any_value(a) AS a, any_value(c) AS c, any_value(b) AS b, sum(l) AS ll, sum(ua) AS sa, sum(uc) AS sc, sum(ub) AS sb,
sum(ua*ua) AS gaa, sum(ua*uc) AS gac, sum(uc*uc) AS gcc, sum(ua*ub) AS gab, sum(uc*ub) AS gcb, sum(ub*ub) AS gbb FROM (
SELECT k, a, c, b, ln(pr) AS l, CASE y WHEN 0 THEN fu WHEN 1 THEN -fl ELSE 0 END AS ua, CASE y WHEN 1 THEN fu WHEN 2 THEN -fl ELSE 0 END AS uc, (fl-fu)*x AS ub FROM (
SELECT k, a, c, b, x, y, pr, CASE WHEN y<2 THEN u*(1-u) ELSE 0 END/pr AS fu, CASE WHEN y>0 THEN w*(1-w) ELSE 0 END/pr AS fl FROM (
SELECT *, CASE WHEN y<2 THEN u ELSE 1 END-CASE WHEN y>0 THEN w ELSE 0 END AS pr FROM (
SELECT k, a, c, b, x, y, {f.format('CASE y WHEN 0 THEN a ELSE c END-b*x')} AS u, {f.format('CASE y WHEN 1 THEN a ELSE c END-b*x')} AS w FROM it, rows_ WHERE k < {steps})))) GROUP BY k))
SELECT a AS first, c AS second, b AS slope, ll AS loglik FROM it WHERE k = {steps}"""


def additive_cells(cells: str, steps: int = 200) -> str:
    """A view `fit_` of cells (a, b, n, m, ...) with the weighted additive fit of their means, by fitting rows and columns in turn."""
    return f"""cells_ AS ({cells}), it(k, a, b, n, m, ra, rb) AS (SELECT 0, a, b, n::DOUBLE, m, 0.0::DOUBLE, 0.0::DOUBLE FROM cells_ UNION ALL
SELECT k+1, a, b, n, m, ra, sum(n*(m-ra)) OVER (PARTITION BY b)/sum(n) OVER (PARTITION BY b) FROM (SELECT k, a, b, n, m, sum(n*(m-rb)) OVER (PARTITION BY a)/sum(n) OVER (PARTITION BY a) AS ra FROM it WHERE k < {steps})),
fit_ AS (SELECT *, ra+rb AS f FROM it WHERE k = {steps})"""
