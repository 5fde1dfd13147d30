"""Distributions invert each other; fits satisfy their optimality conditions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.functions import special
from statloom.model_queries import GRIDS
from statloom.operators import glm, models, multivariate, survival
from statloom.queries import QUERIES
from statloom.sources import spells, table


@pytest.fixture(scope="module")
def prices(spark, small):
    return table(spark, small, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000).cache()


@pytest.mark.parametrize("name", sorted(GRIDS))
def test_quantiles_invert(spark, name):
    args = GRIDS[name][0]
    ends = (-40.0, 40.0) if name in ("norm", "t") else (0.0, 1.0 if name == "beta" else 200.0)
    q = F.col("id") / 20.0
    rows = spark.range(1, 20).select(q.alias("q"), special.CDF[name](special.ppf(lambda x: special.CDF[name](x, *args), q, *ends), *args).alias("back")).collect()
    assert all(abs(r.q - r.back) < 1e-9 for r in rows)


def test_known_tails():
    assert abs(special.t_sf_two_sided(2.2281388519649385, 10) - 0.05) < 1e-10
    assert abs(special.t_quantile(0.975, 10) - 2.2281388519649385) < 1e-9
    assert abs(special.t_quantile(0.975, 1e6) - 1.959966) < 1e-4
    assert abs(special.f_sf(4.102821015, 2, 10) - 0.05) < 1e-8
    assert special.betainc_value(2, 3, 0) == 0 and special.betainc_value(2, 3, 1) == 1


def test_gamma_far_out(spark):
    got = spark.range(1).select(special.gammainc(400.0, F.lit(401.5)).alias("a"), special.gammainc(1.0, F.lit(30.0)).alias("b"), special.gammainc(0.5, F.lit(0.0)).alias("c")).first()
    k, want = 0, 0.0
    for k in range(400):  # Poisson sum of a whole shape
        want += math.exp(-401.5 + k * math.log(401.5) - math.lgamma(k + 1))
    assert abs(got.a - (1 - want)) < 1e-9 and abs(got.b - (1 - math.exp(-30))) < 1e-12 and got.c == 0


@pytest.mark.parametrize("kind", sorted(models.TUNING))
def test_robust_scores_are_zero(prices, kind):
    m = models.robust_fit(prices, "y", ["l_quantity"], kind)
    psi = m.loss.slope(F.col("y"), m.eta())
    n = prices.count()
    assert np.allclose(np.array(prices.agg(F.sum(psi), F.sum(psi * F.col("l_quantity"))).first()) / n, 0, atol=1e-5)


@pytest.mark.parametrize("q", [0.25, 0.9])
def test_quantile_leaves_its_share_below(prices, q):
    a, b = models.quantile_fit(prices, "y", ["l_quantity"], q)
    below = prices.agg(F.avg((F.col("y") < float(a) + float(b) * F.col("l_quantity")).cast("int"))).first()[0]
    assert abs(below - q) < 0.005


@pytest.mark.parametrize("link", ["logit", "probit"])
def test_ordered_fit_is_a_maximum(spark, link):
    rng = np.random.default_rng(2)
    x = rng.normal(size=3000)
    noise = rng.logistic(size=3000) if link == "logit" else rng.normal(size=3000)
    y = np.digitize(1.2 * x + noise, [-0.5, 1.0])
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, x, strict=True)], "y int, x double")
    cuts, slopes, _ = models.ordered_fit(df, "y", ["x"], 3, link)
    assert np.allclose([*cuts, *slopes], [-0.5, 1.0, 1.2], atol=0.15)


@pytest.mark.parametrize(("family", "power"), [("inverse_gaussian", 3.0), ("tweedie", 1.5)])
def test_glm_scores_are_zero(spark, small, family, power):
    df = table(spark, small, "events").groupBy("user_id").agg(F.count("*").alias("y"), F.avg("value").alias("x"))
    a, b = glm.fit(df, "y", ["x"], family).beta
    mu = F.exp(F.lit(float(a)) + float(b) * F.col("x"))
    u = (F.col("y") - mu) * mu / F.pow(mu, F.lit(power))
    assert np.allclose(df.agg(F.avg(u), F.avg(u * F.col("x"))).first(), 0, atol=1e-6)


def test_graphical_lasso_conditions():
    rng = np.random.default_rng(3)
    s = np.cov(rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)), rowvar=False)
    w, p = models.graphical_lasso(s, 0.2)
    off = ~np.eye(5, dtype=bool)
    assert np.allclose(np.diag(w), np.diag(s)) and np.all(np.abs(w - s)[off] <= 0.2 + 1e-6)
    live = off & (np.abs(p) > 1e-6)
    assert np.allclose((w - s)[live], 0.2 * np.sign(p[live]), atol=1e-5)


def test_spline_matches_numpy(spark):
    x = np.linspace(0.05, 9.95, 200)
    y = np.sin(x)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    basis = [multivariate.bspline(F.col("x"), [float(k) for k in range(-3, 14)], 3, i) for i in range(13)]
    beta, lam, size = models.penalized_spline(df, "y", basis, [1e-3, 1.0, 1e3])
    b = np.array(df.select(*basis).collect())
    d = np.diff(np.eye(13), n=2, axis=0)
    assert lam == 1e-3 and 3 < size < 13
    assert np.allclose(beta, np.linalg.solve(b.T @ b + 1e-3 * d.T @ d, b.T @ y), atol=1e-6)


def test_mixture_finds_two_groups(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(float(v),) for v in np.concatenate([rng.normal(0, 1, 600), rng.normal(8, 2, 400)])], "v double")
    got = models.mixture_fit(df, "v", [0.5, 0.5], [-1.0, 5.0], [4.0, 4.0], tol=1e-8).orderBy("label").collect()
    assert abs(got[0].weight - 0.6) < 0.02 and abs(got[0]["mean"]) < 0.15 and abs(got[1]["mean"] - 8) < 0.3


def test_factor_steps_lower_the_error(prices):
    cols = ["l_quantity", "l_discount", "l_tax"]
    x = np.array(prices.select(*cols).collect(), dtype=float)
    h = np.array([[1.0, 0.5, 0.2], [0.3, 1.0, 0.6]])
    w, new = models.factor_step(prices, cols, h)
    got = np.array([r[0] for r in prices.select(w).collect()])
    assert ((x - got @ new) ** 2).sum() < ((x - np.ones((len(x), 2)) @ h) ** 2).sum()


def test_score_residuals_sum_to_the_gradient(spark, small):
    df = spells(spark, small)
    total = survival.score_residuals(df, 0.1).agg(F.sum("residual")).first()[0]
    assert abs(total - survival.cox_breslow(df, 0.1).first().gradient) < 1e-6


def test_efron_without_ties_is_breslow(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(i + 1), int(e), float(v)) for i, (e, v) in enumerate(zip(rng.integers(0, 2, 80), rng.normal(size=80), strict=True))], "time double, event int, x double")
    assert np.allclose(survival.cox_efron(df, 0.3).first(), survival.cox_breslow(df, 0.3).first())


def test_unequal_cells_use_all_orders(spark, small):
    rows = table(spark, small, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice").collect()
    y = np.array([r.o_totalprice for r in rows], float)

    def contrasts(names):
        levels = sorted(set(names))
        return np.array([[(v == k) - (v == levels[-1]) for k in levels[:-1]] for v in names], float)

    a, b = contrasts([r.o_orderstatus for r in rows]), contrasts([r.o_orderpriority for r in rows])
    parts = {"a": a, "b": b, "ab": (a[:, :, None] * b[:, None, :]).reshape(len(y), -1)}

    def error(without=None):
        x = np.hstack([np.ones((len(y), 1)), *[v for k, v in parts.items() if k != without]])
        return float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum())

    mse = error() / (len(y) - sum(v.shape[1] for v in parts.values()) - 1)
    got = {r.term: r for r in QUERIES["anova_twoway_unequal"](spark, small).collect()}
    for k, v in parts.items():
        ss = error(k) - error()
        assert got[k].df == v.shape[1] and math.isclose(got[k].ss, ss, rel_tol=1e-5) and math.isclose(got[k].f, ss / v.shape[1] / mse, rel_tol=1e-5)
