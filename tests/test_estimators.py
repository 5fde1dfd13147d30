"""Estimators against plain versions, on small made tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom import estimators, formula, streaming
from statloom.functions import penalties, special
from statloom.functions.losses import get_loss, list_losses, register_loss
from statloom.operators import anova, clustering, cox, cv, decomposition, glm, kernels, linear, panel_models, resampling, robust_covariance, selection, solvers, splines, testing
from statloom.plans import gram, ranks


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    x[:, 1] += 0.5 * x[:, 0]
    y = x @ [2, 0, -1.5, 0, 0, 1, 0, 0] + rng.normal(size=400)
    names = [f"v{i}" for i in range(8)]
    df = spark.createDataFrame([(i, *map(float, r), float(v), int(v > 0), "abc"[i % 3]) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id long, " + ", ".join(f"{n} double" for n in names) + ", y double, b int, g string")
    return df.repartition(3).cache(), x, y, names


def test_block_gram_is_the_plain_one(wide):
    df, x, y, names = wide
    m = np.column_stack([np.ones(400), x, y])
    assert np.allclose(gram(df, [F.lit(1.0), *[F.col(n) for n in names], F.col("y")]), m.T @ m)
    w = np.abs(x[:, 0])
    assert np.allclose(gram(df, [F.lit(1.0), *[F.col(n) for n in names], F.col("y")], F.abs(F.col("v0"))), (m * w[:, None]).T @ m)
    assert not gram(df.limit(0), [F.col(n) for n in names]).any()


def test_ranks_over_many_ranges(wide):
    df, x, _, _ = wide
    got, n, ranges = ranks.ranked(df, "v0", "id", rows=30)
    assert n == 400 and ranges > 5
    assert {r.id: r["rank"] for r in got.select("id", "rank").collect()} == {int(i): k + 1 for k, i in enumerate(np.argsort(x[:, 0]))}
    summed = ranks.running(got, ranges, F.col("v1"), [F.asc("rank")], "sum", "s").orderBy("rank").select("s").collect()
    assert np.allclose([r.s for r in summed], np.cumsum(x[np.argsort(x[:, 0]), 1]))
    least = ranks.running(got, ranges, F.col("v1"), [F.desc("rank")], "min", "s", last_first=True).orderBy("rank").select("s").collect()
    assert np.allclose([r.s for r in least], np.minimum.accumulate(x[np.argsort(x[:, 0]), 1][::-1])[::-1])


def test_adjusting_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RANGE_ROWS", 50)
    rng = np.random.default_rng(2)
    p = np.round(rng.random(300) ** 2, 2)  # with ties
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "id long, p double")
    order = np.argsort(p, kind="stable")
    m, s = len(p), p[order]
    want = {"bonferroni": np.minimum(p * m, 1)[order], "holm": np.maximum.accumulate(s * (m - np.arange(m))), "bh": np.minimum.accumulate((s * m / np.arange(1, m + 1))[::-1])[::-1], "hochberg": np.minimum.accumulate((s * (m - np.arange(m)))[::-1])[::-1]}
    want["by"] = want["bh"] * (1 / np.arange(1, m + 1)).sum()
    for method, w in want.items():
        got = {r.id: r.p_adj for r in testing.adjust(df, "p", method, "id").collect()}
        assert np.allclose([got[int(i)] for i in order], np.minimum(w, 1))


def test_resampled_means_spread_as_theory_says(spark):
    v = np.random.default_rng(3).exponential(size=500)
    df = spark.createDataFrame([(i, float(a), i % 20, int(i % 2)) for i, a in enumerate(v)], "id long, v double, c int, s int")
    means = [r.value for r in resampling.bootstrap_values(df, F.avg("v"), "id", 300).collect()]
    assert abs(np.std(means) / (v.std() / math.sqrt(500)) - 1) < 0.2 and abs(np.mean(means) - v.mean()) < 0.02
    clusters = resampling.resamples(df, "id", 5, "cluster", clusters="c").groupBy("rep").agg(F.count("*").alias("n"), F.count_distinct("c").alias("k")).collect()
    assert all(r.n == 500 and r.k < 20 for r in clusters)
    strata = resampling.resamples(df, "id", 5, "stratified", strata="s").groupBy("rep", "s").count().collect()
    assert all(r["count"] == 250 for r in strata)
    assert resampling.bootstrap_values(df, lambda d: d.v.median(), "id", 4).count() == 4


@pytest.mark.parametrize("strata", [None, "s"])
def test_permutations_keep_values(spark, monkeypatch, strata):
    monkeypatch.setattr(resampling, "SORTED", 40)
    v = np.random.default_rng(4).normal(size=200)
    df = spark.createDataFrame([(i, float(a), int(i % 2), int(i < 60)) for i, a in enumerate(v)], "id long, v double, s int, g int")
    dealt = resampling.shuffled(df, "g", "id", 200, strata)
    sums = dealt.groupBy("rep", *([strata] if strata else [])).agg(F.sum("g").alias("k"), F.count("*").alias("n")).collect()
    assert all(r.k == (30 if strata else 60) and r.n == (100 if strata else 200) for r in sums)
    diffs = [r.d for r in dealt.groupBy("rep").agg(resampling.mean_difference("v", "g").alias("d")).collect()]
    assert abs(np.std(diffs) / (v.std() * math.sqrt(1 / 60 + 1 / 140)) - 1) < 0.2
    p = resampling.permutation_test(df, resampling.mean_difference("v", "g"), "g", "id", 99, strata).first()
    assert 0.01 <= p.p <= 1 and p.reps == 99


def test_studentized_range_tables():
    assert abs(special.studentized_range_quantile(0.95, 3, 10) - 3.877) < 1e-3 and abs(special.studentized_range_quantile(0.99, 4, 5) - 7.804) < 1e-3
    assert abs(special.studentized_range_sf(2 * math.sqrt(2), 2, 12) - special.t_sf_two_sided(2.0, 12)) < 1e-6


def test_two_way_needs_equal_cells(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)], "a string, b string, y double")
    with pytest.raises(ValueError, match="cells"):
        anova.f_twoway(df, "y", "a", "b")


@pytest.mark.parametrize("name", ["l1", "l2", "elasticnet", "scad", "mcp", "group_lasso", "group_scad", "group_mcp"])
def test_penalized_fits_are_stationary(wide, name):
    df, _, _, names = wide
    how = {"groups": [0, 0, 1, 1, 2, 2, 3, 3]} if name.startswith("group") else {}
    for loss in ("squared_error", "logistic"):
        m = glm.fit(df, "y" if loss == "squared_error" else "b", names, loss, name, 0.05, **how)
        assert m.stationarity() < 1e-5


def test_prox_minimizes():
    z, grid = np.linspace(-4, 4, 17), np.linspace(-5, 5, 20001)
    for p in (penalties.L1(0.7), penalties.L2(0.7), penalties.ElasticNet(0.7, 0.3), penalties.Scad(0.7), penalties.Mcp(0.7)):
        value = np.array([p.value(np.array([g])) for g in grid])
        for v, b in zip(z, p.prox(z, 1.0), strict=True):
            f = lambda t, v=v, p=p: 0.5 * (t - v) ** 2 + p.value(np.array([t]))
            assert f(b) <= (0.5 * (grid - v) ** 2 + value).min() + 1e-6


def test_solvers_agree(wide):
    df, _, _, names = wide
    o = solvers.Objective(df, "y", names)
    want = penalties.solve_quadratic(o.whole[:9, :9], o.whole[:9, 9], penalties.L1(0.1))
    for s in ("fista", "fista_bb", "proximal_newton", "admm"):
        assert np.allclose(solvers.SOLVERS[s](o, penalties.L1(0.1)), want, atol=1e-5)
    ridge = penalties.solve_quadratic(o.whole[:9, :9], o.whole[:9, 9], penalties.L2(0.1))
    for s in ("newton", "lbfgs", "irls"):
        assert np.allclose(solvers.SOLVERS[s](o, penalties.L2(0.1)), ridge, atol=1e-5)
    box = solvers.lbfgs(o, penalties.NoPenalty(), lower=[-9] + [0.0] * 8, upper=[9] + [1.0] * 8)
    assert box.min() >= -9 and box[1:].min() >= 0 and box[1:].max() <= 1 and box[1] == 1.0


def test_losses_can_be_registered(wide):
    df, _, _, names = wide

    @register_loss("half_squared")
    class Half(type(get_loss("squared_error"))):
        pass

    assert "half_squared" in list_losses()
    assert np.allclose(glm.fit(df, "y", names, "half_squared").beta, linear.ols(df, "y", names).beta)


def test_lla_path_is_sparse(wide):
    df, _, _, names = wide
    fits = glm.lla_path(df, "y", names, "squared_error", "scad", [0.5, 0.2])
    assert [np.count_nonzero(np.abs(f.beta[1:]) > 1e-8) for f in fits][-1] == 3


def test_inference_after_selection(wide):
    df, _, _, names = wide
    m = glm.fit(df, "y", names, "squared_error", "l1", 0.1)
    rows = {r.term: r for r in glm.debiased(df, "y", names, m).collect()}
    plain = dict(zip(names, linear.ols(df, "y", names).beta[1:], strict=True))
    assert all(rows[n].low < plain[n] < rows[n].high for n in names) and rows["v3"].low < 0 < rows["v3"].high and rows["v2"].p < 1e-6
    again = {r.term: r for r in glm.refit_active(df, "y", names, m).collect()}
    assert again["v0"].estimate is not None and sum(r.estimate is None for r in again.values()) >= 1
    assert 1.9 < glm.simultaneous_band(np.eye(1)) < 2.02 < glm.simultaneous_band(np.eye(5))
    assert "log-likelihood" in glm.summary(df, "y", m)


def test_cross_validation(wide):
    df, x, y, names = wide
    g = cv.fold_grams(df, "y", names, F.col("id") % 4, 4)
    assert np.allclose(g.sum(0)[0, 0], 400)
    best, mean, beta = cv.lasso_cv(df, "y", names, F.col("id") % 4, 4)
    assert np.abs(beta[1:][[0, 2, 5]]).min() > 0.5 and len(mean) == 12
    assert cv.elastic_net_cv(df, "y", names, F.col("id") % 4, 4, (0.2, 0.9), [0.01, 0.1])[0] in (0.2, 0.9)
    assert cv.folds_are_complete(df, F.col("id") % 4, 4) and not cv.folds_are_complete(df, F.col("id") % 5, 4)
    assert cv.data_hash(df) == cv.data_hash(df.repartition(5)) != cv.data_hash(df.limit(399))
    assert cv.run([1.0, 2.0], [0, 1], lambda f, a: 1 / 0 if a == 1.0 and f else a)[0] == 2.0
    with pytest.raises(ValueError, match="weights"):
        cv.check_weights(df, "v0")


@pytest.mark.parametrize("linkage", ["single", "complete", "average", "ward"])
def test_linkages(linkage):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 2))
    groups = [[i] for i in range(40)]

    def far(a, b):
        d = np.sqrt(((x[a][:, None] - x[b][None]) ** 2).sum(2))
        if linkage == "ward":
            return len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        return {"single": d.min(), "complete": d.max(), "average": d.mean()}[linkage]

    while len(groups) > 5:
        _, i, j = min((far(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        groups[i] += groups.pop(j)
    got = clustering.link(x, 5, linkage)
    assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(got == k).tolist()) for k in range(5)}


@pytest.mark.parametrize("d", [1, 2, 4])
def test_dbscan_is_the_plain_one(spark, d):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(c, 0.3, size=(60, d)) for c in (0, 2, 4)] + [rng.uniform(-2, 6, size=(25, d)), np.zeros((30, d))])
    eps, least = 0.35 * math.sqrt(d), 6
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"c{i} double" for i in range(d)))
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(x)), -1)
    while True:
        new = np.array([min(label[near[i] & core]) if core[i] else -1 for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    for i in np.flatnonzero(~core):
        if (near[i] & core).any():
            label[i] = label[np.flatnonzero(near[i] & core)[0]]
    number = {v: k for k, v in enumerate(sorted(set(label[core])))} | {-1: -1}
    got = {r.id: (r.label, r.core) for r in clustering.dbscan(df, [f"c{i}" for i in range(d)], "id", eps, least).collect()}
    assert got == {i: (number[label[i]], bool(core[i])) for i in range(len(x))}


def test_mixture_labels(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(0, 1, size=(100, 2)), rng.normal(6, 1, size=(100, 2))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double")
    m = clustering.GaussianMixture(2).fit(df, ["a", "b"], clustering.kmeans_fit(df, ["a", "b"], "id", 2, seed=3))
    got = {r.id: r.label for r in m.predict(df, ["a", "b"], "id").collect()}
    assert len({got[i] for i in range(100)}) == 1 and got[0] != got[150] and abs(m.weights[0] - 0.5) < 0.02


def test_decompositions(wide):
    df, x, _, names = wide
    m = decomposition.PCA(3).fit(df, names)
    assert np.allclose(m.explained, np.linalg.svd(x - x.mean(0))[1][:3] ** 2 / 399)
    s, v = decomposition.randomized_svd(df, names, 3)
    assert np.allclose(s, np.linalg.svd(x)[1][:3], rtol=1e-2)
    t = decomposition.TruncatedSVD(3).fit(df, names)
    assert np.allclose(t.singular, np.linalg.svd(x)[1][:3])
    back = np.array(df.orderBy("id").select(*decomposition.PCA(8).fit(df, names).inverse(decomposition.PCA(8).fit(df, names).transform(names))).collect())
    assert np.allclose(back, x)


def test_nmf(spark):
    rng = np.random.default_rng(8)
    h = rng.random((2, 5))
    x = rng.random((150, 2)) @ h
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{i} double" for i in range(5)))
    m = decomposition.NMF(rng.random((2, 5)), steps=60, tol=0).fit(df, [f"c{i}" for i in range(5)])
    assert m.error < 0.02 * (x**2).sum()
    b = decomposition.NMF(rng.random((2, 5)))
    first = b.partial_fit(df, [f"c{i}" for i in range(5)]).error
    for _ in range(15):
        b.partial_fit(df, [f"c{i}" for i in range(5)])
    assert b.error < first


def test_kernels(wide, spark):
    df, x, y, names = wide
    for name in kernels.KERNELS:
        k = kernels.KERNELS[name](np.abs(x[:20]), np.abs(x[:20]))
        assert k.shape == (20, 20) and np.allclose(k, k.T)
    a, b = np.abs(x[0]), np.abs(x[1])
    assert np.isclose(kernels.KERNELS["chi2"](a[None], b[None])[0, 0], np.exp(-((a - b) ** 2 / (a + b)).sum()))
    exact = kernels.KernelRidge("rbf", 0.5, gamma=0.1).fit(df, "y", names)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    want = np.exp(-0.1 * d) @ np.linalg.solve(np.exp(-0.1 * d) + 0.5 * np.eye(400), y)
    got = {r.id: r.predicted for r in exact.predict(df, names, "id").collect()}
    assert np.allclose([got[i] for i in range(400)], want)
    few = kernels.KernelRidge("rbf", 0.5, marks=400, gamma=0.1).fit(df, "y", names, "id")
    assert np.allclose(few.values(x), want, atol=1e-3)
    m = kernels.Nystroem("rbf", 400, gamma=0.1).fit(df, names, "id")
    f = m.features(x)
    assert np.allclose(f @ f.T, np.exp(-0.1 * d), atol=1e-6)
    p = kernels.KernelPCA("rbf", 2, gamma=0.1).fit(df, names)
    c = np.eye(400) - 1 / 400
    assert np.allclose(p.eigenvalues, np.linalg.eigvalsh(c @ np.exp(-0.1 * d) @ c)[::-1][:2])
    assert kernels.kernel_ridge_cv(df, "y", names, F.col("id") % 3, 3, [0.01, 1.0, 1000.0], marks=60)[0] != 1000.0
    v = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x[:50])], "id long, v array<double>")
    got = {(r.a, r.b): r.value for r in kernels.pairwise(v, v.where("id % 10 = 0"), "id", "v", block=2).collect()}
    assert len(got) == 250 and np.isclose(got[7, 20], np.exp(-d[7, 20] / 8))


def test_density_in_two_dimensions(wide):
    df, x, _, _ = wide
    pts = np.array([[0.0, 0.0], [1.0, -1.0]])
    cov, h = np.cov(x[:, :2].T), 400 ** (-1 / 6)
    inv, z = np.linalg.inv(cov * h * h), pts[:, None] - x[None, :, :2]
    want = np.exp(-0.5 * np.einsum("pni,ij,pnj->pn", z, inv, z)).mean(1) / (2 * np.pi * math.sqrt(np.linalg.det(cov * h * h)))
    assert np.allclose(kernels.kde_multivariate(df, ["v0", "v1"], pts), want, rtol=1e-6)
    low, high = kernels.kde_interval(0.2, 400, 0.3)
    assert 0 < low < 0.2 < high


def test_spline_bases(spark):
    x = np.linspace(0, 10, 101)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    knots = [2.5, 5.0, 7.5]
    value = lambda columns: np.array(df.orderBy("x").select(*columns).collect())
    b = value(splines.basis(F.col("x"), splines.clamped(knots, 0, 10)))
    assert np.allclose(b.sum(1), 1) and np.allclose(b, splines.basis_values(x, splines.clamped(knots, 0, 10)))
    n = value(splines.natural(F.col("x"), knots, 0, 10))
    assert n.shape[1] == b.shape[1] - 2 and np.abs(np.diff(n, 2, axis=0)[[0, -1]] / 0.01).max() < 0.15 * np.abs(np.diff(b, 2, axis=0) / 0.01).max()
    c = value(splines.cyclic(F.col("x"), knots, 0, 10))
    assert c.shape[1] == b.shape[1] - 3 and np.allclose(c[0], c[-1])
    t = value(splines.thin_plate([F.col("x")], np.array(knots)))
    assert np.allclose(t[:, 0], np.abs(x - 2.5) ** 3) and t.shape[1] == 5
    tr = splines.SplineTransformer(4, beyond="linear").fit(df, "x")
    out = np.array(spark.createDataFrame([(11.0,), (12.0,), (13.0,)], "x double").select(*tr.transform(F.col("x"))).collect())
    assert np.allclose(out[2] - out[1], out[1] - out[0]) and np.allclose(out.sum(1), 1)


def test_gam_follows_two_curves(spark):
    rng = np.random.default_rng(9)
    x = rng.uniform(-3, 3, size=(600, 2))
    y = np.sin(x[:, 0]) + x[:, 1] ** 2 + 0.1 * rng.normal(size=600)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, y double")
    m = splines.GAM(12).fit(df, "y", ["a", "b"])
    got = df.agg(F.avg((m.predict() - F.col("y")) ** 2)).first()[0]
    assert got < 0.03 and 5 < m.size < 24 and np.isclose(got, m.rss / 600, rtol=1e-5)


def test_steps_choose_the_right_columns(wide):
    df, x, y, names = wide
    got, best = selection.stepwise(df, "y", names, "bic")
    assert set(got) >= {"v0", "v2", "v5"} and len(got) <= 4
    m = np.column_stack([np.ones(400), x[:, [names.index(n) for n in got]]])
    rss = ((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum()
    assert np.isclose(best, 400 * (math.log(2 * math.pi * rss / 400) + 1) + math.log(400) * m.shape[1])
    assert len(selection.stepwise(df, "y", names, "aic", "backward", 2)[0]) == 2
    assert selection.stepwise(df, "y", names[:2], score=lambda c: -len(c))[0] == names[:2]


@pytest.mark.parametrize("make", [selection.model_x_knockoffs, selection.fixed_x_knockoffs])
@pytest.mark.parametrize("method", ["corr_diff", "ols_coef_diff", "lasso_coef_diff"])
def test_knockoffs_tell_signals(spark, make, method):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(600, 12))
    y = x[:, :6] @ np.full(6, 1.0) + rng.normal(size=600)
    names = [f"v{i}" for i in range(12)]
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id long, " + ", ".join(f"{n} double" for n in names) + ", y double")
    got = make(df, "y", names, "id", 0.25, method)
    assert set(names[:6]) <= set(got.selected) and len(got.selected) <= 8


def test_knockoff_copies_have_the_right_products(wide):
    df, x, _, names = wide
    c = selection.Copies(df, names)
    z = (x - x.mean(0)) / x.std(0)
    k = c.of(z, c.draws(np.arange(400), 0))
    assert np.allclose(c.gram(df, "id", "y", 0)[1:9, 9:17], z.T @ k)
    sigma = np.corrcoef(x.T)
    s = selection.equal_s(sigma)
    assert np.abs(np.cov(k.T) - sigma).max() < 0.25 and np.abs((z - z.mean(0)).T @ (k - k.mean(0)) / 400 - (sigma - np.diag(s))).max() < 0.25
    assert selection.threshold(np.array([5.0, 4, 3, -1, 2]), 0.34, 1) == 2.0 and selection.threshold(np.array([-1.0]), 0.1) == math.inf


def test_outliers_do_not_move_the_covariance(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(500, 2)) @ np.array([[1, 0.5], [0, 1]])
    x[:80] += 20
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double")
    m = robust_covariance.MinCovDet(starts=6).fit(df, ["a", "b"], "id")
    assert np.abs(m.mean).max() < 0.3 and np.abs(m.covariance - np.cov(x[80:].T)).max() < 0.35 and m.used < 430
    inside = robust_covariance.score(df.where("id >= 80"), ["a", "b"], m.mean, m.covariance)
    assert inside > robust_covariance.score(df, ["a", "b"], m.mean, m.covariance)
    best, scores, cov, precision = robust_covariance.graphical_lasso_cv(df.where("id >= 80"), ["a", "b"], F.col("id") % 3, 3)
    assert len(scores) == 4 and np.allclose(cov @ precision, np.eye(2))


def test_concordance_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(cox, "PAIR_ROWS", 60)
    rng = np.random.default_rng(12)
    t, e, r = rng.integers(1, 200, 700).astype(float), rng.integers(0, 2, 700), np.round(rng.normal(size=700), 1)
    t[600:] = 50.0
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(t, e, r, strict=True)], "time double, event int, r double")
    ok = (e[:, None] == 1) & ((t[:, None] < t[None]) | ((t[:, None] == t[None]) & (e[None] == 0)))
    got = cox.concordance(df, "time", "event", F.col("r")).first()
    assert (got.concordant, got.tied, got.permissible) == ((ok & (r[:, None] > r[None])).sum(), (ok & (r[:, None] == r[None])).sum(), ok.sum())
    assert cox.concordance(df.where("event = 0"), "time", "event", F.col("r")).first().c is None


def test_cox_sandwich_and_paths(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(300, 2))
    t, e = rng.exponential(np.exp(-x @ [0.7, 0.0])), rng.integers(0, 4, 300) > 0
    df = spark.createDataFrame([(i, float(a), int(b), *map(float, v)) for i, (a, b, v) in enumerate(zip(t, e, x, strict=True))], "id long, time double, event int, a double, b double")
    m = cox.fit(df, "time", "event", ["a", "b"])
    u = np.array(cox.score_residuals(df, "time", "event", ["a", "b"], m.beta).collect())
    assert np.abs(u.sum(0)).max() < 1e-6
    rows = {k: cox.inference(df, "time", "event", ["a", "b"], m, k, "id").collect()[0] for k in ("nonrobust", "hc0", "cluster")}
    assert np.isclose(rows["hc0"].std_err, rows["cluster"].std_err) and 0.7 < rows["hc0"].std_err / rows["nonrobust"].std_err < 1.4
    assert all(p < 1e-4 for _, p in m.tests().values()) and "events" in cox.summary(df, "time", "event", ["a", "b"], m)
    scores = {r.penalty: r.score for r in cox.cross_validated(df, "time", "event", ["a", "b"], F.col("id") % 3, [0.0, 1e5]).collect()}
    assert scores[0.0] > scores[1e5] and len(cox.penalty_grid(df, "event", ["a", "b"])) == 10


def test_formulas(wide):
    df, x, y, _ = wide
    d = formula.parse("y ~ v0 + C(g) + v1:v2 + np.log(abs(v3) + 1)", df)
    rows, names, columns = d.frame(df)
    assert names == ["v0", "C(g)[T.b]", "C(g)[T.c]", "np.log(abs(v3)+1)", "v1:v2"] and d.intercept
    assert [n for n, _ in formula.parse("y ~ v0*v1 - 1", df).columns()] == ["v0", "v1", "v0:v1"] and not formula.parse("y ~ v0 - 1", df).intercept
    assert [n for n, _ in formula.parse("y ~ 0 + g", df).columns()] == ["g[a]", "g[b]", "g[c]"]
    assert [n for n, _ in formula.parse("y ~ v0*g - v0:g", df).columns()] == ["v0", "g[T.b]", "g[T.c]"]
    s = formula.parse("Surv(v0, b) ~ I(v1**2)", df)
    assert s.response == ["v0", "b"] and np.isclose(s.frame(df)[0].agg(F.sum("x0")).first()[0], (x[:, 1] ** 2).sum())
    assert formula.parse("y ~ v0 | id + g", df).effects == ["id", "g"]
    for bad in ("y v0", "y ~ v0 +", "y ~ system(v0)", "y ~ (v0"):
        with pytest.raises((formula.FormulaError, SyntaxError)):
            formula.parse(bad, df)


def test_estimators_by_name(wide):
    df, x, y, names = wide
    m = estimators.LinearRegression().fit(df, formula="y ~ v0 + v2 + C(g)")
    assert m.score(df, "y") > 0.6 and len(m.coef_) == 4 and "C(g)[T.b]" in m.summary()
    assert m.predict(df).where("predicted IS NULL").count() == 0
    c = m.clone()
    assert c.get_params() == m.get_params() and not hasattr(c, "coef_")
    with pytest.raises(estimators.NotFitted):
        c.summary()
    with pytest.raises(ValueError, match="no parameter"):
        c.set_params(what=1)
    log = estimators.LogisticRegression(C=10.0).fit(df, "b", names)
    assert log.score(df, "b") > 0.8 and log.areas(df, "b").first().auc > 0.9 and log.confusion(df, "b").first().tp > 100
    ad = estimators.AdaptiveLasso(0.1).fit(df, "y", names)
    assert {0, 2, 5} <= set(np.flatnonzero(np.abs(ad.coef_) > 1e-8)) and ad.fit_.stationarity() < 1e-6 and ad.fit_.penalty.weight[0] < ad.fit_.penalty.weight[3]
    assert estimators.QuantileRegression(0.5).fit(df, "y", names[:3]).predict(df).count() == 400
    assert estimators.RobustRegression("bisquare").fit(df, "y", names).score(df, "y") > 0.8
    assert m.adjust_pvalues(None).count() == 5
    panel = estimators.PanelOLS().fit(df, "y ~ v0 + v2 | g")
    assert panel.table_.count() == 2 and abs(panel.coef_[0] - 2) < 0.3
    surv = estimators.CoxPH().fit(df.withColumn("t", F.exp(F.col("v3") - F.col("v0"))), formula="Surv(t, 1) ~ v0 + v1")
    assert surv.coef_[0] > 0.5 and surv.predict(df).where("hazard_ratio IS NULL").count() == 0


def test_labels_and_streams(wide, spark, tmp_path):
    df, x, _, names = wide
    got, n = panel_models.factorize(df, "g", "code")
    assert n == 3 and {(r.g, r.code) for r in got.select("g", "code").distinct().collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert panel_models.dummies(df, "g", False)[1] == ["g_b", "g_c"]
    df.write.parquet(str(tmp_path / "in"))
    m = decomposition.PCA(2)
    q = streaming.fit_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), lambda b: m.partial_fit(b, names), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert np.allclose(m.explained, decomposition.PCA(2).fit(df, names).explained)
