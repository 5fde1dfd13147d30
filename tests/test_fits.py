"""Fitted models satisfy their optimality conditions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom import streaming
from statloom.operators import glm, linear, survival
from statloom.sources import scores, spells, table


@pytest.mark.parametrize("penalty", ["lasso", "elastic_net"])
def test_coordinate_descent_meets_its_conditions(penalty):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    y = x @ [1, 0, -2, 0, 0.1] + rng.normal(size=200)
    g = np.corrcoef(np.column_stack([x, y]).T)
    mix = 0.5 if penalty == "elastic_net" else 1.0
    b = linear.coordinate_descent(g, penalty, 0.1, mix)
    grad = g[:5, 5] - g[:5, :5] @ b - 0.1 * (1 - mix) * b
    assert np.all(np.abs(grad[b == 0]) <= 0.1 * mix + 1e-9)
    assert np.allclose(grad[b != 0], 0.1 * mix * np.sign(b[b != 0]))


def test_logistic_gradient_is_zero(spark, small):
    df = scores(spark, small).withColumn("x", F.col("score") / 1000)
    a, b = glm.fit(df, "y", ["x"], "logistic").beta
    r = F.col("y") - 1 / (1 + F.exp(-(F.lit(float(a)) + F.col("x") * float(b))))
    assert np.allclose(df.agg(F.sum(r), F.sum(r * F.col("x"))).first(), 0, atol=1e-6)


def test_cox_gradient_is_zero(spark, small):
    df = spells(spark, small)
    assert abs(survival.cox_breslow(df, survival.cox_fit(df)).first().gradient) < 1e-6


def test_ols_matches_numpy(spark, small):
    df = table(spark, small, "lineitem")
    p = df.select("l_quantity", "l_discount", "l_extendedprice").toPandas().to_numpy()
    want = np.linalg.lstsq(np.column_stack([np.ones(len(p)), p[:, :2]]), p[:, 2], rcond=None)[0]
    assert np.allclose(linear.ols(df, "l_extendedprice", ["l_quantity", "l_discount"]).beta, want, rtol=1e-6)


def test_stream_gives_the_batch_rows(spark, small, tmp_path):
    events = table(spark, small, "events")
    events.write.parquet(str(tmp_path / "in"))
    q = streaming.window_moments(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("moments").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.start, r.event_type, r.n) for r in spark.sql("SELECT * FROM moments").collect()}
    assert got == {(r.start, r.event_type, r.n) for r in streaming.window_moments(events).collect()}
