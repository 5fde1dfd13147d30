"""A series' mean with errors for correlation over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newey_west_mean(series: DataFrame, y: str, order: str, lags: int) -> DataFrame:
    """(mean, se): a series' mean with Bartlett-weighted autocovariances."""
    m = series.agg(F.avg(y).alias("m"))
    w = Window.orderBy(order)
    e = series.crossJoin(F.broadcast(m)).withColumn("e", F.col(y) - F.col("m"))
    e = e.select("m", "e", *[F.lag("e", h).over(w).alias(f"e{h}") for h in range(1, lags + 1)])
    v = F.sum(F.col("e") * F.col("e"))
    for h in range(1, lags + 1):
        v = v + 2 * (1 - h / (lags + 1)) * F.sum(F.col("e") * F.col(f"e{h}"))
    return e.groupBy("m").agg((F.sqrt(v) / F.count("*")).alias("se")).select(F.col("m").alias("mean"), "se")
