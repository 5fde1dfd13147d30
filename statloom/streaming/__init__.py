"""Windowed moments of an event stream. The same function serves streams and tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def window_moments(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, mean, variance) by tumbling window; a stream's groups close once its watermark has passed."""
    timed = events.withColumn("t", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("t", late)
    g = timed.groupBy(F.window("t", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "mean", "variance")


def sessions(events: DataFrame, gap_minutes: int = 360) -> DataFrame:
    """(user_id, session, n, seconds): a user's events split where the next is later than the gap."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    apart = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lag("ts").over(w).cast("timestamp"))
    cut = F.when(apart > gap_minutes * 60, 1).otherwise(0)
    s = events.withColumn("c", cut).withColumn("session", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), (F.max(t) - F.min(t)).alias("seconds"))


def fit_stream(stream: DataFrame, step: Callable[[DataFrame], object], checkpoint: str, name: str = "fit") -> StreamingQuery:
    """Give each micro-batch of a stream to a step such as `lambda b: model.partial_fit(b, columns)`.

    The model is the driver's object: after a restart from the checkpoint, batches already given aren't given again, so store the
    model with them if it is to go on.
    """
    return stream.writeStream.foreachBatch(lambda batch, _: step(batch) if not batch.isEmpty() else None).option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True).start()
