"""Bootstrap and permutation tests whose draws are a function of row number and repetition, so that reruns and SQL agree.

Rows are numbered by their id without a task that sees them all (plans.ranks). A resample is a list of row numbers, which is
joined with the rows by number; the statistic is an aggregate by repetition, combined in each task first. Permutations sort
rows by a hash within each repetition and stratum, in ranges of the hash.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..plans.ranks import ranked

PRIME = 2147483647
#: Rows of a repetition that one task sorts, about.
SORTED = 1_000_000
#: Rows that follow each other and are packed into one.
PACKED = 8192


def mixed(i: Column, rep: Column) -> Column:
    """A whole number under 2^62 that looks random in i and rep: squares modulo a prime, which any SQL dialect can repeat."""
    i, rep = i.cast("long"), rep.cast("long")
    a = (i * 7919 + rep * 104729 + 12345) % PRIME
    b = (a * a + 48271 * rep + i) % PRIME
    c = (b * b + 16807 * a + 1) % PRIME
    d = (c * c + b) % PRIME
    return d * PRIME + (d * d + c) % PRIME


def mixed_values(i: np.ndarray, rep: int) -> np.ndarray:
    """The same of numbers."""
    i = i.astype(np.int64)
    a = (i * 7919 + rep * 104729 + 12345) % PRIME
    b = (a * a + 48271 * rep + i) % PRIME
    c = (b * b + 16807 * a + 1) % PRIME
    d = (c * c + b) % PRIME
    return d * PRIME + (d * d + c) % PRIME


def mixed_sql(i: str, rep: str) -> str:
    """The same in SQL."""
    p = PRIME
    a = f"(({i})::BIGINT*7919+({rep})::BIGINT*104729+12345)%{p}"
    b = f"(({a})*({a})+48271*({rep})+({i}))%{p}"
    c = f"(({b})*({b})+16807*({a})+1)%{p}"
    d = f"(({c})*({c})+({b}))%{p}"
    return f"(({d})*{p}+(({d})*({d})+({c}))%{p})"


def _reps(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _numbered(df: DataFrame, id_col: str, strata: str | None) -> DataFrame:
    """df with __i, from 0, and, for strata, the numbers' first and how many: rows of a stratum follow each other."""
    if strata is None:
        out, n, _ = ranked(df, id_col, rank="__i")
        return out.drop("__range").withColumn("__i", F.col("__i") - 1).withColumn("__first", F.lit(0).cast("long")).withColumn("__n", F.lit(n).cast("long"))
    of = Window.partitionBy(strata)
    sizes = df.groupBy(strata).agg(F.count("*").alias("__n"))
    first = F.coalesce(F.sum("__n").over(Window.orderBy(strata).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each stratum
    sizes = sizes.select(F.col(strata).alias("__s"), "__n", first.alias("__first"))
    out = df.withColumn("__k", F.row_number().over(of.orderBy(id_col)).cast("long") - 1).join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, F.col(strata).eqNullSafe(F.col("__s")))
    return out.withColumn("__i", F.col("__first") + F.col("__k")).drop("__s", "__k")


def resamples(df: DataFrame, id_col: str, reps: int, strategy: str = "iid", strata: str | None = None, clusters: str | None = None, block_size: int | None = None) -> DataFrame:
    """df's rows by `rep`, as often as drawn: as many rows in each repetition as df has.

    iid: rows with replacement. stratified: within each stratum. cluster: whole clusters with replacement until there are
    enough rows, of which the last are cut. block: stretches of block_size rows that follow each other by id.
    """
    if strategy in ("iid", "stratified"):
        rows = _numbered(df, id_col, strata if strategy == "stratified" else None)
        drawn = rows.select("__i", "__first", "__n", _reps(reps).alias("rep")).select("rep", (F.col("__first") + mixed(F.col("__i"), F.col("rep")) % F.col("__n")).alias("__d"))
    elif strategy == "block":
        rows, n = _numbered(df, id_col, None), df.count()
        size = min(block_size or 1, n)
        at = F.col("__i")
        start = mixed(F.floor(at / size), F.col("rep")) % F.lit(n - size + 1)
        drawn = rows.select("__i", _reps(reps).alias("rep")).select("rep", (start + at % size).alias("__d"))
    elif strategy == "cluster":
        return _cluster_resamples(df, id_col, reps, clusters)
    else:
        raise ValueError(strategy)
    drawn = drawn.groupBy("rep", "__d").agg(F.count("*").alias("__times"))
    out = drawn.join(rows.drop("__first", "__n"), F.col("__d") == F.col("__i"))
    return out.withColumn("__t", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select("rep", *[F.col(f"`{c}`") for c in df.columns])


def _cluster_resamples(df: DataFrame, id_col: str, reps: int, clusters: str) -> DataFrame:
    sizes = df.groupBy(clusters).agg(F.count("*").alias("__n")).where(F.col(clusters).isNotNull())
    table, groups, _ = ranked(sizes.withColumn("__h", F.hash(clusters)), "__h", clusters, rank="__g")
    table = table.select(F.col("__g") - 1, F.col(clusters).alias("__c"), "__n").toDF("__g", "__c", "__n")
    n, draws = sizes.agg(F.sum("__n")).first()[0] or 0, 2 * groups + 16
    while True:  # draws of clusters, doubled until each repetition has its rows
        picks = df.sparkSession.range(draws).select(F.col("id").alias("__o"), _reps(reps).alias("rep")).withColumn("__d", mixed(F.col("__o"), F.col("rep")) % F.lit(groups))
        before = F.coalesce(F.sum("__n").over(Window.partitionBy("rep").orderBy("__o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        picks = picks.join(table, F.col("__d") == F.col("__g")).withColumn("__before", before)
        if picks.groupBy("rep").agg(F.sum("__n").alias("t")).where(F.col("t") < n).isEmpty():
            break
        draws *= 2
    picks = picks.where(F.col("__before") < n).select("rep", "__c", "__before")
    rows = df.withColumn("__k", F.row_number().over(Window.partitionBy(clusters).orderBy(id_col)))
    out = picks.join(rows, F.col("__c") == F.col(clusters)).where(F.col("__before") + F.col("__k") <= n)
    return out.select("rep", *[F.col(f"`{c}`") for c in df.columns])


def bootstrap_values(df: DataFrame, statistic: Column | Callable[[pd.DataFrame], float], id_col: str, reps: int = 200, **how) -> DataFrame:
    """(rep, value) of resamples. statistic: an aggregate, or a function of a resample's pandas frame, each of which one
    task then holds."""
    drawn = resamples(df, id_col, reps, **how)
    if isinstance(statistic, Column):
        return drawn.groupBy("rep").agg(statistic.cast("double").alias("value"))
    return drawn.groupBy("rep").applyInPandas(lambda key, rows: pd.DataFrame({"rep": [key[0]], "value": [float(statistic(rows))]}), "rep long, value double")


def bootstrap(df: DataFrame, statistic: Column, id_col: str, reps: int = 200, level: float = 0.95, **how) -> DataFrame:
    """(estimate, mean, std_err, low, high, reps), one row: the statistic, and percentiles of its resampled values."""
    values = bootstrap_values(df, statistic, id_col, reps, **how)
    tail = (1 - level) / 2
    got = values.agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std_err"), F.percentile("value", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"), F.count("*").alias("reps"))
    return df.agg(statistic.cast("double").alias("estimate")).crossJoin(got).select("estimate", "mean", "std_err", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "reps")


def shuffled(df: DataFrame, value: str, id_col: str, reps: int, strata: str | None = None) -> DataFrame:
    """df by `rep`, with `value` dealt anew among its rows (within strata): each value comes as often as before."""
    if strata is None:
        return _shuffled_whole(df, value, id_col, reps)
    rows = _numbered(df, id_col, strata)
    dealt = rows.select("__i", "__first", F.col(value).alias("__v"), F.col(strata).alias("__s"), _reps(reps).alias("rep")).withColumn("__h", mixed(F.col("__i"), F.col("rep")))
    place = F.row_number().over(Window.partitionBy("rep", "__s").orderBy("__h", "__i"))
    dealt = dealt.select("rep", (F.col("__first") + place - 1).alias("__to"), "__v")
    kept = rows.drop("__first", "__n", value)
    out = dealt.join(kept, F.col("__to") == F.col("__i"))
    return out.select("rep", *[F.col("__v").alias(c) if c == value else F.col(f"`{c}`") for c in df.columns])


def _shuffled_whole(df: DataFrame, value: str, id_col: str, reps: int) -> DataFrame:
    """The same without strata. Each task deals its rows into ranges of the hash, by repetition, as packed lists; a range is sorted
    at once, of about SORTED rows, so no task sorts all rows of a repetition. Its values go to places that follow each other, and
    meet the rows there in blocks. Spark's sizes of what is dealt and packed are those of the source, far too small, so the joins
    say themselves which side is broadcast: the counts of ranges, and never rows."""
    rows = _numbered(df, id_col, None)
    ranges = max(1, -(-df.count() // SORTED))
    many = ArrayType(df.schema[value].dataType)
    of = lambda h: h / float(PRIME) / float(PRIME) * ranges

    def deal(batches):
        for b in batches:
            i, v = b.column(0).to_numpy(), b.column(1)
            for rep in range(reps if len(i) else 0):
                r = np.minimum(of(mixed_values(i, rep).astype(float)).astype(int), ranges - 1)
                order, cuts = np.argsort(r, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(r, minlength=ranges))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), x.take(pa.array(order))) for x in (b.column(0), v)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(ranges, rep)), pa.array(np.arange(ranges)), *lists], ["rep", "__r", "__is", "__vs"])

    dealt = rows.select("__i", F.col(value).alias("__v")).mapInArrow(deal, StructType([StructField("rep", LongType()), StructField("__r", LongType()), StructField("__is", ArrayType(LongType())), StructField("__vs", many)]))
    if ranges > 1:
        count = rows.select("__i", _reps(reps).alias("rep")).select("rep", F.least(of(mixed(F.col("__i"), F.col("rep"))).cast("long"), F.lit(ranges - 1)).alias("__r")).groupBy("rep", "__r").agg(F.count("*").alias("__c"))
        before = F.coalesce(F.sum("__c").over(Window.partitionBy("rep").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        dealt = dealt.join(F.broadcast(count.withColumn("__before", before).drop("__c")), ["rep", "__r"])
    else:
        dealt = dealt.withColumn("__before", F.lit(0).cast("long"))

    def sort(t: pa.Table) -> pa.Table:
        rep, first = t["rep"][0].as_py(), t["__before"][0].as_py()
        i, v = t["__is"].combine_chunks().flatten().to_numpy(), t["__vs"].combine_chunks().flatten()
        v = v.take(pa.array(np.lexsort((i, mixed_values(i, rep)))))
        places = first + np.arange(len(v))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(places // PACKED)) + 1, [len(v)]]).astype(np.int32)
        at = places[cuts[:-1]]
        return pa.Table.from_arrays([pa.array(np.full(len(at), rep)), pa.array(at // PACKED), pa.array(at % PACKED), pa.ListArray.from_arrays(pa.array(cuts), v)], ["rep", "__b", "__at", "__vs"])

    kind = StructType([StructField("rep", LongType()), StructField("__b", LongType()), StructField("__at", LongType()), StructField("__vs", many)])
    placed = dealt.where(F.size("__is") > 0).groupBy("rep", "__r").applyInArrow(sort, kind)
    rest = [c for c in df.columns if c != value]
    block = F.floor(F.col("__i") / PACKED).alias("__b")
    packed = rows.select(block, F.struct("__i", *[F.col(f"`{c}`") for c in rest]).alias("__x")).groupBy("__b").agg(F.sort_array(F.collect_list("__x")).alias("__xs"))
    both = placed.join(packed.hint("merge"), "__b").select("rep", F.explode(F.arrays_zip(F.slice("__xs", (F.col("__at") + 1).cast("int"), F.size("__vs")).alias("x"), F.col("__vs").alias("v"))).alias("__z"))
    return both.select("rep", *[F.col("__z.v").alias(c) if c == value else F.col(f"__z.x.`{c}`").alias(c) for c in df.columns])


def permutation_test(df: DataFrame, statistic: Column, value: str, id_col: str, reps: int = 1000, strata: str | None = None, alternative: str = "two-sided") -> DataFrame:
    """(statistic, p, reps), one row. p is (extreme + 1) / (reps + 1), where values as large as the observed are extreme."""
    seen = df.agg(statistic.cast("double")).first()[0]
    values = shuffled(df, value, id_col, reps, strata).groupBy("rep").agg(statistic.cast("double").alias("value"))
    extreme = {"two-sided": F.abs("value") >= abs(seen), "greater": F.col("value") >= seen, "less": F.col("value") <= seen}[alternative]
    return values.agg(F.lit(seen).alias("statistic"), ((F.count_if(extreme) + 1) / (F.count("*") + 1)).alias("p"), F.count("*").alias("reps"))


def mean_difference(y: str, group: str) -> Column:
    """Difference of the means of y between groups 1 and 0."""
    return F.avg(F.when(F.col(group) == 1, F.col(y))) - F.avg(F.when(F.col(group) == 0, F.col(y)))


def folds(df: DataFrame, id_col: str, k: int, seed: int = 1) -> DataFrame:
    """(id, fold): k folds of rows that follow each other in an order drawn by hash; the first folds are one larger."""
    drawn = df.select(F.col(id_col).alias("id"), mixed(F.col(id_col), F.lit(seed)).alias("__h"))
    rows, n, _ = ranked(drawn, "__h", "id", rank="__r")
    small, large = n // k, n % k
    at = F.col("__r") - 1
    of = F.when(at < large * (small + 1), F.floor(at / (small + 1))).otherwise(large + F.floor((at - large * (small + 1)) / max(small, 1)))
    return rows.select("id", of.cast("int").alias("fold"))


def weighted_mean_squared_errors(df: DataFrame, y: Column, predictions: Sequence[Column], weight: Column | None = None) -> DataFrame:
    """(model, mse) of many predictions of y, in one aggregate."""
    w = F.lit(1.0) if weight is None else weight
    cells = [F.struct(F.lit(i).alias("model"), (F.sum(w * (y - p) * (y - p)) / F.sum(w)).alias("mse")) for i, p in enumerate(predictions)]
    return df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("a")).select("a.*")
