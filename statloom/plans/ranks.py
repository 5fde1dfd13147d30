"""Ranks and running values over a whole table without a task that sees it all.

Rows are dealt into ranges of one numeric key, by quantiles found in one pass. Windows run within each range, and what the
ranges before or after add is a short list, known on the driver: one number for each range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, about, and the most ranges.
RANGE_ROWS, MOST = 1_000_000, 10_000
#: Accuracy of the quantiles that part the ranges: their rows may be off by rows / this.
ACCURACY = 100_000


def _listed(values: Sequence[float | int], at: Column, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), at + 1)


def ranged(df: DataFrame, key: str, name: str = "__range", rows: int | None = None) -> tuple[DataFrame, int]:
    """df with the number of the row's range of `key` (nulls in the first), and how many ranges there are.

    Rows with equal keys share a range. A small table is one range. The result is read several times by what follows.
    """
    n = df.count()
    ranges = max(1, min(MOST, -(-n // (rows or RANGE_ROWS))))
    if ranges == 1:
        return df.withColumn(name, F.lit(0)), 1
    cuts = df.agg(F.percentile_approx(F.col(key).cast("double"), [i / ranges for i in range(1, ranges)], ACCURACY).alias("c")).first().c
    cuts = sorted(set(cuts))
    above = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(key).cast("double")))
    return df.withColumn(name, F.coalesce(above, F.lit(0))), len(cuts) + 1


def ranked(df: DataFrame, key: str, *ties: str, rank: str = "rank", rows: int | None = None) -> tuple[DataFrame, int, int]:
    """df with `rank` (from 1, by key, then ties) and `__range`; the number of rows, and of ranges."""
    dealt, ranges = ranged(df, key, rows=rows)
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(key, *ties))
    if ranges == 1:
        return dealt.withColumn(rank, inside.cast("long")), df.count(), 1
    count = {r["__range"]: r["count"] for r in dealt.groupBy("__range").count().collect()}  # a row for each range
    before, total = [], 0
    for i in range(ranges):
        before.append(total)
        total += count.get(i, 0)
    return dealt.withColumn(rank, inside.cast("long") + _listed(before, F.col("__range"), "long")), total, ranges


def running(df: DataFrame, ranges: int, value: Column, order: Sequence[Column], how: str, name: str, last_first: bool = False) -> DataFrame:
    """df, which has `__range`, with the running sum, min or max of a value up to each row.

    last_first: order runs backwards, so that later ranges come first.
    """
    f = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    out = df.withColumn(name, value)
    inside = f(name).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    if ranges == 1:
        return out.withColumn(name, inside)
    of = {r["__range"]: r.v for r in out.groupBy("__range").agg(f(name).alias("v")).collect()}  # a row for each range
    none = {"sum": 0.0, "min": float("inf"), "max": float("-inf")}[how]
    join = {"sum": lambda a, b: a + b, "min": min, "max": max}[how]
    rest, so_far = [none] * ranges, none
    for i in reversed(range(ranges)) if last_first else range(ranges):
        rest[i] = so_far
        if of.get(i) is not None:
            so_far = join(so_far, of[i])
    before = _listed([float(x) for x in rest], F.col("__range"), "double")
    both = {"sum": inside + before, "min": F.least(inside, before), "max": F.greatest(inside, before)}[how]
    return out.withColumn(name, both)
