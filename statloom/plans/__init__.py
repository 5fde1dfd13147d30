"""Sufficient statistics: folds over rows that reach the driver as small matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Columns up to which a Gram matrix is summed by expressions; wider rows are summed in blocks by numpy.
NARROW = 6
#: Tasks whose partial matrices one task adds up.
FAN = 32


def gram(df: DataFrame, columns: Sequence[Column], weight: Column | None = None) -> np.ndarray:
    """Sum of w * c c' over rows; rows with a null in any column are left out.

    Few columns are one aggregate of expressions. Of more, each task adds up blocks of rows by one matrix product, and the
    tasks' matrices, of a size that depends on the columns alone, are added in a tree.
    """
    k = len(columns)
    named = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)], (F.lit(1.0) if weight is None else weight.cast("double")).alias("w")).na.drop()
    if k > NARROW:
        return _gram_blocks(named, k)
    sums = [F.sum(F.col("w") * F.col(f"c{i}") * F.col(f"c{j}")).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    row = named.agg(*sums).first()
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = row[f"s{i}_{j}"] or 0.0
    return out


def _gram_blocks(named: DataFrame, k: int) -> np.ndarray:
    return block_sums(named, lambda x: ((x[:k] * x[k]) @ x[:k].T).ravel(), k * k).reshape(k, k)


def block_sums(rows: DataFrame, f: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over blocks of rows of f(block), a vector of a set size. A block has a row for each of the table's columns,
    which are doubles without nulls. Each task adds up its blocks; the tasks' vectors are added in a tree."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += f(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]))
        yield packed(total)

    def packed(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["g"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for g in b.column(0):
                total += np.frombuffer(g.as_py())
        yield packed(total)

    partial, parts = rows.mapInArrow(block, "g binary"), rows.rdd.getNumPartitions()
    while parts > FAN:
        parts = -(-parts // FAN)
        partial = partial.repartition(parts).mapInArrow(add, "g binary")
    return sum((np.frombuffer(r.g) for r in partial.collect()), np.zeros(size))  # at most FAN vectors


def doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles, without rows that have a null."""
    return df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).na.drop()


def linear(terms: Sequence[Column], beta: Sequence[float]) -> Column:
    """The sum of terms times coefficients."""
    out = F.lit(0.0)
    for t, b in zip(terms, beta, strict=True):
        out = out + t * F.lit(float(b))
    return out


def significant(c: Column, digits: int = 8) -> Column:
    """A double rounded to so many digits after the first, as printf('%.{digits}e') has it."""
    return F.when(c.isNotNull() & ~F.isnan(c), F.format_string(f"%.{digits}e", c.cast("double")).cast("double"))


def significant_sql(expr: str, digits: int = 8) -> str:
    return f"CAST(printf('%.{digits}e', CAST({expr} AS DOUBLE)) AS DOUBLE)"
