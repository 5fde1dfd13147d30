"""Shared plumbing: reading tables, shipping this package to executors, and the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch at most; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1024, 2 << 20

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Give executors this package (once for each application) and bound the Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp()) / f"{root.name}_{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Where that setting is absent and all runs on one machine, as in tests, a temporary folder is set as the checkpoint
    folder; on a cluster without it, an error says so.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext.getCheckpointDir()
        if not known:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp())
            known = spark.sparkContext.getCheckpointDir()
        base = known
    return f"{base.rstrip('/')}/statloom-{uuid.uuid4().hex}"


#: Narrow rows that one file of a saved table takes at most, where a bound of its rows is known.
FILE_ROWS = 50_000


def saved(df: DataFrame, bound: int | None = None, **options: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: cuts lineage and survives lost executors.

    bound: what the number of rows can't exceed; a small table is then written by few tasks instead of one for each
    shuffle partition. Larger bounds leave the partitions as they are.
    """
    path = f"{shared_dir(df.sparkSession)}/table"
    if bound is not None and (files := max(1, -(-bound // FILE_ROWS))) < shuffle_partitions(df.sparkSession):
        df = df.coalesce(files)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, however letters' case is taken."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null ids: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n
