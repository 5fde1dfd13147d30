"""The corpus pipeline: toxic documents go, one of each group of near duplicates stays, personal data are masked, sources
are mixed to their target weights, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows to the shared folder and
gives them to the next. All but the last keep the columns of documents, whatever others are named.

All stages take null and empty texts as texts without words: they are clean, in no group of near duplicates, without personal
data, of size 0 and without ids. A null id or source is kept as it is, and a row with a null id is in no group. Repeated rows
are scored and masked alike; one of them stays as a near duplicate. Texts are taken whole, however long. An empty table gives
an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import bpe_automaton, mixing, near_dups, pii, toxicity
from statloom.llm.common import fold, fresh, prepare, saved, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5. The scorer learns from labelled documents outside the held-out fold.

    With no labels, nothing is known to be toxic and all documents stay.
    """
    prepare(spark)
    learn = fold("doc_id", 5) != 0
    scorer = toxicity.train(docs.where(learn), table(spark, sf_dir, "labels").where(learn), model_docs=docs)
    return docs.where(toxicity.score(F.col("text"), scorer) < 0.5)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group.

    Different texts that share an id are documents of their own, named by a hash of id and text instead; of equal ones, one
    stays. Rows without an id stay.
    """
    prepare(spark)
    shared = saved(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    key, gone_key, h = (fresh(docs, x) for x in ("key", "gone", "h"))
    if shared.isEmpty():
        keyed = docs.withColumn(key, F.col("doc_id").cast("long"))
    else:
        mark = shared.select(F.col("doc_id").alias(h)).hint("merge")
        hashed = F.when(F.col(h).isNotNull(), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id").cast("long"))
        keyed = docs.join(mark, F.col("doc_id") == F.col(h), "left").withColumn(key, hashed).drop(h)
        named, unnamed = keyed.where("doc_id IS NOT NULL"), keyed.where("doc_id IS NULL")
        keyed = saved(named.dropDuplicates([key]).unionByName(unnamed))
    found = near_dups.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"))
    gone = found.where("NOT kept").select(F.col("doc_id").alias(gone_key)).distinct().hint("merge")
    return keyed.join(gone, F.col(key) == F.col(gone_key), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; each span of personal data is replaced by its kind in angle brackets."""
    prepare(spark)
    masked = docs.withColumn("text", pii.redacted(F.col("text")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document none to two times, so that sources' words meet their targets."""
    prepare(spark)
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each row; ids are little-endian unsigned 32-bit integers."""
    prepare(spark)
    return bpe_automaton.bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Stages learn models and walk graphs, which SQL can't express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
