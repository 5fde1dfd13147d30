"""Tables and the derived views that the statistical queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, period, y, x): mean order price and number of orders by nation and year."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return joined.groupBy(F.col("c_nationkey").alias("entity"), F.year("o_orderdate").alias("period")).agg(
        F.avg(F.col("o_totalprice") / 1000).alias("y"), F.count("*").cast("double").alias("x"))


def spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, time, event, x): days from an order to the customer's next, censored on 2001-08-01."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    nxt = F.lead("o_orderdate").over(w)
    days = F.datediff(F.coalesce(nxt, F.lit("2001-08-01").cast("timestamp_ntz")), F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (days + 1).cast("double").alias("time"), nxt.isNotNull().cast("int").alias("event"), (F.col("o_totalprice") / 100000).alias("x"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, score): quality labels with the documents' lengths as scores."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y"), F.col("n_chars").cast("double").alias("score"))


def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, family, p): values in (0, 1) from an integer generator of the part's key."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.alias("id"), F.col("p_brand").alias("family"), (((key * 7919 + 12345) % 100003) / 100003.0 * (((key * 31) % 7 + 1) / 7.0) + 1e-6).alias("p"))


#: The same views in SQL.
SQL = {
    "panel": "SELECT c_nationkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS period, avg(o_totalprice / 1000) AS y, CAST(count(*) AS DOUBLE) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "spells": "SELECT o_orderkey AS id, CAST(date_diff('day', CAST(o_orderdate AS DATE), coalesce(CAST(lead(o_orderdate) OVER w AS DATE), DATE '2001-08-01')) + 1 AS DOUBLE) AS time, CAST(lead(o_orderdate) OVER w IS NOT NULL AS INTEGER) AS event, o_totalprice / 100000 AS x FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "scores": "SELECT doc_id AS id, CAST(quality AS INTEGER) AS y, CAST(n_chars AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id)",
    "pvals": "SELECT p_partkey AS id, p_brand AS family, ((p_partkey * 7919 + 12345) % 100003) / 100003.0::DOUBLE * (((p_partkey * 31) % 7 + 1) / 7.0::DOUBLE) + 1e-6::DOUBLE AS p FROM part",
}
