"""The catalogue of queries: a name, the columns of the result, the query, and its SQL.

Doubles are rounded on both sides, as sums of many doubles differ in their last places with the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import significant, significant_sql
from .sources import SQL as VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 8


def register(name: str, columns: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None, digits: int = DIGITS) -> None:
    """columns: 'name:kind' with kind i (long), d (double), r (double near 0, to six places), s (string) or t (as it is)."""
    spec = [c.split(":") for c in columns.split()]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        how = {"i": lambda c: c.cast("long"), "d": lambda c: significant(c + F.lit(0.0), digits), "r": lambda c: F.round(c, 6) + F.lit(0.0), "s": lambda c: c, "t": lambda c: c}
        return df.select(*[how[k](F.col(c)).alias(c) for c, k in spec])

    QUERIES[name] = run
    if sql is not None:
        how = {"i": lambda c: f"CAST({c} AS BIGINT)", "d": lambda c: significant_sql(f"{c} + 0.0", digits), "r": lambda c: f"round({c}, 6) + 0.0", "s": lambda c: c, "t": lambda c: c}
        used = {v: q for v, q in VIEWS.items() if v in sql}
        views = "".join(f"{v} AS ({q}), " for v, q in used.items())
        ORACLES[name] = f"WITH {views}result AS ({sql}) SELECT {', '.join(f'{how[k](c)} AS {c}' for c, k in spec)} FROM result"


def from_row(spark: SparkSession, names: list[str], rows: list[tuple], kinds: str) -> DataFrame:
    return spark.createDataFrame(rows, ", ".join(f"{n} {'string' if k == 's' else 'double'}" for n, k in zip(names, kinds, strict=True)))


def t_two_sided_sql(t: str, df: str) -> str:
    """SQL for the two-sided p of Student's t: Simpson's rule over the density from 0 to |t|."""
    w = "CASE WHEN k IN (0,2000) THEN 1 WHEN k%2=1 THEN 4 ELSE 2 END"
    u = f"(abs({t})*k/2000.0::DOUBLE)"
    return f"(1-2*abs({t})/6000.0::DOUBLE*exp(lgamma((({df})+1)/2.0::DOUBLE)-lgamma(({df})/2.0::DOUBLE))/sqrt(({df})*pi())*(SELECT sum({w}*pow(1+{u}*{u}/({df}),-(({df})+1)/2.0::DOUBLE)) FROM range(2001) r(k)))"


def f_sf_sql(f: str, d1: str, d2: str) -> str:
    """SQL for the upper tail of F: Simpson's rule over the beta density from 0 to d2 / (d2 + d1 f)."""
    a, b, x = f"(({d2})/2.0::DOUBLE)", f"(({d1})/2.0::DOUBLE)", f"(({d2})/(({d2})+({d1})*({f})))"
    u = f"({x}*k/2000.0::DOUBLE)"
    w = "CASE WHEN k=2000 THEN 1 WHEN k%2=1 THEN 4 ELSE 2 END"
    return f"({x}/6000.0::DOUBLE*(SELECT sum({w}*exp(({a}-1)*ln({u})+({b}-1)*ln(1-{u})+lgamma({a}+{b})-lgamma({a})-lgamma({b}))) FROM range(1,2001) r(k)))"
