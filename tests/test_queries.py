"""Each query with SQL gives the rows that SQL gives on the smallest tables."""

import os
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from statloom.queries import ORACLES, QUERIES

#: Of families of one expression each, and of fits that take long, every third.
MANY = ("loss_", "link_", "variance_", "prox_", "cdf_", "pdf_", "ppf_", "kernel_", "kde_", "glm_", "penalized_", "solver_", "quantile_", "robust_", "padj_", "panel_", "fe_", "cox_", "gaussian_mixture_")
SAMPLE = [n for i, n in enumerate(sorted(ORACLES)) if i % 3 == 0 or not n.startswith(MANY)]


@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_rows_equal_sql(spark, small, tables, name):
    got = QUERIES[name](spark, small)
    want = tables.sql(ORACLES[name])
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


def test_entry_without_the_corpus_package(tmp_path):
    """Another copy of the repository, without statloom/llm and tests/llm, still gives its queries."""
    root = Path(__file__).resolve().parent.parent
    for f in [*root.glob("*.py"), *(root / "statloom").rglob("*.py")]:
        if "llm" not in f.relative_to(root).parts:
            (tmp_path / f.relative_to(root)).parent.mkdir(parents=True, exist_ok=True)
            shutil.copy(f, tmp_path / f.relative_to(root))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'anova_oneway' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
