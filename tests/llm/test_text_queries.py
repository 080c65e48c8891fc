"""The subpackage's queries: those with SQL against DuckDB, the others run; the core doesn't need them."""

import glob
import os
from pathlib import Path

import pytest

from seamline.llm import queries

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    res = con.execute(queries.ORACLE[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[names.index(c)] for c in cols) for r in res.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, data, name):
    queries.QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()


def test_nothing_else_imports_it():
    root = Path(queries.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text(), f
