"""Every query with SQL gives what DuckDB gives; every other one runs."""

import glob
import math
import os

import pytest

from seamline.plans import registry

duckdb = pytest.importorskip("duckdb")


def plain(v):
    if v is None or isinstance(v, bool):
        return repr(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else f"{round(float(v), 5) + 0.0:.5f}"
    return str(v)


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_names():
    assert set(registry.ORACLE) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, data, sql, name):
    df = registry.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    res = sql.execute(registry.ORACLE[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, data, name):
    registry.QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
