"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from stratalens import registry
from stratalens.plans.adapters import TABLES

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, sf, name):
    df = registry.queries()[name](spark, sf)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(norm(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_context_is_deterministic_and_keeps_seeds(spark, sf):
    q = registry.queries()
    rows = q["r1_context"](spark, sf).collect()
    assert rows == q["r1_context"](spark, sf).collect() and any(r.hops == 0 for r in rows)
