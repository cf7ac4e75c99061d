"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from runlens.plans import registry


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, sf, db, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(cols).collect()]
    want = db.execute("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({registry.ORACLES[name]})").fetchall()
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert text(got) == text(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
