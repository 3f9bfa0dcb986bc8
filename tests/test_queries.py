"""Every query equals its SQL, run by another engine."""

import os

import duckdb
import pytest

from rowmill.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    result = sql.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    key = lambda rows, columns: sorted(tuple(str(r[columns.index(c)]) for c in sorted(columns)) for r in rows)
    assert key(df.collect(), df.columns) == key(result.fetchall(), names)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
