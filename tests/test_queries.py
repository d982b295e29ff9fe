"""Every engine query against its SQL on small tables."""

import os

import duckdb
import pytest

from scenelake.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for name in os.listdir(SF):
        c.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([r[k] for k in order]) for r in data)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
