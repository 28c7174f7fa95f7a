"""Queries against their SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lodestep.plans import queries, sql

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) if not isinstance(r[i], float) else repr(round(r[i], 9)) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query(spark, duck, name):
    found = queries.queries()[name](spark, SF)
    wanted = duck.sql(sql.ORACLES[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found.columns, found.collect()) == rows(wanted.columns, wanted.fetchall())
