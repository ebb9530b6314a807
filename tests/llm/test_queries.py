"""Registered queries with SQL twins against DuckDB, and the shape of the others."""

import duckdb
import pytest

from corpusfold.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    want = sorted(tuple(map(repr, (row[i] for i in at))) for row in found.fetchall())
    assert sorted(tuple(map(repr, row)) for row in df.select(*names).collect()) == want


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
