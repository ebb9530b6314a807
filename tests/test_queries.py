"""Every registered query against the same result computed by DuckDB at the smallest scale."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from corpusfold.workloads.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return con


def _rows(rows):
    return sorted(tuple(map(repr, row)) for row in rows)


def test_every_query_has_a_check():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    expected = _rows([row[i] for i in at] for row in found.fetchall())
    assert _rows(df.select(*names).collect()) == expected


def test_entry_is_the_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["path", "level", "tokens"]
    assert set(entry.queries()) >= set(QUERIES)


def test_entry_without_the_optional_part():
    """Also where the pipeline's file is still there."""
    code = (
        "import sys; sys.modules['corpusfold.llm'] = None; import __spark_entry__ as e; "
        "assert not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']; print(len(e.queries()))"
    )
    root = Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout) == len(QUERIES), done.stderr
