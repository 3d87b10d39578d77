"""Every query with a SQL statement equals DuckDB; plans keep the hygiene rules."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, cell
from tidelattice.plans.catalog import all_queries, all_sql

SF = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def check_plan(df, name):
    """No pairing of whole tables, and no ordered window over everything in one task."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    below_window = False
    for line in plan.splitlines():
        if re.search(r"\bWindow(GroupLimit)? \[", line):
            below_window = True
        elif "Exchange" in line and below_window:
            assert "SinglePartition" not in line, line
            below_window = False


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    check_plan(df, name)
    cols = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in cols) for r in df.select(*cols).collect())
    cur = db.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(cell(r[i]) for i in at) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.01")
    check_plan(df, name)
    assert not df.isEmpty()


def test_entry(spark):
    assert entry.entry(spark).count() == 4
