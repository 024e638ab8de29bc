"""Every registered query against its DuckDB statement."""

import duckdb
import pytest

import __spark_entry__ as entry
from oracles.queries import ORACLES
from turnledger.catalog import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    theirs = _rows(columns, cursor.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_plans_a_cross_join(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
