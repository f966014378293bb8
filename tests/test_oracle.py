"""Every registered query against its DuckDB statement, over whole tables."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pytest
from fixtures import plan_of

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem".split()


def _rows(names, tuples) -> Counter:
    """Multiset of rows, columns in name order, exact up to the last float bits."""

    def plain(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else float(f"{value:.12g}")
        return value

    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(t[i]) for i in order) for t in tuples)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS FROM read_parquet('{FOLDER}/{table}.parquet')")
    yield con
    con.close()


OWN = [name for name in contract.queries() if name not in contract._llm_queries()]


def test_every_query_has_a_statement():
    assert set(OWN) == set(contract.oracle_sql()) - set(contract._llm_statements())


@pytest.mark.parametrize("name", OWN)
def test_same_rows(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    plan = plan_of(df)
    for node in ("CartesianProduct", "NestedLoopJoin", "PythonUDF", "EvalPython", "MapInPandas"):
        assert node not in plan
    got = _rows(df.columns, df.collect())
    result = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = _rows(names, result.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert sum(got.values()) > 0
    assert got == want


def test_entry(spark):
    assert contract.entry(spark).count() == 10
