"""Every registered query against its SQL, on the smallest given tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from pathledger.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        name = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def rows_of(columns, names, rows):
    def plain(value):
        return round(value, 9) if isinstance(value, float) else value

    at = [names.index(column) for column in columns]
    return sorted((tuple(plain(row[i]) for i in at) for row in rows), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    found = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    cursor = duck.execute(ORACLES[name])
    names = [column[0] for column in cursor.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    expected = rows_of(columns, names, cursor.fetchall())
    assert rows_of(columns, df.columns, found) == expected
    assert expected


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() == 75
