"""The registered corpus queries: names, and those with SQL against it, on the smallest given tables."""

import os

import __spark_entry__ as entry
import duckdb
import pytest
from pathledger.llm.queries import ORACLES, QUERIES


def test_one_query_per_operator_and_the_pipeline():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql()) and "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    found = QUERIES[name](spark, sf_dir)
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(found.columns)
    expected = sorted(tuple(row[names.index(c)] for c in found.columns) for row in cursor.fetchall())
    assert sorted(map(tuple, found.collect())) == expected
