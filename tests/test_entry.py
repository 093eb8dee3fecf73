"""Every registered query against its SQL in DuckDB, on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA
from verify import normal


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    assert len(got) > 0
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_entry(spark):
    result = entry.entry(spark)
    assert result.count() == 8
    assert result.columns[0] == "job_id" and result.columns[-1] == "similarity"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
