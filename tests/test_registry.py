"""The registered queries against their SQL, on the smallest tables."""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as contract
from check import cell
from sentinela.registry import ORACLES, QUERIES

SMALLEST = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{SMALLEST}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_names():
    assert not [n for n in QUERIES if "pipeline" in n or re.match(r"op\d+_", n)]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, db, name):
    df = contract.queries()[name](spark, SMALLEST)
    columns = sorted(df.columns)
    got = sorted(tuple(map(cell, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    names = ", ".join(f'"{c}"' for c in columns)
    want = sorted(tuple(map(cell, r)) for r in db.sql(f"SELECT {names} FROM ({contract.oracle_sql()[name]})").fetchall())
    assert got == want


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1


def test_recent_runs_is_its_sql_where_the_window_holds_more(spark):
    larger = "/root/testdata/sf0.1"
    connection = duckdb.connect()
    for path in glob.glob(f"{larger}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = sorted(tuple(map(cell, r)) for r in QUERIES["recent_runs"](spark, larger).collect())
    assert len(got) == 10_000
    assert got == sorted(tuple(map(cell, r)) for r in connection.sql(ORACLES["recent_runs"]).fetchall())
