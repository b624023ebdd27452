"""Every registered query against its SQL, on all rows of the given tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from geotrail.plans.checks import CHECKS as QUERIES
from geotrail.plans.oracle import ORACLE as SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for file in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


def comparable(row):
    out = []
    for value in row:
        if isinstance(value, bool) or value is None or isinstance(value, str):
            out.append(str(value))
        elif isinstance(value, float) and math.isnan(value):
            out.append("None")
        else:
            out.append(repr(float(value)))
    return tuple(out)


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()
    assert QUERIES.keys() <= contract.queries().keys()
    assert SQL.keys() <= contract.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert len(duck.execute(f"DESCRIBE {SQL[name]}").fetchall()) == len(columns)
    assert sorted(map(comparable, got.select(*columns).collect())) == sorted(map(comparable, want))


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() == 14
