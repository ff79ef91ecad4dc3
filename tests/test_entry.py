"""The driver's contract: queries run, names agree with the SQL, results equal DuckDB's."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as driver
from proseloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "documents labels pages benchmark conversations events customer orders lineitem".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    return round(x, 5) + 0.0 if isinstance(x, float) else x


def test_entry(spark):
    found = driver.entry(spark)
    assert found.count() > 0 and "sentences" in found.columns


def test_names():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, oracle, name):
    found = catalogue.QUERIES[name](spark, SF)
    want = oracle.sql(catalogue.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(want.columns)
    order = sorted(found.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in found.collect()), key=repr)
    at = [want.columns.index(c) for c in order]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
