from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from groupfit import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted([tuple(r[k] for k in order) for r in rows], key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_agrees_with_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    sql = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(sql.columns, sql.fetchall())


def test_contract(spark):
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 3
