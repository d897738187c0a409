"""Every registered query against its SQL twin on the smallest data folder."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_points
from check_oracle import TABLES, normal
from veilspan.plans import catalog, oracle

FOLDER = "/root/testdata/sf0.001"

@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.registered()))
def test_query(spark, duck, name):
    df = entry_points.queries()[name](spark, FOLDER)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(entry_points.oracle_sql()[name])
    want = normal([d[0] for d in result.description], result.fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(catalog.registered()) == set(oracle.statements())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_all_twins_are_texts():
    assert all(isinstance(sql, str) for sql in entry_points.oracle_sql().values())
