"""Every registered query against its SQL restatement on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def comparable(frame):
    frame = frame[sorted(frame.columns)].astype(str)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def test_every_oracle_belongs_to_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, duck, name):
    mine = driver.queries()[name](spark, FOLDER).toPandas()
    assert len(mine.columns) == len(set(mine.columns))
    oracle = driver.oracle_sql().get(name)
    if oracle is not None:
        theirs = duck.sql(oracle).df()
        assert sorted(mine.columns) == sorted(theirs.columns)
        assert comparable(mine).equals(comparable(theirs))


def test_entry(spark):
    assert driver.entry(spark).count() > 0
