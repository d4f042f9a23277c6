"""Every query against its SQL, over the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver

# Those of the training-data operators are tested beside them.
from revlume.plans.oracle import ORACLE
from revlume.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def shown(value):
    return f"{value:.6f}" if isinstance(value, float) else str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    got = table(frame.columns, frame.collect())
    result = con.sql(ORACLE[name])
    assert sorted(frame.columns) == sorted(result.columns)
    assert got == table(result.columns, result.fetchall())
    assert got, "a query without rows checks nothing"


def test_entry(spark):
    assert driver.entry(spark).count() > 0
