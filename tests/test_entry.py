"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from lexmill.plans import catalogue

DIR = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DIR}/{name}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(repr([round(v, 6) if isinstance(v, float) else v if v is None or isinstance(v, str | bool) else float(v) for v in r]) for r in frame.itertuples(index=False))


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    assert rows(catalogue.queries()[name](spark, DIR).toPandas()) == rows(db.execute(catalogue.oracle_sql()[name]).df())
