"""Every query of the core that has SQL gives the rows that SQL gives, on the small tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
from deponent.plans import catalogue

duckdb = pytest.importorskip("duckdb")


def plain(value):
    if value is None or value != value:
        return None
    return int(value) if isinstance(value, float) and value == int(value) else str(value) if not isinstance(value, (int, str)) else value


@pytest.fixture(scope="module")
def db(tables):
    c = duckdb.connect()
    for f in glob.glob(f"{tables}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, tables, db, name):
    df = catalogue.QUERIES[name](spark, tables)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalogue.SQL:
        assert got
        return
    result = db.execute(catalogue.SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want and got


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isdir("/root/testdata/sf0.001") is False or entry.entry(spark).count() > 0
