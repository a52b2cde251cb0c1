import glob
import os

import pytest

import __spark_entry__ as entry
from deponent.llm import queries as llm

duckdb = pytest.importorskip("duckdb")


def plain(value):
    if value is None or value != value:
        return None
    return int(value) if isinstance(value, float) and value == int(value) else str(value) if not isinstance(value, (int, str)) else value


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_query_equals_its_sql(spark, tables, name):
    db = duckdb.connect()
    for f in glob.glob(f"{tables}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    df = llm.QUERIES[name](spark, tables)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = db.execute(llm.SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in result.fetchall()), key=repr) and got


def test_queries_cover_every_document(spark, tables):
    q = entry.queries()
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert q["p6_ids"](spark, tables).count() == docs.count()
    flagged = q["p8_found"](spark, tables)
    assert flagged.columns == ["doc_id"] and 0 < flagged.count() < docs.count() / 5
    shares = q["p7_shares"](spark, tables)
    mix = q["p7_mix"](spark, tables)
    assert shares.count() == spark.read.parquet(f"{tables}/mix_targets.parquet").count()
    assert mix.agg({"n_tokens": "sum"}).first()[0] == shares.agg({"mixed_tokens": "sum"}).first()[0]
