import csv

import pytest
from pyspark.sql import functions as F

from deponent.operators import rejects
from deponent.operators.rejects import assemble_lines, assemble_records, parse_record, read_records, split_records
from tests.conftest import rows

SCHEMA = "line_id bigint, artifact_version_id string, row_number int, raw_line string"
HEAD = (1, "f", 0, '\ufeff"Name", Monthly-Amount ,RECEIVED_DATE,response_required\r')


def reasons(spark, *lines, head=HEAD):
    df = spark.createDataFrame([head, *((i, "f", i, raw) for i, raw in enumerate(lines, 2))], SCHEMA)
    failed = {r["line_id"]: r["reason"] for r in split_records(df).failed.collect()}
    loaded = {r["line_id"] for r in split_records(df).loaded.collect()}
    assert not failed.keys() & loaded
    return [failed.get(i, "ok" if i in loaded else None) for i in range(2, len(lines) + 2)]


def test_assembly_follows_quotes():
    assert list(assemble_records(['a,"b\n', 'c"\r\n', "d\n", 'e,"f'])) == ['a,"b\nc"', "d", 'e,"f']


@pytest.mark.parametrize("bad", ['"a', 'a"b"', '"a"b', '"a" ,b', ' "a"', '"a""'])
def test_structure_faults_raise(bad):
    with pytest.raises(csv.Error):
        parse_record(bad)


def test_breaks_outside_quotes_are_signs():
    assert parse_record('a\nb,"c ""d""",\r,') == ["a\nb", 'c "d"', "\r", ""]
    assert parse_record("a\nb") == ["a\nb"]


def test_two_quotes_are_one():
    assert parse_record('"a ""b"" c","",d') == ['a "b" c', "", "d"]


def test_reasons(spark):
    got = reasons(
        spark,
        "Ann,1.50,2024-02-29,TRUE",
        '"Ann, B\nc/o C","$1,234.50",null,\r',
        "Ann,-12,unknown,False",
        '"Ann,1,2024-01-01,true',
        'An"n",1,2024-01-01,true',
        "Ann,1,2024-01-01",
        "Ann,1,2024-01-01,true,",
        " ,1,2024-01-01,true",
        "A\x07nn,1,2024-01-01,true",
        "Ann,1O,2024-01-01,true",
        "Ann,$5,2024-01-01,true",
        'Ann,"$12,34.50",2024-01-01,true',
        "Ann,1.1234567890123456789,2024-01-01,true",
        "Ann,1,2023-02-29,true",
        "Ann,1,2024-1-1,true",
        "Ann,1,0000-01-01,true",
        "Ann,1,2024-01-01,yes",
        "null,,,",
    )
    assert got == ["ok", "ok", "ok", "quoting", "quoting", "columns", "columns", *["value"] * 10, "ok"]


def test_first_reason_wins(spark):
    assert reasons(spark, '"Ann', 'a"b,1', ",x,y,z,1") == ["quoting", "quoting", "columns"]


def test_edges(spark):
    long = "x" * 300_000
    data = [
        HEAD,
        (2, "f", 1, None),
        (3, "f", 2, " \r"),
        (4, None, 1, "Ann,1,,"),
        (5, "no header", 1, "Ann,1"),
        (6, "f", None, f"{long},1,,"),
        (7, "f", 3, "Ann,1,,\r\n"),
        (7, "f", 3, "Ann,1,,\r\n"),
        (8, "f", 4, "bad"),
        (8, "f", 4, "bad"),
        (9, "f", 5, "Ann,1,,\nBen,2,,"),
        (10, "f", 6, "Ann\nB\u2028,1,,\r"),
        (11, "f", 7, 'A\rnn,1,"",'),
        (12, "g", 0, '"name", "amount"'),
        (13, "g", 1, '"Ann, A",5'),
    ]
    df = spark.createDataFrame(data, SCHEMA).withColumns({"reason": F.lit("x"), "cells": F.lit(1), "name": F.lit(2)})
    out = split_records(df)
    assert rows(out.failed, "line_id", "reason") == [(4, "columns"), (5, "columns"), (8, "columns"), (9, "columns")]
    assert rows(out.loaded, "line_id") == [(10,), (11,), (13,), (6,), (7,)]
    assert out.loaded.where("line_id = 6").first()["name"] == long


def test_empty_table(spark):
    out = split_records(spark.createDataFrame([], SCHEMA))
    assert out.failed.count() == out.loaded.count() == 0


def test_hot_file(spark):
    data = [HEAD] + [(i, "f", i, f"N{i},{i}.5,,") for i in range(2, 3000)] + [(9000 + i, f"g{i}", 0, "name") for i in range(50)]
    assert split_records(spark.createDataFrame(data, SCHEMA)).loaded.agg(F.sum("amount")).first()[0] == sum(i + 0.5 for i in range(2, 3000))


def test_only_copies_of_a_record_merge(spark):
    bad = [(None, "f", 1, "bad"), (None, "f", 2, "bad"), (None, "f", 3, '"open'), (None, None, 4, "bad"), (5, "f", 5, "bad"), (5, "f", 5, "worse"), (5, "f", 6, '"open')]
    good = [(None, "f", 7, "Ann,1,,"), (None, "f", 8, "Ann,1,,"), (None, "f", 8, "Ann,1.0,,"), (None, "f", 8, "Ann,1,null,"), (9, "f", 9, "Ann,1,,"), (9, "f", 9, "Ann,1,null,")]
    again = [(i, f, n, raw + "\r\n") for i, f, n, raw in bad[:1] + bad[4:6] + good[:1] + good[5:]]
    out = split_records(spark.createDataFrame([HEAD, *bad, *good, *bad, *good, *again], SCHEMA))
    assert rows(out.failed, "line_id", "row_number", "reason") == sorted(((i, n, "quoting" if raw == '"open' else "columns") for i, f, n, raw in bad), key=repr)
    assert rows(out.loaded, "line_id", "row_number") == sorted(((i, n) for i, f, n, raw in good), key=repr)
    assert rows(out.failed_texts().where("row_number = 5"), "raw_line") == [("bad",), ("worse",)]


def test_the_strict_reader_decides(monkeypatch):
    class Refusing:
        Error = csv.Error

        @staticmethod
        def reader(lines, strict):
            assert strict
            raise csv.Error("refused")

    monkeypatch.setattr(rejects, "csv", Refusing)
    with pytest.raises(csv.Error, match="refused"):
        parse_record('a,"b"')


def test_lines_are_assembled_as_a_whole_file_is(spark):
    import random

    r = random.Random(4)
    files = {f"f{i}": ["".join(r.choice('ab,"') for _ in range(r.randrange(6))) + r.choice(["", "\r"]) for _ in range(r.randrange(1, 60))] for i in range(8)}
    data = [(f, i, line) for f, lines in files.items() for i, line in enumerate(lines)] + [(None, 0, '"x'), (None, 1, 'y"'), ("null", 0, None)]
    r.shuffle(data)
    got = assemble_lines(spark.createDataFrame(data, "file_id string, n int, line string"), ["n"])
    found = {}
    for x in got.collect():
        found.setdefault(x["file_id"], []).append((x["row_number"], x["raw_line"], x["is_open"], x["n_lines"]))
    assert found.pop(None) == [(0, '"x\ny"', False, 2)] and found.pop("null") == [(0, "", False, 1)]
    for f, lines in files.items():
        want = list(assemble_records(line + "\n" for line in lines))
        mine = sorted(found[f])
        assert [n for n, *_ in mine] == list(range(len(want))) and sum(x[3] for x in mine) == len(lines)
        for (_, raw, is_open, n), record in zip(mine, want):
            assert raw.rstrip("\r\n") == record or (is_open and record.startswith(raw) and n == record.count("\n"))


def test_files_are_loaded_whatever_their_splits(spark, tmp_path):
    rows_ = [f'"N{i}\r\nof ""{i}""",{i}.5,2024-01-01,true' if i % 3 else f"N{i},{i},," for i in range(400)]
    (tmp_path / "a.csv").write_bytes(("name,amount,received_date,response_required\r\n" + "\r\n".join(rows_) + "\r\nbad\r\n").encode())
    (tmp_path / "b.csv").write_bytes(b'name\nAnn\n"open\nBo\nCy\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        out = split_records(read_records(spark, str(tmp_path)))
        assert out.loaded.count() == 401 and out.loaded.where("name = 'N1\r\nof \"1\"'").count() == 1
        assert rows(out.failed_texts(), "reason", "raw_line") == [("columns", "bad\r"), ("quoting", '"open')]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
