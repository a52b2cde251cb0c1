import pytest
from pyspark.sql import functions as F

from deponent.sources import scans
from tests.conftest import rows


def test_text_lines_and_byte_spans(spark):
    text = "ignored\n: no-key\nempty:   \r\nvälid: välue\r\na: a\nurl : http://x:1\n"
    df = spark.createDataFrame([("f", text), ("g", ""), ("h", None)], "artifact_id string, text string")
    got = scans.scan_text(df)
    assert rows(got, "predicate", "original_value", "paragraph_number") == [("a", "a", 5), ("url", "http://x:1", 6), ("välid", "välue", 4)]
    raw = text.encode()
    for r in got.collect():
        value = raw[r["text_span_start"] : r["text_span_end"]].decode()
        assert value == r["original_value"]
    assert got.where("predicate = 'a'").first()["text_span_start"] == raw.index(b"a: a")  # first occurrence in the line


def test_json_scalars(spark):
    data = [("a", '{"b":1,"a":"x","n":null,"o":{"p":1},"l":[1],"t":true,"d":1.5}'), ("b", "[1]"), ("c", "{"), ("d", None), ("e", '{"k":1,"k":2}'), ("f", '"s"'), ("g", "{}")]
    fields, bad = scans.scan_json(spark.createDataFrame(data, "artifact_id string, text string"))
    assert rows(fields, "artifact_id", "predicate", "original_value") == [("a", "a", "x"), ("a", "b", "1"), ("a", "d", "1.5"), ("a", "n", "null"), ("a", "t", "true"), ("e", "k", "2")]
    assert rows(bad, "artifact_id") == [("b",), ("c",), ("d",), ("f",)]


@pytest.mark.parametrize(
    "text, want",
    [
        ('a,b\n"x ""y""",2\n', [["a", "b"], ['x "y"', "2"]]),
        ("a,b\r\n1,2\r\n\r\n,\n3,4", [["a", "b"], ["1", "2"], ["3", "4"]]),
        ("a,b\n1,", [["a", "b"], ["1", ""]]),
        ('a\n"x\ny"\n', [["a"], ["x\ny"]]),
        ('a\nx"y,z"w\n', [["a"], ["xy,zw"]]),
        ('""""\n', [['"']]),
        ('"",x', [["", "x"]]),
        ("a\nb\r", [["a"], ["b\r"]]),
        ("a,,\n,,\n,,", [["a", "", ""], ["", "", ""]]),
        ("", []),
    ],
)
def test_csv_records(text, want):
    assert scans.csv_records(text) == want


def test_csv_open_quote():
    with pytest.raises(ValueError):
        scans.csv_records('a\n"b')


def test_csv_cells_all_or_nothing(spark):
    data = [("ok", "name, amount\nAnn,1\n\nBo,\n"), ("uneven", "name,amount\nAnn\n"), ("blank", "name,\nAnn,1\n"), ("open", 'a\n"'), ("only head", "a,b\n"), ("empty", ""), ("null", None)]
    fields, bad = scans.scan_csv(spark.createDataFrame(data, "artifact_id string, text string"))
    assert rows(fields, "subject_key", "predicate", "original_value", "row_number", "column_number") == [("row:1", "amount", "1", 1, 1), ("row:1", "name", "Ann", 1, 0), ("row:2", "name", "Bo", 2, 0)]
    assert rows(bad, "artifact_id") == [("blank",), ("null",), ("open",), ("uneven",)]


#: Invented documents of three formats: thirteen fields, all typed and located.
GOLDEN = [
    ("t", "text/plain", "name: Example Person\nreceived_date: 2026-08-12\nmonthly_amount: $1,427.00\nresponse_required: true\n"),
    ("j", "application/json", '{"received_date":"2026-08-12","count":3,"active":false}'),
    ("c", "text/csv", 'name,monthly_amount,received_date\n"Doe, Ann",12.50,2026-08-12\nBo,7.25,2026-08-13\n'),
]


def test_extraction(spark):
    more = [("bad", "text/csv", "a,b\n1\n"), ("pdf", "application/pdf", "x"), ("none", "text/plain", "no fields here"), ("val", "text/plain", "ok: 1\nprice: $5\n"), ("ctl", "application/json", '{"a":"x\\ty","b":"z"}')]
    df = spark.createDataFrame(GOLDEN + more, "artifact_id string, media_type string, text string").select("artifact_id", "media_type", F.col("text").cast("binary").alias("content"))
    df = df.unionByName(spark.createDataFrame([("utf", "text/plain", bytearray(b"a: \xff"))], "artifact_id string, media_type string, content binary"))
    out = scans.extract(df)
    assert out.fields.count() == 13
    assert out.fields.where("kind in ('error', 'unknown')").count() == 0
    assert out.fields.where("row_number is null and source_field is null").count() == 0
    assert {r[0]: r[1] for r in out.fields.groupBy("artifact_id").count().collect()} == {"t": 4, "j": 3, "c": 6}
    assert rows(out.failures, "artifact_id", "reason") == [("bad", "malformed_input"), ("ctl", "validation_rejected"), ("none", "no_observations"), ("pdf", "unsupported_format"), ("utf", "malformed_input"), ("val", "validation_rejected")]


def test_extra_format(spark):
    def shout(text):
        if text == "no":
            raise ValueError
        return [("document", "all", text.upper(), "all", None, None, None, None, None)]

    df = spark.createDataFrame([("a", "text/plain", bytearray(b"hi")), ("b", "text/plain", bytearray(b"no")), ("c", "text/csv", bytearray(b"a"))], "artifact_id string, media_type string, content binary")
    got = scans.extract(df, {"text": shout})
    assert rows(got.fields, "original_value") == [("HI",)] and rows(got.failures) == [("b", "malformed_input"), ("c", "unsupported_format")]


@pytest.mark.parametrize("text", ['{"a":1} trailing', '{"a":1}{"b":2}', '{"a":1,"a":2} x', '{"a":1}] x', '{"a":1},{"b":2}', "{'a':1}", '{"a":NaN}', '{"a":Infinity}', '{"a":1e999}', '{"a":"\\ud800"}', '{"a":"\t"}', "\ufeff{}", '{"a":' + "[" * 127 + "]" * 127 + "}", '{"a":' + "[" * 9000 + "]" * 9000 + "}", "", " ", '{"a":01}'])
def test_what_is_no_whole_object_is_malformed(text):
    with pytest.raises(ValueError):
        scans.json_fields(text)


def test_number_texts():
    text = '{"a":1.0,"b":-0,"c":18446744073709551615,"d":18446744073709551616,"e":1e16,"f":123456789012345.5,"g":0.00001,"h":1.5e-7,"i":1E2,"j":-9223372036854775808,"k":12345678901234567.0,"l":0.0,"m":{"x":' + "[" * 125 + "]" * 125 + "}}"
    assert {f[1]: f[2] for f in scans.json_fields(text)} == {"a": "1.0", "b": "-0.0", "c": "18446744073709551615", "d": "1.8446744073709552e19", "e": "1e16", "f": "123456789012345.5", "g": "0.00001", "h": "1.5e-7", "i": "100.0", "j": "-9223372036854775808", "k": "1.2345678901234568e16", "l": "0.0"}


def test_bounds_of_values(spark):
    def one(artifact, key, value):
        return (artifact, "text/plain", bytearray(f"{key}: {value}\n".encode()))

    data = [one("long", "k", "x" * 500_000), one("most", "k", "x" * 1_000_000), one("over", "k", "x" * 1_000_001), one("key", "k" * 300, "v"), one("key over", "k" * 301, "v")]
    out = scans.extract(spark.createDataFrame(data, "artifact_id string, media_type string, content binary"))
    assert rows(out.fields.select("artifact_id", F.length("original_value"))) == [("key", 1), ("long", 500_000), ("most", 1_000_000)]
    assert rows(out.failures) == [("key over", "validation_rejected"), ("over", "validation_rejected")]


def test_every_failure_has_its_reason(spark):
    data = [("none", "text/plain", None, None), ("hash", "text/plain", b"a: b", "0" * 64), ("empty csv", "text/csv", b"", None), ("head", "text/csv", b"a,b\n", None), ("odd", None, b"a: b", None), ("utf", "application/json", b"\xff", None), ("ok", "application/json; charset=x", b'{"d":"2026-08-12","n":1.0}', None)]
    df = spark.createDataFrame([(a, m, None if c is None else bytearray(c), h) for a, m, c, h in data], "artifact_id string, media_type string, content binary, content_sha256 string")
    out = scans.extract(df.withColumns({"reason": F.lit("clash"), "fields": F.lit(1)}))
    assert rows(out.failures) == [("empty csv", "no_observations"), ("hash", "unreadable_artifact"), ("head", "no_observations"), ("none", "unreadable_artifact"), ("odd", "unsupported_format"), ("utf", "malformed_input")]
    got = {r["predicate"]: r for r in out.fields.collect()}
    assert got["n"]["kind"] == "decimal" and got["n"]["temporal"] is None
    assert (got["d"]["temporal"]["kind"], str(got["d"]["temporal"]["date"]), got["d"]["temporal"]["original"]) == ("exact_date", "2026-08-12", "2026-08-12")
    assert scans.extract(df.limit(0)).outcomes.count() == 0


def test_too_large(spark, monkeypatch):
    df = spark.createDataFrame([("a", "text/plain", bytearray(b"abcd: e"))], "artifact_id string, media_type string, content binary")
    assert scans.decode(df.withColumn("content", F.repeat(F.lit("x"), scans.MAX_BYTES + 1).cast("binary")))[1].first()["reason"] == "too_large"


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("k: v")
    (tmp_path / "b.CSV").write_text("a\n1\n")
    got = scans.read_artifacts(spark, str(tmp_path))
    assert [r[0] for r in rows(got, "media_type")] == ["text/csv", "text/plain"]
    assert got.where("media_type = 'text/plain'").first()["length"] == 4
