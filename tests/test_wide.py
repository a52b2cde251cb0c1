import json
from decimal import Decimal

from pyspark.sql import functions as F

from deponent.operators.wide import melted, wide_table
from tests.conftest import rows

CLAIM = "case_id string, subject_key string, predicate string, normalized_value string, extracted_at_ms bigint, field_id bigint"
TYPES = [("name", "text"), ("received_date", "date"), ("late_fee", "money"), ("area_sqm", "decimal"), ("count", "integer"), ("active", "boolean")]


def known(kind, value):
    return json.dumps({"knowledge": "known", "value": {"type": kind, "value": value}}, separators=(",", ":"))


def num(c, s):
    return {"coefficient": c, "scale": s}


def cells(spark, data):
    t = spark.createDataFrame(TYPES, "predicate string, value_type string")
    df = spark.createDataFrame(data, CLAIM).withColumns({"position": F.lit("x"), "cell": F.lit(1), "v": F.lit(2)})
    return rows(melted(wide_table(df, t), t))


def test_spelling_and_latest(spark):
    data = [
        ("c", "Party:Ann 7 ", "Late-Fee", known("money", {"amount": num(1050, 2), "currency": "USD"}), 5, 1),
        ("c", "party:ann_7", "lateFee", known("integer", 12), 5, 2),
        ("c", "party:ann  7", " late__fee", known("text", "12"), 9, 3),
        ("c", "party:ann-7", "late fee", '{"knowledge":"unknown"}', 9, 4),
        ("c", "party:ann-7", "NAME\t", known("text", "  Ann "), None, 5),
        ("d", "party:ann-7", "name", known("text", "Bo"), 1, 6),
        ("d", "party:ann-7", "nobody", known("text", "x"), 1, 7),
    ]
    assert cells(spark, data) == [("c", "party:ann-7", "late_fee", "12"), ("c", "party:ann-7", "name", "Ann"), ("d", "party:ann-7", "name", "Bo")]


TYPED = [
    ("late_fee", known("decimal", num(-5, 3)), "-0.005"),
    ("late_fee", known("money", {"amount": num(100, 2), "currency": "USD"}), "1"),
    ("area_sqm", known("decimal", num(0, 18)), "0"),
    ("area_sqm", known("decimal", num(9223372036854775807, 18)), "9.223372036854775807"),
    ("area_sqm", known("decimal", num(-(2**63), 0)), str(-(2**63))),
    ("area_sqm", known("decimal", num(1, 18)), "0.000000000000000001"),
    ("area_sqm", known("integer", 1200), "1200"),
    ("area_sqm", known("decimal", num(1, 19)), None),
    ("area_sqm", known("decimal", num(None, 2)), None),
    ("area_sqm", known("money", {"amount": num(1, 0), "currency": "USD"}), None),
    ("count", known("integer", -7), "-7"),
    ("count", known("decimal", num(70, 1)), None),
    ("count", known("integer", 2**63), None),
    ("active", known("boolean", False), "false"),
    ("received_date", known("date", {"year": 2024, "month": 2, "day": 29}), "2024-02-29"),
    ("received_date", known("date", {"year": 2023, "month": 2, "day": 29}), None),
    ("received_date", known("date", {"year": 0, "month": 2, "day": 2}), None),
    ("received_date", known("text", "2023-02-28"), None),
    *(("name", broken, None) for broken in (None, "", "null", "[]", "7", '{"knowledge":"known"}', known("text", "x")[:-1], known("text", "x") + "}")),
]


def test_types(spark):
    data = [("c", f"s{i:02}", p, v, 1, 1) for i, (p, v, _) in enumerate(TYPED)]
    assert cells(spark, data) == [("c", f"s{i:02}", p, want) for i, (p, _, want) in enumerate(TYPED) if want is not None]


def test_wide_has_a_row_for_each_entity(spark):
    t = spark.createDataFrame(TYPES, "predicate string, value_type string")
    data = [("c", "s", "name", None, 1, 1), ("c", "t", "late_fee", known("decimal", num(15, 1)), 1, 2), ("c", "t", "late_fee", known("decimal", num(15, 1)), 1, 2), (None, "t", "name", known("text", "x"), 1, 3), ("c", None, "name", known("text", "x"), 1, 4)]
    w = wide_table(spark.createDataFrame(data, CLAIM), t)
    assert w.columns == ["case_id", "subject_key", "active", "area_sqm", "count", "late_fee", "name", "received_date"]
    assert rows(w) == [("c", "s", *[None] * 6), ("c", "t", None, None, None, Decimal("1.5"), None, None)]


def test_empty(spark):
    assert cells(spark, []) == []
    none = spark.createDataFrame([], "predicate string, value_type string")
    assert wide_table(spark.createDataFrame([], CLAIM), none).collect() == []


def test_long_text_and_hot_entity(spark):
    long = "y" * 200_000
    data = [("c", "s", "name", known("text", "x"), i, i) for i in range(3000)] + [("c", "s", "name", known("text", long), 5000, 1)]
    assert cells(spark, data) == [("c", "s", "name", long)]
