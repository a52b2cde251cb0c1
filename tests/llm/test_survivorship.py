import random

from pyspark.sql import functions as F

from deponent.llm.survivorship import END_MS, FIRST_MS, STATES, best_records
from tests.conftest import rows

SCHEMA = "id string, artifact_version_id string, page_number int, paragraph_number int, row_number int, column_number int, source_field string, verification_state string, extracted_at_ms bigint, confidence double"
T = 1_700_000_000_000


def rec(id_, state="verified", at=T, conf=0.5, field="name", version="v", page=None):
    return (id_, version, page, None, 1, 2, field, state, at, conf)


def brute(data):
    groups = {}
    for r in set(map(repr, data)):
        r = eval(r, {"nan": float("nan")})
        if r[0] is not None:
            key = (*r[1:6], None if r[6] is None else "".join(c for c in r[6] if not c.isspace() and c not in "-_").lower())
            groups.setdefault(key, {})[r[0]] = r
    out = []
    for g in groups.values():
        if len(g) < 2:
            continue
        t = {i: r[8] if r[8] is not None and FIRST_MS <= r[8] < END_MS else None for i, r in g.items()}
        c = {i: r[9] if r[9] is not None and 0 <= r[9] <= 1 else None for i, r in g.items()}
        s = {i: STATES.index(x) if (x := (r[7] or "").strip().lower()) in STATES else 2 for i, r in g.items()}
        order = sorted(g, key=lambda i: (s[i], t[i] is None, -(t[i] or 0), c[i] is None, -(c[i] or 0), i))
        late = sorted((i for i in g if t[i] is not None), key=lambda i: (-t[i], i))
        sure = [i for i in order if c[i] is not None]
        out.append((order[0], late[0] if late else "none", sure[0] if sure else "none"))
    return sorted(out, key=repr)


def found(spark, data):
    return rows(best_records(spark.createDataFrame(data, SCHEMA)), "survivor_id", "extracted_id", "confidence_id")


def test_fields_come_from_different_records(spark):
    data = [rec("a", "rejected", T + 9, None), rec("b", " VERIFIED ", T, None, "Na-me"), rec("c", "corrected", T + 1, 0.2, "n a_m e")]
    assert found(spark, data) == [("b", "a", "c")] == brute(data)


def test_unusable_values_rank_last(spark):
    data = [rec("a", "ok", END_MS, 1.5), rec("b", None, FIRST_MS, float("nan")), rec("c", "?", FIRST_MS - 1, -0.01)]
    assert found(spark, data) == [("b", "b", "none")] == brute(data)
    data = [rec("a", at=None, conf=None), rec("b", at=-1, conf=2.0)]
    assert found(spark, data) == [("a", "none", "none")]


def test_edges(spark):
    data = [rec("a"), rec("a"), rec(None), rec("b", field=None), rec("c", field=None), rec("d", field=""), rec("e", version=None, page=3), rec("f", version=None, page=3)]
    assert found(spark, data) == [("b", "b", "b"), ("e", "e", "e")]
    extra = spark.createDataFrame(data, SCHEMA).withColumns({"rank": F.lit("x"), "late": F.lit("y"), "first_id": F.lit(0)})
    assert best_records(extra).count() == 2
    assert best_records(spark.createDataFrame([], SCHEMA)).count() == 0


def test_against_brute_force(spark):
    r = random.Random(3)
    states = [*STATES, " Verified", "REJECTED ", "ok", "", None]
    data = [
        rec(f"p{i:03}", r.choice(states), r.choice([None, 0, T, T + 1, T + 2, END_MS]), r.choice([None, 0.0, 0.5, 0.9, 1.0, 1.1, float("nan")]), r.choice(["x", "X ", "y", None]), r.choice(["v", "w", None]), r.choice([None, 1]))
        for i in range(300)
    ]
    assert found(spark, data + data[:40]) == brute(data)


def test_hot_group(spark):
    hot = spark.range(20_000).select(F.format_string("p%06d", "id").alias("id"), *(F.lit(None).cast("int").alias(c) for c in ("page_number", "paragraph_number", "row_number", "column_number")), F.lit("v").alias("artifact_version_id"), F.lit("f").alias("source_field"), F.lit("verified").alias("verification_state"), (F.lit(T) + F.col("id") % 100).alias("extracted_at_ms"), F.lit(0.5).alias("confidence"))
    assert rows(best_records(hot), "survivor_id", "extracted_id") == [("p000099", "p000099")]


def test_the_record_is_built_field_by_field(spark):
    schema = SCHEMA + ", connector string, endpoint string, model_provider string, model_name string, original_representation string"
    data = [
        (*rec("a", "Rejected ", T + 5, 0.9, "Na-me"), "x", None, "p1", None, "late"),
        (*rec("b", "verified", T, 0.0, "name"), None, "e2", None, "m2", None),
        (*rec("c", "corrected", T + 1, None, "NAME"), "z", "e3", "p3", "m3", "mid"),
        (*rec("d", "verified", page=7), "solo", None, None, None, None),
    ]
    out = best_records(spark.createDataFrame(data, schema).withColumn("s", F.lit("clash"))).collect()
    assert len(out) == 1
    got = out[0].asDict()
    assert (got["survivor_id"], got["extracted_id"], got["confidence_id"]) == ("b", "a", "b")
    assert (got["verification_state"], got["extracted_at_ms"], got["confidence"], str(got["confidence"])) == ("verified", T + 5, 0.0, "0.0")
    assert (got["connector"], got["endpoint"], got["source_field"], got["original_representation"]) == ("z", "e2", "name", "mid")
    assert "model_name" not in got and "text_span_start" not in got  # without all its columns a unit is left out
    whole = best_records(spark.createDataFrame(data, schema), (("model_provider", "model_name"),)).first()
    assert (whole["model_provider"], whole["model_name"]) == ("p3", "m3")  # together, not m2 of the survivor
    none = best_records(spark.createDataFrame([rec("a", "?", None, None), rec("b", "?", -1, 2.0)], SCHEMA)).first()
    assert (none["extracted_at_ms"], none["confidence"], none["verification_state"]) == (None, None, "not_reviewed")
