import json

import pytest

from deponent.operators.gateway import Interpreter, interpret, read_output
from deponent.operators.ingest import create_cases
from deponent.sources.tables import read_tsv
from tests.conftest import rows

GOOD = {"subject_key": "document", "predicate": "p", "original_value": "x", "normalized_value": {"knowledge": "known", "value": {"type": "text", "value": "x"}}}


def out(*claims, **more):
    return json.dumps({"claims": list(claims), **more})


@pytest.mark.parametrize(
    "output, kind",
    [
        (out(GOOD), None),
        (out(), None),
        (out(GOOD | {"text_span_start": 3, "text_span_end": 4}), None),
        (out(GOOD | {"more": 1}), "malformed_output"),
        (out(GOOD, more=1), "malformed_output"),
        (out({k: v for k, v in GOOD.items() if k != "predicate"}), "malformed_output"),
        (out(GOOD | {"text_span_start": -1}), "malformed_output"),
        (out(GOOD | {"normalized_value": {"knowledge": "sure"}}), "malformed_output"),
        (out(GOOD | {"predicate": 1}), "malformed_output"),
        ("{", "malformed_output"),
        ("[]", "malformed_output"),
        (None, "malformed_output"),
        (out(GOOD | {"predicate": "  "}), "validation_rejected"),
        (out(GOOD | {"text_span_start": 4, "text_span_end": 3}), "validation_rejected"),
    ],
)
def test_output(output, kind):
    assert read_output(output)[1] == kind


def call(texts):
    if any(t == "boom" for t in texts):
        raise RuntimeError("secret")
    return [json.dumps({"claims": [GOOD | {"original_value": t}]}) if t else "{" for t in texts]


def test_policy_and_failures(spark):
    texts = spark.createDataFrame([("a", "hi"), ("b", "")], "text_id string, text string").coalesce(1)
    local, remote = Interpreter("own", "m", "1", True, call), Interpreter("far", "m", "1", False, call)
    claims, failed = interpret(texts, local, "local_only")
    assert rows(claims, "text_id", "original_value") == [("a", "hi")] and rows(failed) == [("b", "own", "m", "malformed_output")]
    for interpreter, policy, kind in ((None, "local_only", "disabled"), (local, "disabled", "policy_denied"), (remote, "local_only", "policy_denied")):
        claims, failed = interpret(texts, interpreter, policy)
        assert claims.count() == 0 and {r["kind"] for r in failed.collect()} == {kind}
    assert interpret(texts, remote, "allow_listed_remote")[0].count() == 1
    broken = spark.createDataFrame([("a", "boom")], "text_id string, text string")
    assert rows(interpret(broken, local, "local_only")[1], "kind") == [("provider_unavailable",)]
    with pytest.raises(ValueError):
        interpret(texts, local, "anything")


def test_cases(spark):
    made = create_cases(spark.createDataFrame([("Lease", "me"), ("", "me"), ("x" * 301, "me"), ("a\tb", "me")], "title string, actor string"), 5)
    assert rows(made["cases"], "title", "status", "created_at_ms") == [("Lease", "open", 5)] and rows(made["refused"], "reason") == [("invalid_input",)] * 3
    event = made["audit_events"].first()
    assert (event["operation"], event["target_id"], event["case_id"], event["actor"]) == ("case.create", *[made["cases"].first()["id"]] * 2, "me")


def test_tsv(spark, tmp_path):
    f = tmp_path / "t.tsv"
    f.write_text("id\tname\n1\tAnn\n2\n3\t Bo\n\n4\t\n")
    good, bad = read_tsv(spark, str(f), ["id", "name"])
    assert rows(good) == [("1", "Ann")] and bad.count() == 3
    with pytest.raises(ValueError):
        read_tsv(spark, str(f), ["id"])
