import random

import pytest
from pyspark.sql import functions as F

from deponent.operators import answers, checks, claims, ingest, rules, state
from deponent.operators.prefix import prefix_sum
from tests.conftest import rows


def known(x):
    return f'{{"knowledge":"known","value":{{"type":"integer","value":{x}}}}}'


LOG = "claim_id bigint, state string, changed_at_ms bigint, id string"
CLAIM = "claim_id bigint, case_id string, subject_key string, predicate string, normalized_value string, initial_state string"


def frame(spark, data):
    return spark.createDataFrame([(i, "c", s, p, v if v is None or v.startswith("{") else known(v), "extracted") for i, s, p, v in data], CLAIM)


def test_prefix_sum_at_any_skew(spark):
    r = random.Random(1)
    data = [("hot" if r.random() < 0.7 else f"k{r.randrange(30)}", i, r.choice([None, 1, -2, 5])) for i in range(2000)]
    got = prefix_sum(spark.createDataFrame(data, "k string, n int, v int"), ["k"], ["n"], F.col("v"), "before", chunks=7)
    run, want = {}, {}
    for k, n, v in data:
        want[n] = run.get(k, 0)
        run[k] = want[n] + (v or 0)
    assert {x["n"]: x["before"] for x in got.collect()} == want
    assert prefix_sum(spark.createDataFrame([], "k string, n int, v int"), ["k"], ["n"], F.col("v"), "before").count() == 0


def test_classes_and_links(spark):
    c = frame(spark, [(1, "s", "p", "5"), (2, "s", "p", "5"), (3, "s", "p", "6"), (4, "s", "q", "5"), (5, "s", "p", '{"knowledge":"unknown"}'), (6, "s", "p", None), (7, "s", "p", '{"knowledge":"known"')])
    assert rows(claims.value_classes(c), "class_id", "members") == [(1, 2), (3, 1), (4, 1)]
    assert rows(claims.claim_links(c)) == [(1, 1, 1, 1), (2, 1, 1, 1), (3, 3, 0, 2), (4, 4, 0, 0)]
    assert rows(claims.contradictions(c), "class_a", "class_b") == [(1, 3)]
    assert rows(claims.conflict_groups(c), "predicate", "verdict") == [("p", "conflicting"), ("q", "claimed")]
    assert claims.claim_links(frame(spark, [])).count() == claims.contradictions(frame(spark, [])).count() == 0


def test_links_at_the_time_of_recording(spark):
    r = random.Random(4)
    data = [(i, "s", r.choice("pq"), str(r.randrange(3))) for i in range(1, 200)]
    ends = {i: i + r.randrange(1, 60) for i in range(1, 200) if r.random() < 0.3}
    want = []
    for i, _, p, v in data:
        prior = [(w, j) for j, _, q, w in data if j < i and q == p and not (j in ends and ends[j] <= i)]
        want.append((i, sum(w == v for w, _ in prior), sum(w != v for w, _ in prior)))
    got = claims.links_when_recorded(frame(spark, data).withColumn("seq", F.col("claim_id")), spark.createDataFrame(list(ends.items()), "claim_id bigint, seq bigint"))
    assert rows(got, "claim_id", "n_corroborates", "n_contradicts") == sorted(want, key=repr)


def test_incremental_links_lose_nothing(spark):
    old, new = frame(spark, [(1, "s", "p", "5"), (2, "s", "p", "5"), (3, "s", "p", "6")]), frame(spark, [(9, "s", "p", "5"), (10, "t", "p", "5")])
    log = spark.createDataFrame([(2, "rejected", 1, "x")], LOG)
    assert rows(claims.incremental_links(new, old, log.limit(0))) == [(9, 1, 2, "corroborates"), (9, 3, 1, "contradicts")]
    assert rows(claims.incremental_links(new, old, log)) == [(9, 1, 1, "corroborates"), (9, 3, 1, "contradicts")]
    more = new.unionByName(frame(spark, [(11, "t", "p", "7")]))  # new claims meet each other, too
    assert rows(claims.incremental_links(more, old, log)) == [(10, 11, 1, "contradicts"), (11, 10, 1, "contradicts"), (9, 1, 1, "corroborates"), (9, 3, 1, "contradicts")]


def one_by_one(batches, reviews):
    """Last states after recording claim after claim, with each batch's reviews after it."""
    states, moments, seen = {}, {}, []
    for batch, judged in zip(batches, reviews):
        for i, s, p, v, at in sorted(batch, key=lambda c: (c[4], c[0])):
            for j, s2, p2, v2 in seen:
                if (s, p) == (s2, p2) and v != v2 and states.get(j) not in ("rejected", "superseded") and v.isdigit() and v2.isdigit():
                    states[i] = states[j] = "contradicted"
                    moments[i] = moments[j] = at
            seen.append((i, s, p, v))
        states |= judged
    return states, moments


def test_contradictions_change_states(spark):
    r = random.Random(8)
    ids = iter(range(1, 10_000))
    make = lambda n, lo: [(next(ids), r.choice("st"), r.choice("pqr"), r.choice(["5", "6", "7", '{"knowledge":"unknown"}']), lo + r.randrange(50)) for _ in range(n)]
    batches = [make(30, 100), make(12, 200), make(6, 300)]
    batches[2].append((next(ids), "z", "z", "5", 310))
    reviews = [{c[0]: r.choice(["verified", "rejected"]) for c in b if r.random() < 0.5} for b in batches]
    want, moments = one_by_one(batches, reviews)
    columns = ["id", "claim_id", "state", "changed_at_ms"]
    log, prior = None, None
    for batch, judged, at in zip(batches, reviews, (199, 299, 999)):
        new = frame(spark, [c[:4] for c in batch]).join(spark.createDataFrame([(c[0], c[4]) for c in batch], "claim_id bigint, created_at_ms bigint"), "claim_id")
        made = claims.record_conflicts(new.unionByName(new), prior, log)
        changes = made["claim_state_changes"].select(*columns).unionByName(spark.createDataFrame([(f"r{i}", i, s, at) for i, s in judged.items()], "id string, claim_id bigint, state string, changed_at_ms bigint"))
        log = changes if log is None else log.unionByName(changes)
        log = spark.createDataFrame(log.collect(), log.schema)
        prior = new if prior is None else prior.unionByName(new)
        prior = spark.createDataFrame(prior.collect(), prior.schema)
    assert {x["claim_id"]: x["state"] for x in state.latest_state(log).collect()} == want
    last = {x["claim_id"]: x["m"] for x in log.where("state = 'contradicted'").groupBy("claim_id").agg(F.max("changed_at_ms").alias("m")).collect()}
    assert last == moments


def test_edges_join_classes(spark):
    at = F.lit(1).cast("bigint")
    prior = frame(spark, [(1, "s", "p", "5"), (2, "s", "p", "5"), (3, "s", "p", "6"), (4, "s", "q", "1")]).withColumn("created_at_ms", at)
    new = frame(spark, [(9, "s", "p", "5"), (10, "s", "q", "2"), (11, "s", "q", "2")]).withColumn("created_at_ms", at + 1)
    made = claims.record_conflicts(new, prior)
    assert rows(made["evidence_edges"], "from_id", "relationship", "to_id") == [("1", "contradicts", "3"), ("10", "contradicts", "4"), ("11", "corroborates", "10"), ("3", "contradicts", "1"), ("4", "contradicts", "10"), ("9", "corroborates", "1")]
    assert rows(made["contradictions"], "class_a", "class_b", "created_at_ms") == [(1, 3, 1), (4, 10, 2)]
    assert rows(made["claim_state_changes"], "claim_id", "changed_at_ms") == [(10, 2), (11, 2), (3, 2), (4, 2), (9, 2)]
    empty = claims.record_conflicts(new.limit(0), prior.limit(0))
    assert all(t.count() == 0 for t in empty.values())


def test_dispositions(spark):
    d = spark.createDataFrame([("c", "k", x, i) for i, x in enumerate("AABAC")] + [("c", "l", "A", 9)], "case_id string, source_key string, content_sha256 string, seq bigint")
    got = rows(ingest.dispositions(d), "source_key", "seq", "version_number", "disposition")
    assert got == [("k", 0, 1, "new_artifact"), ("k", 1, 1, "exact_duplicate"), ("k", 2, 2, "new_version"), ("k", 3, 1, "exact_duplicate"), ("k", 4, 3, "new_version"), ("l", 9, 1, "new_artifact")]
    old = spark.createDataFrame([("c", "k", "B", 1), ("c", "k", "Z", 2)], "case_id string, source_key string, content_sha256 string, version_number int")
    got = rows(ingest.dispositions(d, old), "source_key", "seq", "version_number", "disposition")
    assert got == [("k", 0, 3, "new_version"), ("k", 1, 3, "exact_duplicate"), ("k", 2, 1, "exact_duplicate"), ("k", 3, 3, "exact_duplicate"), ("k", 4, 4, "new_version"), ("l", 9, 1, "new_artifact")]


def test_requests_blobs_and_reads(spark):
    schema = "source_key string, connector string, locator string, media_type string, original_filename string, content binary"
    df = spark.createDataFrame([("k", "api", "l", "text/plain", "a.txt", bytearray(b"x")), ("k", "api", "l", "text/plain", "../a", bytearray(b"x")), ("", "api", "l", "text/plain", None, bytearray(b"x")), ("k", "api", "l", "text/plain", None, bytearray(b"x" * 11))], schema)
    good, bad = ingest.check_requests(df, max_bytes=10)
    assert good.count() == 1 and rows(bad, "reason") == [("invalid_input",), ("invalid_input",), ("too_large",)]
    bounds = [("k" * n, "c" * c, "l" * n, "m" * m, "f" * f, bytearray(b"x")) for n, c, m, f in ((2048, 100, 255, 255), (2049, 100, 255, 255), (2048, 101, 255, 255), (2048, 100, 256, 255), (2048, 100, 255, 256))]
    good, bad = ingest.check_requests(spark.createDataFrame(bounds, schema).withColumn("case_id", F.lit("c")), spark.createDataFrame([("c",), (None,)], "id string"))
    assert good.count() == 1 and rows(bad, "reason") == [("invalid_input",)] * 4
    there = df.limit(1).withColumn("case_id", F.lit("none"))
    assert rows(ingest.check_requests(there, spark.createDataFrame([("c",)], "id string"))[1], "reason") == [("not_found",)]
    stored = ingest.blobs(spark.createDataFrame([("x",), ("x",), ("é",)], "content string"))
    assert rows(stored, "content_length") == [(1,), (2,)]
    broken = stored.withColumn("content", F.when(F.col("content") == "x", "y").otherwise(F.col("content")))
    ok, corrupt = ingest.verified_read(broken)
    assert rows(ok, "content") == [("é",)] and rows(corrupt, "content") == [("y",)]


def test_sources_without_revision_never_collide(spark):
    s = "id string, case_id string, connector string, locator string, source_revision string"
    new = spark.createDataFrame([("1", "c", "api", "l", None), ("2", "c", "api", "l", None), ("3", "c", "api", "l", "r"), ("4", "c", "api", "l", "r"), ("5", "c", "api", "l", "q")], s)
    old = spark.createDataFrame([("0", "c", "api", "l", None), ("9", "c", "api", "l", "q")], s)
    assert rows(ingest.upsert_sources(new, old), "id") == [("1",), ("2",), ("3",)]


def test_states(spark):
    c = frame(spark, [(1, "s", "p", "5"), (2, "s", "p", "6"), (3, "s", "p", "7")])
    log = spark.createDataFrame([(1, "verified", 5, "a"), (1, "contradicted", 5, "b"), (2, "rejected", 4, "x"), (2, "extracted", 3, "y")], "claim_id bigint, state string, changed_at_ms bigint, id string")
    assert rows(state.current_claims(c, log), "claim_id", "current_state") == [(1, "contradicted"), (2, "rejected"), (3, "extracted")]
    assert rows(state.active_claims(c, log), "claim_id") == [(1,), (3,)]


def test_reviews(spark):
    c = frame(spark, [(1, "s", "p", "5"), (2, "s", "p", "6"), (3, "s", "p", "7")])
    d = spark.createDataFrame([(1, "verified", "a", 10), (1, "verified", "a", 11), (2, "corrected", "a", 1), (3, "needs_more_evidence", "a", 1), (9, "verified", "a", 1)], "claim_id bigint, decision string, actor string, decided_at_ms bigint")
    out = state.review(d, c)
    assert rows(out["claim_state_changes"], "claim_id", "state") == [(1, "verified"), (3, "unresolved")]
    assert rows(out["facts"], "claim_id", "established_value") == [(1, known(5))]
    assert rows(out["refused"], "claim_id", "refusal") == [(1, "conflict"), (2, "invalid_input"), (9, "not_found")]
    assert rows(out["human_reviews"], "target_id", "decision", "rationale") == [("1", "verified", None), ("3", "needs_more_evidence", None)] and out["audit_events"].count() == 2
    nobody = state.review(d.withColumns({"actor": F.lit(" "), "rationale": F.lit("why")}), c)
    assert nobody["human_reviews"].count() == 0 and rows(nobody["refused"], "refusal")[-1] == ("not_found",)
    again = state.review(d, c, out["facts"])
    assert again["facts"].count() == 0 and again["refused"].where("refusal = 'conflict'").count() == 2


def test_corrections(spark):
    c = frame(spark, [(1, "s", "p", "5"), (2, "s", "p", "6")])
    edges = spark.createDataFrame([("1", "supported_by", "e1"), ("2", "supported_by", "e2"), ("1", "contradicts", "e3")], "from_id string, relationship string, to_id string").withColumn("from_id", F.col("from_id").cast("bigint"))
    rests = spark.createDataFrame([("e1", "v1"), ("e1", "v1"), ("e2", "v2"), ("e3", "v3")], "evidence_id string, evaluation_id string")
    fix = spark.createDataFrame([(1, "8", known(8), "me", 7)], "claim_id bigint, corrected_text string, corrected_value string, actor string, corrected_at_ms bigint")
    out = state.correct(fix, c, edges, rests)
    assert rows(out["claims"], "subject_key", "normalized_value", "origin", "initial_state") == [("s", known(8), "human", "verified")]
    assert rows(out["claim_state_changes"], "state") == [("superseded",), ("verified",)]
    assert rows(out["affected"]) == [(1, "v1")]
    assert rows(out["corrections"], "original_claim_id", "original_value", "corrected_value") == [("1", known(5), known(8))]
    made = {k: out[k].first() for k in ("corrections", "claims", "human_reviews", "provenance_records")}
    assert made["corrections"]["corrected_claim_id"] == made["claims"]["claim_id"] and made["corrections"]["review_id"] == made["human_reviews"]["id"]
    assert made["corrections"]["provenance_id"] == made["claims"]["provenance_id"] == made["provenance_records"]["id"]
    assert (made["provenance_records"]["extraction_method"], made["provenance_records"]["extractor_version"], made["human_reviews"]["decision"]) == ("human_correction", "human", "corrected")
    bad = spark.createDataFrame([(1, "", known(8), "me", 7), (9, "8", known(8), "me", 7), (2, "8", known(8), "", 7)], fix.schema)
    refused = state.correct(bad, c, edges, rests)
    assert rows(refused["refused"]) == [(1, "invalid_input"), (2, "invalid_input"), (9, "not_found")] and refused["claims"].count() == 0


def test_corrections_meet_their_claims_once(spark):
    c = frame(spark, [(i, "s", "p", str(i)) for i in range(9)])
    edges = c.select(F.col("claim_id").alias("from_id"), F.lit("supported_by").alias("relationship"), F.col("normalized_value").alias("to_id"))
    rests = c.select(F.col("normalized_value").alias("evidence_id"), F.lit("v").alias("evaluation_id"))
    fix = spark.range(5, 12).select(F.col("id").alias("claim_id"), F.lit("8").alias("corrected_text"), F.lit(known(8)).alias("corrected_value"), F.lit("me").alias("actor"), F.lit(7).cast("bigint").alias("corrected_at_ms"))
    for kind, df in state.correct(fix, c, edges, rests).items():
        assert len(df.collect()) == {"claim_state_changes": 8, "refused": 3}.get(kind, 4)
        plan = df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
        assert "Broadcast" not in plan and plan.count("SortMergeJoin") == (2 if kind == "affected" else 0)
        assert kind == "affected" or "Exchange" not in plan


TRUE = '{"knowledge":"known","value":{"type":"boolean","value":true}}'
FALSE = TRUE.replace("true", "false")


def day(d):
    return f'{{"knowledge":"known","value":{{"type":"date","value":{{"year":2026,"month":8,"day":{d}}}}}}}'


RULE = {"rule_id": "r", "conditions": [("document", "response_required", TRUE), ("document", "active", TRUE)], "anchor_predicate": "received_date", "days_after": 10}


@pytest.mark.parametrize(
    "given, result, words, due",
    [
        ([("response_required", TRUE), ("active", TRUE), ("received_date", day(12))], "satisfied", "All conditions", "2026-08-22"),
        ([("response_required", TRUE), ("active", FALSE), ("received_date", day(12))], "not_satisfied", "not satisfied: active.", None),
        ([("received_date", day(12))], "indeterminate", "missing: response_required, active.", None),
        ([("response_required", TRUE), ("active", TRUE)], "indeterminate", "(received_date) is missing", None),
        ([("response_required", TRUE), ("response_required", FALSE), ("received_date", day(12))], "indeterminate", "disagree", None),
        ([("response_required", TRUE), ("active", TRUE), ("received_date", day(12)), ("received_date", day(13))], "indeterminate", "disagree", None),
    ],
)
def test_rules(spark, given, result, words, due):
    v = spark.createDataFrame([(f"k{i}", "c", "document", p, j) for i, (p, j) in enumerate(given)], "claim_id string, case_id string, subject_key string, predicate string, normalized_value string")
    got = rules.evaluate(v, v, [RULE]).first()
    assert got["result"] == result and words in got["explanation"] and (got["due_date"] and str(got["due_date"])) == due and got["n_inputs"] == len(given)


def test_evaluations_are_remembered_by_their_inputs(spark):
    v = spark.createDataFrame([("a", "c", "document", "active", TRUE), ("b", "d", "document", "active", TRUE)], "claim_id string, case_id string, subject_key string, predicate string, normalized_value string")
    first = rules.new_evaluations(rules.evaluate(v, v, [RULE]), spark.createDataFrame([], "case_id string, rule_id string, inputs_sha256 string"))
    assert first.select("evaluation_id").distinct().count() == 2
    assert rules.new_evaluations(rules.evaluate(v, v, [RULE]), first).count() == 0
    more = v.unionByName(v.where("case_id = 'c'").withColumn("claim_id", F.lit("z")))
    assert rows(rules.new_evaluations(rules.evaluate(more, more, [RULE]), first), "case_id") == [("c",)]
    evidence = lambda *ids: v.withColumn("evidence_ids", F.array(*map(F.lit, ids)))
    seen = {rules.evaluate(v, x, [RULE]).where("case_id = 'c'").first()["inputs_sha256"] for x in (v, evidence("e1"), evidence("e1", "e2"), evidence("e2", "e1"), v.withColumn("normalized_value", F.lit(FALSE)))}
    assert len(seen) == 4  # evidence and values count, their order doesn't
    evaluated = rules.with_ids(rules.evaluate(v, evidence("e1", "e2"), [RULE]))
    assert rows(rules.evaluation_evidence(evaluated, rules.inputs(evidence("e1", "e2"), [RULE])), "evidence_id") == [("e1",), ("e1",), ("e2",), ("e2",)]


def test_rules_against_brute_force(spark):
    r = random.Random(6)
    dates = [day(d) for d in (1, 2)]
    data = [(f"k{i}", f"c{r.randrange(12)}", r.choice(["document", "x"]), r.choice("pqrs"), r.choice([TRUE, FALSE, dates[0], dates[1], None])) for i in range(160)]
    declared = [{"rule_id": f"r{n}", "conditions": [(r.choice(["document", "x"]), r.choice("pqrs"), r.choice([TRUE, FALSE, dates[0]])) for _ in range(r.choice([1, 2, 3, 32]))], "anchor_predicate": r.choice("pqrst"), "days_after": n} for n in range(9)]
    v = spark.createDataFrame(data, "claim_id string, case_id string, subject_key string, predicate string, normalized_value string")
    cases = spark.createDataFrame([(f"c{i}",) for i in range(14)] * 2, "case_id string")
    want = []
    for case in (f"c{i}" for i in range(14)):
        own = [x for x in data if x[1] == case]
        for rule in declared:
            missing, failed, split, used = [], [], False, {x[0] for x in own if x[3] == rule["anchor_predicate"]}
            for s, p, e in rule["conditions"]:
                met = [x for x in own if x[2:4] == (s, p)]
                hits = sum(x[4] == e for x in met)
                used |= {x[0] for x in met}
                missing += [p] * (not met)
                failed += [p] * bool(met and not hits)
                split |= 0 < hits < len(met)
            anchors = {x[4] for x in own if x[3] == rule["anchor_predicate"] and x[4] in dates}
            if split or len(anchors) > 1:
                got = ("indeterminate", rules.DISAGREE)
            elif missing:
                got = ("indeterminate", rules.MISSING.format(", ".join(missing)))
            elif failed:
                got = ("not_satisfied", rules.FAILED.format(", ".join(failed)))
            else:
                got = ("satisfied", rules.SATISFIED) if anchors else ("indeterminate", rules.NO_ANCHOR.format(rule["anchor_predicate"]))
            want.append((case, rule["rule_id"], *got, len(used)))
    found = rules.evaluate(cases, v, declared)
    assert rows(found, "case_id", "rule_id", "result", "explanation", "n_inputs") == sorted(want, key=repr)
    asked = spark.createDataFrame([("c1", "r3"), ("c99", "r1"), ("c1", "none")], "case_id string, rule_id string")
    assert rows(rules.evaluate(asked, v, declared), "case_id", "rule_id") == [("c1", "r3"), ("c99", "r1")]
    assert rules.evaluate(cases, v, []).count() == rules.evaluate(cases.limit(0), v, declared).count() == 0


def test_registration(spark):
    base = {**RULE, "package_id": "p", "stable_key": "k", "title": "T", "version": 1, "task_title": "t" * 500}
    made = rules.register(spark, [base, {**base, "version": 2}, base, {**base, "days_after": 3}, {**base, "stable_key": "l", "task_title": "t" * 501}, {**base, "stable_key": "m", "conditions": [("s", "p" * 301, TRUE)]}], 5, "me")
    assert made["rules"].count() == 1 and rows(made["rule_versions"], "version") == [(1,), (2,)] and rows(made["audit_events"], "operation") == [("rule.register",)] * 2
    assert rows(made["refused"]) == [("k", 1, "conflict"), ("l", 1, "invalid_input"), ("m", 1, "invalid_input")]
    again = rules.register(spark, [base], 9, "me")
    assert again["rule_versions"].first()["id"] in {x["id"] for x in made["rule_versions"].collect()}


def test_rule_bounds():
    with pytest.raises(ValueError):
        rules.checked_rules([{**RULE, "conditions": []}])
    with pytest.raises(ValueError):
        rules.checked_rules([{**RULE, "conditions": RULE["conditions"] * 17}])


@pytest.mark.parametrize(
    "states, values, mode",
    [(["verified"], ["5"], "established"), (["extracted"], ["5"], "claimed"), (["verified", "inferred"], ["5", "5"], "suggested"), (["corroborated"], ["5"], "suggested"), (["verified", "rejected"], ["5", "6"], "conflicting")],
)
def test_answer_modes(spark, states, values, mode):
    c = spark.createDataFrame([(i, "c", "Amount", known(v), s) for i, (s, v) in enumerate(zip(states, values))], "claim_id int, case_id string, predicate string, normalized_value string, current_state string")
    q = spark.createDataFrame([("q", "c", "What AMOUNTs?"), ("u", "c", "What colour?"), ("o", "other", "amount")], "question_id string, case_id string, question string")
    got = {r["question_id"]: r for r in answers.answers(q, c).collect()}
    assert got["q"]["mode"] == mode and got["q"]["n_claims"] == len(states)
    assert got["u"]["mode"] == got["o"]["mode"] == "unknown"


def test_what_is_due(spark):
    q = spark.createDataFrame([("a", "c", "What MUST we do?"), ("b", "d", "deadline?"), ("x", "c", "amount?"), ("n", "c", None)], "question_id string, case_id string, question string")
    e = spark.createDataFrame([("c", "r", "e1", "satisfied", "Old", "2026-08-22", 4, 1), ("c", "r2", "e2", "satisfied", "New", None, 3, 2), ("c", "r", "e3", "not_satisfied", "No", None, 9, 3)], "case_id string, rule_id string, evaluation_id string, result string, title string, due_date string, n_inputs bigint, evaluated_at_ms bigint")
    assert rows(answers.due_answers(q, e), "question_id", "mode", "statement", "evaluation_id") == [
        ("a", "established", "New is required by a satisfied rule evaluation and is due an unresolved date.", "e2"),
        ("b", "unknown", answers.STATEMENTS["unknown"], None),
    ]
    c = spark.createDataFrame([(1, "c", "rent", known(5), "verified", "p", ["e9"])], "claim_id bigint, case_id string, predicate string, normalized_value string, current_state string, provenance_id string, evidence_ids array<string>")
    q = q.unionByName(spark.createDataFrame([("r", "c", "What is the rent?"), ("d", "c", "What is the deadline of rent?"), ("e", "e", "What is the deadline of rent?")], q.schema))
    assert rows(answers.query(q, c, e), "question_id", "mode", "n_claims", "evaluation_id") == [("a", "established", 3, "e2"), ("b", "unknown", 0, None), ("d", "established", 3, "e2"), ("e", "unknown", 0, None), ("n", "unknown", 0, None), ("r", "established", 1, None), ("x", "unknown", 0, None)]
    used = spark.createDataFrame([("c", "r2", "7", ["e7"]), ("c", "r", "8", ["e8"])], "case_id string, rule_id string, claim_id string, evidence_ids array<string>")
    assert rows(answers.citations(q, c, e, used)) == [("a", "7", None, ["e7"]), ("d", "7", None, ["e7"]), ("r", "1", "p", ["e9"])]


def test_citations_and_evidence(spark):
    c = frame(spark, [(1, "s", "amount", "5"), (2, "s", "other", "6")])
    edges = spark.createDataFrame([(1, "supported_by", "e2"), (1, "supported_by", "e1")], "from_id bigint, relationship string, to_id string")
    log = spark.createDataFrame([], "claim_id bigint, state string, changed_at_ms bigint, id string")
    g = answers.grounded_claims(c, log, edges).withColumn("provenance_id", F.lit("p"))
    assert rows(g, "claim_id", "evidence_ids") == [(1, ["e1", "e2"]), (2, [])]
    q = spark.createDataFrame([("q", "c", "the amount?")], "question_id string, case_id string, question string")
    assert rows(answers.citations(q, g)) == [("q", "1", "p", ["e1", "e2"])]


def test_checks(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None), (3, "z"), (3, "z")], "id int, k string"), spark.createDataFrame([("x",), (None,)], "k string")
    assert rows(checks.violations({"orphans": checks.orphans(a, "k", b, "k"), "twice": checks.duplicates(a, ["id"])})) == [("orphans", 2), ("twice", 1)]
    assert rows(checks.failing(a, {"k": F.col("k") == "x", "id": F.col("id") < 3}).select("errors")) == [(["k", "id"],), (["k", "id"],), (["k"],), ([],)]
    there, absent = checks.split_existing(a, "k", b, "k")
    assert rows(there, "id") == [(1,)] and absent.count() == 3


def test_predicates_of_provenance(spark):
    from deponent.functions import values as V

    data = [("a" * 64, 1, 2, "p", "m", None, 0), (None, None, 2, None, None, None, None), ("A" * 64, 2, 1, None, None, "{}", -1), ("a" * 64 + "\n", 3, 3, None, "m", None, 5)]
    df = spark.createDataFrame(data, "sha string, a bigint, b bigint, provider string, name string, config string, at bigint")
    ok = {"sha": V.valid_sha256(F.col("sha")), "span": V.valid_span(F.col("a"), F.col("b")), "model": V.valid_model(*(F.col(c) for c in ("provider", "name", "config"))), "time": V.valid_time(F.col("at"))}
    assert [r[0] for r in checks.failing(df, ok).select("errors").collect()] == [[], ["sha"], ["sha", "span", "model", "time"], ["sha", "model"]]
