"""Queries of ingestion, extraction, claim states, rules and answers, and their SQL.

Claims are recorded in two batches, those before a moment and the later ones; each batch is compared
with itself and with the active claims before it, and reviewed after it is recorded.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deponent.functions import values as V
from deponent.operators import answers as A
from deponent.operators import claims, ingest, rules, state
from deponent.operators.pipeline import ingest_claims
from deponent.plans.evidence import _CUT, _SQL_CLAIMS, _claims, _state_log
from deponent.session import materialize, scratch_path
from deponent.sources import scans
from deponent.sources.ledger import Ledger
from deponent.sources.tables import table

_END = 9_000_000_000_000


def _recorded(c: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The state log of recording and reviewing the claims ``c`` in two batches, and what the second
    batch's recording makes."""
    late = F.coalesce("created_at_ms", F.lit(0)) >= _CUT
    first = c.where(~late)
    second = c.where(late).withColumn("created_at_ms", F.col("created_at_ms") + 1)  # after the first review
    reviews = lambda batch, at: _state_log(batch).withColumn("changed_at_ms", F.lit(at))
    columns = ["id", "claim_id", "state", "changed_at_ms"]
    log = claims.record_conflicts(first)["claim_state_changes"].select(*columns).unionByName(reviews(first, _CUT).select(*columns))
    log = materialize(log, "first-states")
    made = claims.record_conflicts(second, first, log)
    return log.unionByName(made["claim_state_changes"].select(*columns)).unionByName(reviews(second, _END).select(*columns)), made


def _written(spark: SparkSession, d: str) -> DataFrame:
    return materialize(_claims(spark, d).select("claim_id", "case_id", "subject_key", "predicate", "normalized_value", "created_at_ms", "confidence", "artifact_version_id", "initial_state"), "claims")


_SQL_STATES = f"""
{_SQL_CLAIMS},
t AS (SELECT * EXCLUDE (state), coalesce(created_at_ms, 0) < {_CUT} AS early, coalesce(confidence < 0.3, false) AS low, coalesce(confidence >= 0.8, false) AS sure FROM claims),
k AS (SELECT * FROM t WHERE knowledge = 'known'),
v AS (SELECT case_id, subject_key, predicate, normalized_value, count(*) FILTER (early) AS own_early, count(*) FILTER (early AND NOT low) AS own_active, count(*) FILTER (NOT early) AS own_late FROM k GROUP BY ALL),
g AS (SELECT case_id, subject_key, predicate, sum(own_early) AS e, sum(own_active) AS a, sum(own_late) AS l FROM v GROUP BY ALL),
o AS (SELECT v.*, e - own_early AS other_early, a - own_active AS other_active, l - own_late AS other_late FROM v JOIN g USING (case_id, subject_key, predicate)),
final AS (SELECT t.claim_id, t.case_id, t.subject_key, t.predicate, t.normalized_value, t.knowledge, t.artifact_version_id, CASE
    WHEN early AND NOT low AND knowledge = 'known' AND other_late > 0 THEN 'contradicted'
    WHEN sure THEN 'verified' WHEN low THEN 'rejected'
    WHEN knowledge = 'known' AND early AND other_early > 0 THEN 'contradicted'
    WHEN knowledge = 'known' AND NOT early AND other_late + other_active > 0 THEN 'contradicted' ELSE 'extracted' END AS current_state
  FROM t LEFT JOIN o ON t.knowledge = 'known' AND t.case_id = o.case_id AND t.subject_key = o.subject_key AND t.predicate = o.predicate AND t.normalized_value = o.normalized_value),
edges AS (SELECT claim_id, 'evidence_' || claim_id AS evidence_id FROM claims UNION ALL SELECT claim_id, 'shared_' || (claim_id // 50) FROM claims WHERE claim_id % 3 = 0)
"""


def q_contradicted_states(spark: SparkSession, d: str) -> DataFrame:
    """The state of each claim after both batches and their reviews."""
    c = _written(spark, d)
    return state.current_claims(c, _recorded(c)[0]).select("claim_id", "current_state")


def q_links_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges that recording the second batch makes: each new claim to its class, classes to each other."""
    return _recorded(_written(spark, d))[1]["evidence_edges"].select("from_id", "relationship", "to_id")


_EDGES = f"""
WITH {_SQL_STATES},
m AS (SELECT * FROM k WHERE NOT early OR NOT low),
c AS (SELECT case_id, subject_key, predicate, normalized_value, min(claim_id) AS class_id, bool_or(NOT early) AS met FROM m GROUP BY ALL)
SELECT CAST(m.claim_id AS varchar) AS from_id, 'corroborates' AS relationship, CAST(class_id AS varchar) AS to_id FROM m JOIN c USING (case_id, subject_key, predicate, normalized_value) WHERE NOT early AND claim_id <> class_id
UNION ALL SELECT CAST(a.class_id AS varchar), 'contradicts', CAST(b.class_id AS varchar) FROM c a JOIN c b USING (case_id, subject_key, predicate) WHERE a.class_id <> b.class_id AND (a.met OR b.met)
"""


def _evidence() -> Column:
    """Each claim's own evidence, of every third claim also evidence that fifty ids share."""
    return F.explode(F.array_compact(F.array(F.concat(F.lit("evidence_"), "claim_id"), F.when(F.col("claim_id") % 3 == 0, F.concat(F.lit("shared_"), F.floor(F.col("claim_id") / 50))))))


def _edges(c: DataFrame) -> DataFrame:
    return c.select(F.col("claim_id").alias("from_id"), F.lit("supported_by").alias("relationship"), _evidence().alias("to_id"))


def q_review_outcome(spark: SparkSession, d: str) -> DataFrame:
    """All rows that reviews make: every claim with a confidence is reviewed, those of 0.95 and more a
    second time, as are ids that no claim has."""
    c = _claims(spark, d)
    picked = F.when(F.col("confidence") >= 0.8, "verified").when(F.col("confidence") < 0.3, "rejected").when(F.col("confidence") < 0.35, "corrected").when(F.col("confidence").isNotNull(), "needs_more_evidence")
    asked = c.select("claim_id", "confidence", picked.alias("decision"), F.lit("reviewer").alias("actor"), (F.coalesce("created_at_ms", F.lit(0)) + 1).alias("decided_at_ms")).where("decision is not null")
    again = asked.where("confidence >= 0.95").withColumn("decided_at_ms", F.col("decided_at_ms") + 1)
    absent = asked.where("decision = 'rejected'").withColumn("claim_id", -F.col("claim_id") - 1)
    made = state.review(asked.unionByName(again).unionByName(absent), c)
    out = made["refused"].select(F.lit("refused").alias("kind"), F.col("claim_id").cast("string").alias("claim_id"), F.col("refusal").alias("what"))
    for kind, claim, what in (("human_reviews", "target_id", "decision"), ("claim_state_changes", "claim_id", "state"), ("facts", "claim_id", "established_value"), ("audit_events", "target_id", "operation")):
        out = out.unionByName(made[kind].select(F.lit(kind).alias("kind"), F.col(claim).cast("string").alias("claim_id"), F.col(what).alias("what")))
    return out


_REVIEW = f"""
WITH {_SQL_CLAIMS},
r AS (SELECT claim_id, confidence, normalized_value, CASE WHEN confidence >= 0.8 THEN 'verified' WHEN confidence < 0.3 THEN 'rejected' WHEN confidence < 0.35 THEN 'corrected' ELSE 'needs_more_evidence' END AS decision FROM claims WHERE confidence IS NOT NULL),
done AS (SELECT * FROM r WHERE decision <> 'corrected'),
every AS (
  SELECT 'human_reviews' AS kind, claim_id, decision AS what FROM done
  UNION ALL SELECT 'claim_state_changes', claim_id, CASE decision WHEN 'needs_more_evidence' THEN 'unresolved' ELSE decision END FROM done
  UNION ALL SELECT 'audit_events', claim_id, 'claim.review' FROM done
  UNION ALL SELECT 'facts', claim_id, normalized_value FROM done WHERE decision = 'verified'
  UNION ALL SELECT 'refused', claim_id, 'invalid_input' FROM r WHERE decision = 'corrected'
  UNION ALL SELECT 'refused', claim_id, 'conflict' FROM r WHERE confidence >= 0.95
  UNION ALL SELECT 'refused', -claim_id - 1, 'not_found' FROM r WHERE decision = 'rejected')
SELECT kind, CAST(claim_id AS varchar) AS claim_id, what FROM every
"""


def _rests(c: DataFrame) -> DataFrame:
    """Which evaluation rests on which evidence: one of each case and predicate."""
    return c.select(_evidence().alias("evidence_id"), F.concat_ws("/", "case_id", "predicate").alias("evaluation_id")).distinct()


_SQL_RESTS = "rests AS (SELECT DISTINCT evidence_id, concat_ws('/', case_id, predicate) AS evaluation_id FROM edges JOIN claims USING (claim_id))"


def q_corrections(spark: SparkSession, d: str) -> DataFrame:
    """All rows that corrections make: claims of confidence under 0.3 are corrected, ids that no claim
    has and empty texts are refused."""
    c = materialize(_claims(spark, d).select("claim_id", "case_id", "subject_key", "predicate", "normalized_value", "confidence"), "claims")
    low = c.where("confidence < 0.3")
    fixes = low.select("claim_id", F.when(F.col("claim_id") % 7 == 0, " ").otherwise("none").alias("corrected_text"), F.lit('{"knowledge":"unknown"}').alias("corrected_value"), F.lit("reviewer").alias("actor"), F.lit(7).cast("bigint").alias("corrected_at_ms"))
    absent = fixes.withColumn("claim_id", -F.col("claim_id") - 1)
    made = state.correct(fixes.unionByName(absent), c, _edges(c), _rests(c))
    out = made["refused"].select(F.lit("refused").alias("kind"), F.col("claim_id").cast("string").alias("a"), F.col("refusal").alias("b"))
    shown = {
        "provenance_records": ("id", "verification_state"), "claims": ("claim_id", "predicate"), "human_reviews": ("target_id", "decision"), "corrections": ("original_claim_id", "corrected_claim_id"),
        "claim_state_changes": ("claim_id", "state"), "evidence_edges": ("from_id", "to_id"), "affected": ("claim_id", "evaluation_id"),
    }
    for kind, (a, b) in shown.items():
        out = out.unionByName(made[kind].select(F.lit(kind).alias("kind"), F.col(a).cast("string").alias("a"), F.col(b).alias("b")))
    return out


_CORRECTIONS = f"""
WITH {_SQL_STATES}, {_SQL_RESTS},
x AS (SELECT *, CAST(claim_id AS varchar) AS old, list_transform(['claim', 'provenance'], lambda t: t || '_' || left(sha256(t || chr(0) || 'correction' || chr(0) || claim_id || chr(0) || '7'), 32)) AS made FROM claims WHERE confidence < 0.3 AND claim_id % 7 <> 0),
bad AS (SELECT * FROM claims WHERE confidence < 0.3)
SELECT 'provenance_records' AS kind, made[2] AS a, 'corrected' AS b FROM x
UNION ALL SELECT 'claims', made[1], predicate FROM x
UNION ALL SELECT 'human_reviews', old, 'corrected' FROM x
UNION ALL SELECT 'corrections', old, made[1] FROM x
UNION ALL SELECT 'claim_state_changes', old, 'superseded' FROM x UNION ALL SELECT 'claim_state_changes', made[1], 'verified' FROM x
UNION ALL SELECT 'evidence_edges', made[1], old FROM x
UNION ALL SELECT DISTINCT 'affected', old, evaluation_id FROM x JOIN edges USING (claim_id) JOIN rests USING (evidence_id)
UNION ALL SELECT 'refused', CAST(claim_id AS varchar), 'invalid_input' FROM bad WHERE claim_id % 7 = 0
UNION ALL SELECT 'refused', CAST(-claim_id - 1 AS varchar), CASE WHEN claim_id % 7 = 0 THEN 'invalid_input' ELSE 'not_found' END FROM bad
"""


def q_affected_derivations(spark: SparkSession, d: str) -> DataFrame:
    c = _claims(spark, d)
    return state.affected_derivations(c.where("confidence < 0.3"), _edges(c), _rests(c))


_BOOLEAN = '{{"knowledge":"known","value":{{"type":"boolean","value":{}}}}}'
_TRUE, _FALSE = _BOOLEAN.format("true"), _BOOLEAN.format("false")
_RULES = [
    {"rule_id": "notice", "conditions": [("document", "response_required", _TRUE), ("document", "active", _TRUE)], "anchor_predicate": "received_date", "days_after": 10},
    {"rule_id": "renewal", "conditions": [("document", "renewable", _TRUE), ("document", "response_required", _TRUE)], "anchor_predicate": "due_date", "days_after": 30},
    {"rule_id": "closing", "conditions": [("document", "active", _FALSE)], "anchor_predicate": "effective_from", "days_after": 0},
    {"rule_id": "anchored", "conditions": [("document", "renewable", _TRUE)], "anchor_predicate": "renewable", "days_after": 1},
]


def _documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each subject as a case of its own with one document: all its claims with their current state and
    evidence, and the (case_id) that hold a known claim."""
    c = _written(spark, d)
    grounded = A.grounded_claims(c, _recorded(c)[0], _edges(c))
    as_case = F.concat_ws("/", "case_id", "subject_key")
    docs = materialize(grounded.select("claim_id", as_case.alias("case_id"), F.lit("document").alias("subject_key"), "predicate", "normalized_value", "current_state", "evidence_ids", F.col("artifact_version_id").alias("provenance_id")), "documents-claims")
    return docs, claims.known_claims(c).select(as_case.alias("case_id")).distinct()


def _evaluated(docs: DataFrame, cases: DataFrame) -> DataFrame:
    return rules.with_ids(rules.evaluate(cases, docs.where("current_state = 'verified'"), _RULES))


def q_rule_eval(spark: SparkSession, d: str) -> DataFrame:
    """Each subject against four rules that share predicates, over its verified claims."""
    return _evaluated(*_documents(spark, d)).withColumn("due_date", F.col("due_date").cast("string"))


_SQL_RULES = f"""
{_SQL_STATES},
docs AS (SELECT claim_id, concat_ws('/', case_id, subject_key) AS case_id, predicate, normalized_value, knowledge, current_state, artifact_version_id FROM final),
cases_ AS (SELECT DISTINCT case_id FROM docs WHERE knowledge = 'known'),
ver AS (SELECT * FROM docs JOIN (SELECT claim_id, string_agg(evidence_id, ',' ORDER BY evidence_id) AS evidence FROM edges GROUP BY 1) USING (claim_id) WHERE current_state = 'verified'),
cond AS (SELECT * FROM (VALUES {", ".join(f"('{r['rule_id']}', {i}, '{p}', '{e}')" for r in _RULES for i, (_, p, e) in enumerate(r["conditions"]))}) AS x(rule_id, pos, predicate, expected)),
head AS (SELECT * FROM (VALUES {", ".join(f"('{r['rule_id']}', '{r['anchor_predicate']}', {r['days_after']})" for r in _RULES)}) AS x(rule_id, anchor, days)),
per AS (SELECT q.case_id, c.rule_id, c.pos, c.predicate, count(v.claim_id) AS n, count(CASE WHEN v.normalized_value = c.expected THEN 1 END) AS hits
  FROM cases_ q CROSS JOIN cond c LEFT JOIN ver v ON v.case_id = q.case_id AND v.predicate = c.predicate GROUP BY ALL),
verdict AS (SELECT case_id, rule_id, bool_or(hits > 0 AND hits < n) AS disagree, string_agg(CASE WHEN n = 0 THEN predicate END, ', ' ORDER BY pos) AS missing, string_agg(CASE WHEN n > 0 AND hits = 0 THEN predicate END, ', ' ORDER BY pos) AS failed FROM per GROUP BY ALL),
days AS (SELECT case_id, rule_id, CASE WHEN json_valid(normalized_value) AND json_extract_string(normalized_value, '$.value.type') = 'date' THEN try_cast(concat_ws('-', lpad(json_extract_string(normalized_value, '$.value.value.year'), 4, '0'),
  lpad(json_extract_string(normalized_value, '$.value.value.month'), 2, '0'), lpad(json_extract_string(normalized_value, '$.value.value.day'), 2, '0')) AS date) END AS day FROM ver JOIN head ON predicate = anchor),
fixed AS (SELECT case_id, rule_id, min(day) AS a, max(day) AS z FROM days GROUP BY ALL),
used AS (SELECT DISTINCT v.case_id, r.rule_id, v.claim_id, v.evidence, sha256(concat_ws(chr(0), v.claim_id, v.evidence, 'document', v.predicate, v.normalized_value)) AS h
  FROM ver v JOIN (SELECT rule_id, predicate FROM cond UNION SELECT rule_id, anchor FROM head) r USING (predicate)),
inputs AS (SELECT case_id, rule_id, count(*) AS n_inputs, {", ".join(f"sum(CAST(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS bigint) AS hugeint)) AS h{i}" for i in range(3))} FROM used GROUP BY ALL),
coded AS (SELECT *, CASE WHEN disagree OR coalesce(a <> z, false) THEN 1 WHEN missing IS NOT NULL THEN 2 WHEN failed IS NOT NULL THEN 3 WHEN a IS NULL THEN 4 ELSE 5 END AS o
  FROM verdict JOIN head USING (rule_id) LEFT JOIN fixed USING (case_id, rule_id) LEFT JOIN inputs USING (case_id, rule_id)),
told AS (SELECT case_id, rule_id, CASE o WHEN 3 THEN 'not_satisfied' WHEN 5 THEN 'satisfied' ELSE 'indeterminate' END AS result,
  CASE o WHEN 1 THEN '{rules.DISAGREE}' WHEN 2 THEN replace('{rules.MISSING}', '{{}}', missing) WHEN 3 THEN replace('{rules.FAILED}', '{{}}', failed) WHEN 4 THEN replace('{rules.NO_ANCHOR}', '{{}}', anchor) ELSE '{rules.SATISFIED}' END AS explanation,
  CASE WHEN o = 5 THEN CAST(CAST(a + days AS date) AS varchar) END AS due_date, coalesce(n_inputs, 0) AS n_inputs,
  sha256(concat_ws('|', coalesce(n_inputs, 0), coalesce(h0, 0), coalesce(h1, 0), coalesce(h2, 0))) AS inputs_sha256 FROM coded),
evals AS (SELECT *, 'evaluation_' || left(sha256(concat_ws(chr(0), 'evaluation', case_id, rule_id, inputs_sha256)), 32) AS evaluation_id FROM told)
"""


def q_evaluation_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The evidence on which each evaluation rests."""
    docs, cases = _documents(spark, d)
    return rules.evaluation_evidence(_evaluated(docs, cases), rules.inputs(docs.where("current_state = 'verified'"), _RULES))


def _declared() -> list[dict]:
    good = {"package_id": "sample", "title": "Notice", "version": 1, "obligation_kind": "reply", "obligation_description": "Reply in “time”", "task_title": "Answer"}
    return [
        {**_RULES[0], **good, "stable_key": "notice"},
        {**_RULES[0], **good, "stable_key": "notice", "version": 2, "days_after": 12},
        {**_RULES[0], **good, "stable_key": "notice", "days_after": 11},
        {**_RULES[1], **good, "stable_key": "renewal", "task_title": ""},
        {**_RULES[2], **good, "stable_key": "closing", "conditions": _RULES[2]["conditions"] * 33},
    ]


def q_rules_registered(spark: SparkSession, d: str) -> DataFrame:
    """Rule versions with their definition's hash, and refused declarations."""
    made = rules.register(spark, _declared(), 5, "tester")
    kept = made["rule_versions"].join(made["rules"].select(F.col("id").alias("rule_id"), "stable_key"), "rule_id").select("stable_key", "version", F.col("definition_sha256").alias("outcome"))
    return kept.unionByName(made["refused"].withColumnRenamed("reason", "outcome"))


def _definition(days: int) -> str:
    conditions = ",".join(f'{{"subject_key":"document","predicate":"{p}","expected":{_TRUE}}}' for p in ("response_required", "active"))
    return f'{{"all":[{conditions}],"effect":{{"obligation_kind":"reply","obligation_description":"Reply in “time”","deadline_anchor_predicate":"received_date","deadline_days_after":{days},"task_title":"Answer"}}}}'


_REGISTERED = f"""
SELECT * FROM (VALUES ('notice', 1, sha256('{_definition(10)}')), ('notice', 2, sha256('{_definition(12)}')), ('notice', 1, 'conflict'), ('renewal', 1, 'invalid_input'), ('closing', 1, 'invalid_input')) AS x(stable_key, version, outcome)
"""


def q_grounded_claims(spark: SparkSession, d: str) -> DataFrame:
    c = _claims(spark, d)
    return A.grounded_claims(c, _state_log(c), _edges(c)).select("claim_id", "current_state", F.array_join("evidence_ids", ",").alias("evidence_ids"))


_GROUNDED = f"WITH {_SQL_STATES} SELECT claim_id, state AS current_state, string_agg(evidence_id, ',' ORDER BY evidence_id) AS evidence_ids FROM claims JOIN edges USING (claim_id) GROUP BY ALL"
_ASKED = ("What is the monthly_amount?", "Count of active items?", "Which invented_color?", "NOTES please", "What is the deadline of notes?")


def _questions(cases: DataFrame, asked: tuple[str, ...]) -> DataFrame:
    each = F.explode(F.array(*(F.lit(q) for q in asked)))
    return cases.select("case_id").distinct().select("case_id", each.alias("question")).withColumn("question_id", F.concat_ws("/", "case_id", "question"))


def _sql_questions(cases: str, asked: tuple[str, ...]) -> str:
    return f"q AS (SELECT case_id, concat_ws('/', case_id, asked) AS question_id, lower(asked) AS question FROM (SELECT DISTINCT case_id FROM {cases}), (SELECT unnest({list(asked)}) AS asked))"


def q_grounded_answer(spark: SparkSession, d: str) -> DataFrame:
    c = _claims(spark, d)
    out = A.answers(_questions(c, _ASKED), state.current_claims(c, _state_log(c)))
    return out.fillna(-1, ["first_claim_id", "last_claim_id"])


def _sql_modes(claims_: str, state_: str) -> str:
    """Answers over claims of the questions that don't ask for what is due."""
    return f"""
m AS (SELECT question_id, count(*) AS n_claims, count(DISTINCT CASE WHEN knowledge = 'known' THEN normalized_value END) AS n_values, bool_and({state_} = 'verified') AS sure, min(claim_id) AS first_claim_id, max(claim_id) AS last_claim_id
  FROM q JOIN {claims_} c USING (case_id) WHERE contains(question, lower(predicate)) GROUP BY 1),
said AS (SELECT question_id, case_id, CASE WHEN n_claims IS NULL THEN 'unknown' WHEN n_values > 1 THEN 'conflicting' WHEN sure THEN 'established' ELSE 'claimed' END AS mode,
  coalesce(n_claims, 0) AS n_claims, coalesce(n_values, 0) AS n_values, first_claim_id, last_claim_id FROM q LEFT JOIN m USING (question_id) WHERE NOT contains(question, 'deadline')),
stated AS (SELECT *, CASE mode {" ".join(f"WHEN '{m}' THEN '{text}'" for m, text in A.STATEMENTS.items())} END AS statement FROM said)"""


_ANSWER = f"""
WITH {_SQL_CLAIMS}, {_sql_questions("claims", _ASKED)}, {_sql_modes("claims", "c.state")}
SELECT question_id, case_id, mode, statement, n_claims, n_values, coalesce(first_claim_id, -1) AS first_claim_id, coalesce(last_claim_id, -1) AS last_claim_id FROM stated
"""
_DOCUMENT_ASKED = ("What is the DEADLINE?", "Is it active?", "What is the deadline of notes?")


def _titled(evaluated: DataFrame) -> DataFrame:
    return evaluated.withColumns({"title": F.concat(F.lit("Answer to "), "rule_id"), "evaluated_at_ms": F.lit(1).cast("bigint")})


def q_query(spark: SparkSession, d: str) -> DataFrame:
    """Questions to each subject, their intent first: two ask for what is due, one for a predicate."""
    docs, cases = _documents(spark, d)
    out = A.query(_questions(cases, _DOCUMENT_ASKED), docs, _titled(_evaluated(docs, cases)))
    return out.fillna(-1, ["first_claim_id", "last_claim_id"])


_LAST = "latest AS (SELECT case_id, arg_max({'id': evaluation_id, 'rule_id': rule_id, 'due': due_date, 'n': n_inputs}, evaluation_id) AS e FROM evals WHERE result = 'satisfied' GROUP BY 1)"
_QUERY = f"""
WITH {_SQL_RULES}, {_LAST}, {_sql_questions("cases_", _DOCUMENT_ASKED)}, {_sql_modes("docs", "c.current_state")}
SELECT question_id, case_id, mode, statement, n_claims, n_values, coalesce(first_claim_id, -1) AS first_claim_id, coalesce(last_claim_id, -1) AS last_claim_id, NULL AS evaluation_id FROM stated
UNION ALL SELECT question_id, case_id, CASE WHEN e IS NULL THEN 'unknown' ELSE 'established' END, CASE WHEN e IS NULL THEN '{A.STATEMENTS["unknown"]}' ELSE printf('{A.DUE_STATEMENT}', 'Answer to ' || e.rule_id, e.due) END,
  coalesce(e.n, 0), 0, -1, -1, e.id FROM q LEFT JOIN latest USING (case_id) WHERE contains(question, 'deadline')
"""


def q_citations(spark: SparkSession, d: str) -> DataFrame:
    """What the answers of ``q_query`` rest on."""
    docs, cases = _documents(spark, d)
    used = rules.inputs(docs.where("current_state = 'verified'"), _RULES)
    out = A.citations(_questions(cases, _DOCUMENT_ASKED), docs, _titled(_evaluated(docs, cases)), used)
    return out.select("question_id", "claim_id", "provenance_id", F.array_join("evidence_ids", ",").alias("evidence_ids"))


_CITATIONS = f"""
WITH {_SQL_RULES}, {_LAST}, {_sql_questions("cases_", _DOCUMENT_ASKED)},
all_evidence AS (SELECT claim_id, string_agg(evidence_id, ',' ORDER BY evidence_id) AS evidence FROM edges GROUP BY 1)
SELECT question_id, CAST(claim_id AS varchar) AS claim_id, artifact_version_id AS provenance_id, evidence AS evidence_ids FROM q JOIN docs USING (case_id) JOIN all_evidence USING (claim_id) WHERE contains(question, lower(predicate)) AND NOT contains(question, 'deadline')
UNION ALL SELECT question_id, CAST(claim_id AS varchar), NULL, used.evidence FROM q JOIN latest USING (case_id) JOIN used ON used.case_id = q.case_id AND used.rule_id = e.rule_id WHERE contains(question, 'deadline')
"""


def q_evaluation_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Each evaluation's inputs and their evidence, down to the bytes."""
    docs, cases = _documents(spark, d)
    used = rules.inputs(docs.where("current_state = 'verified'"), _RULES)
    of = docs.withColumn("artifact_version_id", F.col("provenance_id"))
    return A.evaluation_lineage(_evaluated(docs, cases), used, of, table(spark, d, "artifact_versions")).drop("provenance_id")


def q_claims_list(spark: SparkSession, d: str) -> DataFrame:
    """All claims in the order of the lists of a case."""
    c = _claims(spark, d).select("case_id", F.col("claim_id").alias("id"), "predicate", "created_at_ms")
    return c.orderBy("case_id", "created_at_ms", "id")


def q_checked_questions(spark: SparkSession, d: str) -> DataFrame:
    """The documents' texts taken as questions: which can be asked."""
    good, bad = A.check_questions(table(spark, d, "documents").select("doc_id", F.col("text").alias("question")))
    return good.select("doc_id", F.lit("accepted").alias("outcome")).unionByName(bad.select("doc_id", F.col("reason").alias("outcome")))


def _order_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Each order as an artifact; its key decides in which of ten forms, seven of them faulty."""
    o = table(spark, d, "orders")
    form, day, status = F.col("o_orderkey") % 10, F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderstatus")
    texts = {
        0: ("text/plain", F.concat(F.lit("order_date: "), day, F.lit("\nstatus: "), status, F.lit("\n"))),
        1: ("application/json", F.concat(F.lit('{"order_date":"'), day, F.lit('","total":1.0,"open":true,"none":null,"list":[1]}'))),
        2: ("text/csv; charset=utf-8", F.concat(F.lit("order_date, status\r\n"), day, F.lit(',"'), status, F.lit(', x"\r\n'))),
        3: ("text/csv", F.lit("a,b\n1\n")),
        4: ("application/pdf", F.lit("a: b")),
        5: ("text/plain", F.lit("no fields")),
        6: ("text/plain", F.lit("ok: 1\nprice: $5\n")),
        7: ("application/json", F.lit('{"a":1} x')),
        8: ("text/plain", F.lit("a: b")),
    }
    broken = F.when(F.col("o_orderkey") % 20 == 9, F.lit("a: b\n" * 60).cast("binary")).otherwise(F.unhex(F.lit("613A20FF")))
    media, content = F.lit("text/plain"), broken
    for n, (m, text) in texts.items():
        media, content = F.when(form == n, m).otherwise(media), F.when(form == n, text.cast("binary")).otherwise(content)
    made = o.select(F.col("o_orderkey").cast("string").alias("artifact_id"), media.alias("media_type"), content.alias("content"), form.alias("form"))
    return made.withColumn("content_sha256", F.when(F.col("form") == 8, F.lit("0" * 64)).otherwise(V.sha256_hex(F.col("content")))).drop("form")


def q_extract(spark: SparkSession, d: str) -> DataFrame:
    """Typed, located fields of the orders' bytes."""
    fields = scans.extract(_order_artifacts(spark, d), max_bytes=200).fields
    return fields.select("artifact_id", "subject_key", "predicate", "original_value", "kind", "normalized_value", "text_span_start", "row_number", "column_number", F.col("temporal.date").cast("string").alias("day"))


_EXTRACT = """
WITH o AS (SELECT CAST(o_orderkey AS varchar) AS artifact_id, o_orderkey % 10 AS form, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderstatus AS s FROM orders),
f AS (SELECT *, unnest(CASE form
  WHEN 0 THEN [{'k': 'document', 'p': 'order_date', 'v': d, 't': 'date', 'a': 12, 'r': NULL, 'c': NULL}, {'k': 'document', 'p': 'status', 'v': s, 't': 'text', 'a': 31, 'r': NULL, 'c': NULL}]
  WHEN 1 THEN [{'k': 'document', 'p': 'order_date', 'v': d, 't': 'date', 'a': NULL, 'r': NULL, 'c': NULL}, {'k': 'document', 'p': 'total', 'v': '1.0', 't': 'decimal', 'a': NULL, 'r': NULL, 'c': NULL},
    {'k': 'document', 'p': 'open', 'v': 'true', 't': 'boolean', 'a': NULL, 'r': NULL, 'c': NULL}, {'k': 'document', 'p': 'none', 'v': 'null', 't': 'unknown', 'a': NULL, 'r': NULL, 'c': NULL}]
  WHEN 2 THEN [{'k': 'row:1', 'p': 'order_date', 'v': d, 't': 'date', 'a': NULL, 'r': 1, 'c': 0}, {'k': 'row:1', 'p': 'status', 'v': s || ', x', 't': 'text', 'a': NULL, 'r': 1, 'c': 1}] END) AS x FROM o WHERE form < 3)
SELECT artifact_id, x.k AS subject_key, x.p AS predicate, x.v AS original_value, x.t AS kind, CASE x.t WHEN 'unknown' THEN '{"knowledge":"unknown"}' ELSE concat('{"knowledge":"known","value":{"type":"', x.t, '","value":', CASE x.t
  WHEN 'date' THEN concat('{"year":', CAST(left(d, 4) AS int), ',"month":', CAST(d[6:7] AS int), ',"day":', CAST(d[9:10] AS int), '}') WHEN 'decimal' THEN '{"coefficient":10,"scale":1}' WHEN 'boolean' THEN 'true' ELSE concat('"', x.v, '"') END, '}}') END AS normalized_value,
  CAST(x.a AS bigint) AS text_span_start, x.r AS row_number, x.c AS column_number, CASE WHEN x.t = 'date' THEN d END AS day FROM f
"""


def q_extract_failures(spark: SparkSession, d: str) -> DataFrame:
    """Why the other artifacts fail."""
    return scans.extract(_order_artifacts(spark, d), max_bytes=200).failures


_EXTRACT_FAILURES = """
SELECT CAST(o_orderkey AS varchar) AS artifact_id, CASE o_orderkey % 10 WHEN 3 THEN 'malformed_input' WHEN 4 THEN 'unsupported_format' WHEN 5 THEN 'no_observations' WHEN 6 THEN 'validation_rejected' WHEN 7 THEN 'malformed_input' WHEN 8 THEN 'unreadable_artifact'
  ELSE CASE WHEN o_orderkey % 20 = 9 THEN 'too_large' ELSE 'malformed_input' END END AS reason FROM orders WHERE o_orderkey % 10 > 2
"""


def _bytes(spark: SparkSession, d: str) -> DataFrame:
    """The documents' bytes, of every seventh with one that is no UTF-8 behind them."""
    docs = table(spark, d, "documents")
    content = F.when(F.col("doc_id") % 7 == 0, F.concat(F.col("text").cast("binary"), F.unhex(F.lit("C3")))).otherwise(F.col("text").cast("binary"))
    return docs.select(F.col("doc_id").alias("artifact_id"), content.alias("content"), F.col("text").alias("original"))


def q_decode(spark: SparkSession, d: str) -> DataFrame:
    texts, bad = scans.decode(_bytes(spark, d))
    read = texts.select("artifact_id", F.when(F.col("text") == F.col("original"), "same").otherwise("other").alias("outcome"))
    return read.unionByName(bad.withColumnRenamed("reason", "outcome"))


def q_verified_read(spark: SparkSession, d: str) -> DataFrame:
    """Stored documents, some of them with other bytes or under another key than their hash says."""
    b = _bytes(spark, d).where("original is not null")
    sha = V.sha256_hex(F.col("original"))
    key = F.when(F.col("artifact_id") % 5 == 0, F.concat(F.lit("blobs/zz/"), sha)).otherwise(V.storage_key(sha))
    good, corrupt = ingest.verified_read(b.select("artifact_id", key.alias("storage_key"), sha.alias("content_sha256"), "content"))
    return good.select("artifact_id", F.lit("read").alias("outcome")).unionByName(corrupt.select("artifact_id", F.lit("corrupt").alias("outcome")))


def q_checked_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Versions as ingest requests, some with texts out of bounds or of cases that aren't there."""
    v = table(spark, d, "artifact_versions").where("id is not null").dropDuplicates(["id"])
    n = F.coalesce("version_number", F.lit(0))
    requests = v.select(
        "id", F.col("artifact_id").alias("case_id"), F.rpad("id", F.when(n % 5 == 1, 2049).otherwise(2048).cast("int"), F.lit("x")).alias("source_key"), F.repeat(F.lit("c"), F.when(n % 5 == 2, 101).otherwise(100)).alias("connector"), F.lit("somewhere").alias("locator"), "media_type",
        F.concat("original_filename", F.when(n % 5 == 3, "/..").otherwise("")).alias("original_filename"), F.when(n % 7 == 0, F.repeat(F.lit("b"), 30)).otherwise("b").cast("binary").alias("content"),
    )
    accepted, refused = ingest.check_requests(requests, table(spark, d, "artifacts"), max_bytes=20)
    return accepted.select("id", F.lit("accepted").alias("outcome")).unionByName(refused.select("id", F.col("reason").alias("outcome")))


_CHECKED = r"""
WITH v AS (SELECT DISTINCT id, artifact_id, coalesce(version_number, 0) AS n, media_type, original_filename AS f FROM artifact_versions WHERE id IS NOT NULL)
SELECT id, CASE WHEN n % 5 IN (1, 2) OR (n % 5 = 3 AND f IS NOT NULL) OR media_type IS NULL OR trim(media_type) = '' OR (f IS NOT NULL AND NOT (length(trim(f)) BETWEEN 1 AND 255 AND NOT regexp_matches(f, '[\x00-\x1f\x7f-\x9f]') AND regexp_full_match(f, '[^/]+') AND f NOT IN ('.', '..'))) THEN 'invalid_input'
  WHEN n % 7 = 0 THEN 'too_large' WHEN artifact_id IN (SELECT id FROM artifacts WHERE id IS NOT NULL) THEN 'accepted' ELSE 'not_found' END AS outcome FROM v
"""


def q_temporal_checks(spark: SparkSession, d: str) -> DataFrame:
    """Faults of temporal values made from the orders, by kind."""
    o = table(spark, d, "orders")
    kinds = F.array(*(F.lit(k) for k in ("exact_date", "month", "year", "before", "after", "range", "unknown", "someday")))
    day, n = F.to_date("o_orderdate"), F.col("o_orderkey")
    t = F.struct(
        F.get(kinds, n % 8).alias("kind"), F.when(n % 3 > 0, day).alias("date"), F.when(n % 5 > 0, F.year(day)).otherwise(0).alias("year"), (n % 14).cast("int").alias("month"), F.when(n % 3 > 0, day).alias("earliest"), F.date_add(day, (n % 7 - 3).cast("int")).alias("latest"),
    )
    return o.select("o_orderkey", F.array_join(V.temporal_errors(t), ",").alias("errors"))


_TEMPORAL = """
WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS k, o_orderkey % 3 > 0 AS dated, o_orderkey % 5 > 0 AS yeared, o_orderkey % 14 AS m, o_orderkey % 7 - 3 AS shift FROM orders)
SELECT o_orderkey, concat_ws(',', CASE WHEN k = 7 THEN 'kind' END, CASE WHEN k IN (0, 3, 4) AND NOT dated THEN 'date' END, CASE WHEN k IN (1, 2) AND NOT yeared THEN 'year' END, CASE WHEN k = 1 AND NOT m BETWEEN 1 AND 12 THEN 'month' END,
  CASE WHEN k = 5 AND NOT (dated AND shift >= 0) THEN 'range' END) AS errors FROM o
"""


def q_ledger_append(spark: SparkSession, d: str) -> DataFrame:
    """Sources appended to a ledger in two batches, the second of them twice, by id."""
    s = table(spark, d, "sources").where("id is not null").select("id", "connector")
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    ledger.append_new("first", "sources", s.where("connector < 'm'"), ["id"])
    for _ in range(2):
        ledger.append_new("second", "sources", s, ["id"])
    return ledger.read("sources")


def q_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Orders as text, from bytes to claims with their states, by customer: (case_id, predicate, value,
    state, n)."""
    o = table(spark, d, "orders")
    content = F.concat(F.lit("status: "), "o_orderstatus", F.lit("\npriority: "), "o_orderpriority", F.lit("\nclerk: "), "o_custkey", F.lit("\n")).cast("binary")
    requests = o.select(
        F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("case_id"), F.col("o_orderkey").cast("string").alias("source_key"), F.lit("filesystem").alias("connector"), F.lit("here").alias("locator"), F.lit("text/plain").alias("media_type"), F.lit(None).cast("string").alias("original_filename"), content.alias("content"),
    )
    cases = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    made = ingest_claims(requests, cases, at_ms=5, actor="tester", connector="filesystem")
    c = made["claims"].withColumnRenamed("id", "claim_id")
    return state.current_claims(c, made["claim_state_changes"]).groupBy("case_id", "predicate", F.col("original_value").alias("value"), F.col("current_state").alias("state")).agg(F.count(F.lit(1)).alias("n"))


_PIPELINE = """
WITH o AS (SELECT o_custkey AS c, unnest([{'p': 'status', 'v': o_orderstatus}, {'p': 'priority', 'v': o_orderpriority}, {'p': 'clerk', 'v': CAST(o_custkey AS varchar)}]) AS x FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)),
g AS (SELECT CAST(c AS varchar) AS case_id, x.p AS predicate, x.v AS value, count(*) AS n FROM o GROUP BY ALL)
SELECT case_id, predicate, value, CASE WHEN count(*) OVER (PARTITION BY case_id, predicate) > 1 THEN 'contradicted' ELSE 'extracted' END AS state, n FROM g
"""

QUERIES = {n: f for n, f in globals().items() if n.startswith("q_")}
SQL = {
    "q_contradicted_states": f"WITH {_SQL_STATES} SELECT claim_id, current_state FROM final",
    "q_links_edges": _EDGES,
    "q_review_outcome": _REVIEW,
    "q_corrections": _CORRECTIONS,
    "q_affected_derivations": f"WITH {_SQL_STATES}, {_SQL_RESTS} SELECT DISTINCT claim_id, evaluation_id FROM claims JOIN edges USING (claim_id) JOIN rests USING (evidence_id) WHERE confidence < 0.3",
    "q_rule_eval": f"WITH {_SQL_RULES} SELECT * FROM evals",
    "q_evaluation_evidence": f"WITH {_SQL_RULES} SELECT DISTINCT evaluation_id, evidence_id FROM evals JOIN used USING (case_id, rule_id) JOIN edges USING (claim_id)",
    "q_rules_registered": _REGISTERED,
    "q_grounded_claims": _GROUNDED,
    "q_grounded_answer": _ANSWER,
    "q_query": _QUERY,
    "q_citations": _CITATIONS,
    "q_evaluation_lineage": f"WITH {_SQL_RULES}, bytes AS (SELECT DISTINCT id, content_sha256 FROM artifact_versions WHERE id IS NOT NULL) SELECT evaluation_id, rule_id, CAST(claim_id AS varchar) AS claim_id, evidence_id, artifact_version_id, content_sha256 FROM evals JOIN used USING (case_id, rule_id) JOIN edges USING (claim_id) JOIN docs USING (claim_id) LEFT JOIN bytes ON artifact_version_id = bytes.id",
    "q_claims_list": f"WITH {_SQL_CLAIMS} SELECT case_id, claim_id AS id, predicate, created_at_ms FROM claims",
    "q_checked_questions": r"SELECT doc_id, CASE WHEN text IS NULL OR regexp_replace(text, '[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', '', 'g') = '' OR strlen(text) > 2000 THEN 'invalid_input' ELSE 'accepted' END AS outcome FROM documents",
    "q_extract": _EXTRACT,
    "q_extract_failures": _EXTRACT_FAILURES,
    "q_decode": "SELECT doc_id AS artifact_id, CASE WHEN text IS NULL THEN 'unreadable_artifact' WHEN doc_id % 7 = 0 THEN 'malformed_input' ELSE 'same' END AS outcome FROM documents",
    "q_verified_read": "SELECT doc_id AS artifact_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN 'corrupt' ELSE 'read' END AS outcome FROM documents WHERE text IS NOT NULL",
    "q_checked_ingest": _CHECKED,
    "q_temporal_checks": _TEMPORAL,
    "q_ledger_append": "SELECT DISTINCT id, connector FROM sources WHERE id IS NOT NULL",
    "q_pipeline": _PIPELINE,
}
