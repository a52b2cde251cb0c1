"""Grounded claims, answers with citations, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deponent.functions.codecs import code
from deponent.functions.text import ascii_lower, trim_ws
from deponent.functions.values import knowledge
from deponent.operators.state import current_claims


#: Fixed value: longest question.
MAX_QUESTION_BYTES = 2000
#: Statement of an answer by its mode.
STATEMENTS = {
    "established": "The evidence establishes a value for this predicate.",
    "claimed": "One or more sources claim a value for this predicate.",
    "suggested": "The available evidence suggests a value for this predicate.",
    "conflicting": "Sources disagree about this predicate.",
    "unknown": "The system does not have sufficient evidence to determine this.",
}
#: Phrases of a question that asks for what is due, and its statement.
DUE_PHRASES = ("deadline", "what must", "need to do")
DUE_STATEMENT = "%s is required by a satisfied rule evaluation and is due %s."
NO_DATE = "an unresolved date"


def statement(mode: Column) -> Column:
    """The sentence of a mode."""
    return F.coalesce(*(F.when(mode == m, F.lit(text)) for m, text in STATEMENTS.items()))


def asks_what_is_due(question: Column) -> Column:
    q = ascii_lower(question)
    return F.coalesce(q.contains(DUE_PHRASES[0]) | q.contains(DUE_PHRASES[1]) | q.contains(DUE_PHRASES[2]), F.lit(False))


def check_questions(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions that can be asked, and those refused as invalid_input: blank ones and ones of more than
    MAX_QUESTION_BYTES bytes."""
    ok = F.coalesce((trim_ws(F.col("question")) != "") & (F.octet_length("question") <= MAX_QUESTION_BYTES), F.lit(False))
    return questions.where(ok), questions.where(~ok).withColumn("reason", F.lit(code("failure", "invalid_input")))


def _last_satisfied(evaluations: DataFrame) -> DataFrame:
    """(case_id, e): the last satisfied evaluation of each case, by time and id."""
    last = F.max(F.struct("evaluated_at_ms", "evaluation_id", "rule_id", "title", F.col("due_date").cast("string").alias("due"), "n_inputs"))
    return evaluations.where("result = 'satisfied'").groupBy("case_id").agg(last.alias("e"))


def due_answers(questions: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Answers (question_id, case_id, mode, statement, n_claims, evaluation_id) of the questions that ask
    for what is due: the last satisfied evaluation (case_id, rule_id, evaluation_id, result, title,
    due_date, n_inputs, evaluated_at_ms) of the case, by time and id; unknown where it has none."""
    asked = questions.where(asks_what_is_due(F.col("question"))).select("question_id", "case_id")
    found = asked.join(_last_satisfied(evaluations), "case_id", "left")
    mode = F.when(F.col("e").isNull(), "unknown").otherwise("established")
    sentence = F.when(F.col("e").isNull(), STATEMENTS["unknown"]).otherwise(F.format_string(DUE_STATEMENT, F.col("e.title"), F.coalesce("e.due", F.lit(NO_DATE))))
    return found.select("question_id", "case_id", mode.alias("mode"), sentence.alias("statement"), F.coalesce("e.n_inputs", F.lit(0)).cast("bigint").alias("n_claims"), F.col("e.evaluation_id").alias("evaluation_id"))


def grounded_claims(claims: DataFrame, log: DataFrame, edges: DataFrame) -> DataFrame:
    """Claims with current state and the sorted ids of their evidence."""
    support = edges.where("relationship = 'supported_by'").groupBy(F.col("from_id").alias("claim_id")).agg(F.sort_array(F.collect_set("to_id")).alias("evidence_ids"))
    return current_claims(claims, log).join(support, "claim_id", "left").withColumn("evidence_ids", F.coalesce("evidence_ids", F.array().cast("array<string>")))


def answers(questions: DataFrame, claims: DataFrame) -> DataFrame:
    """Answer of each question over the claims (with current_state) of its case: (question_id, mode,
    statement, n_claims, n_values, first_claim_id, last_claim_id). Questions for what is due are left
    out: they belong to ``due_answers``.

    A predicate matches if the lower-case question contains it (as it does anywhere in a word). Modes:
    unknown (no match), conflicting (several known values), established (all verified), suggested (any
    inferred or corroborated), else claimed. Claims of all states take part. Predicates are matched to
    questions on distinct pairs of case and predicate, so no claim takes part in the text match."""
    asked = questions.where(~asks_what_is_due(F.col("question"))).select("question_id", "case_id", ascii_lower(F.col("question")).alias("_q"))
    predicates = claims.select("case_id", "predicate").distinct()
    matched = asked.join(predicates, "case_id").where(F.col("_q").contains(ascii_lower(F.col("predicate")))).select("question_id", "case_id", "predicate")
    value = F.when(knowledge(F.col("normalized_value")) == "known", F.col("normalized_value"))
    slim = claims.select("case_id", "predicate", value.alias("_value"), "current_state", "claim_id")
    per_value = slim.groupBy("case_id", "predicate", "_value").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("current_state") == "verified").alias("sure"), F.bool_or(F.col("current_state").isin("inferred", "corroborated")).alias("hint"), F.min("claim_id").alias("a"), F.max("claim_id").alias("z")
    )
    found = matched.join(per_value, ["case_id", "predicate"]).groupBy("question_id").agg(
        F.sum("n").alias("n_claims"), F.count_distinct("_value").alias("n_values"), F.bool_and("sure").alias("sure"), F.bool_or("hint").alias("hint"), F.min("a").alias("first_claim_id"), F.max("z").alias("last_claim_id")
    )
    mode = F.when(F.col("n_claims").isNull(), "unknown").when(F.col("n_values") > 1, "conflicting").when(F.col("sure"), "established").when(F.col("hint"), "suggested").otherwise("claimed")
    out = asked.select("question_id", "case_id").join(found, "question_id", "left")
    return out.select("question_id", "case_id", mode.alias("mode"), statement(mode).alias("statement"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"), F.coalesce("n_values", F.lit(0)).alias("n_values"), "first_claim_id", "last_claim_id")


def query(questions: DataFrame, claims: DataFrame, evaluations: DataFrame) -> DataFrame:
    """The answer of each question, its intent first: what is due comes from ``evaluations``, anything
    else from ``claims`` (with current_state). Columns of ``answers`` and evaluation_id."""
    by_claims = answers(questions, claims).withColumn("evaluation_id", F.lit(None).cast("string"))
    due = due_answers(questions, evaluations).withColumn("n_values", F.lit(0).cast("bigint"))
    id_type = by_claims.schema["first_claim_id"].dataType
    return by_claims.unionByName(due.withColumns({c: F.lit(None).cast(id_type) for c in ("first_claim_id", "last_claim_id")}))


def citations(questions: DataFrame, grounded: DataFrame, evaluations: DataFrame | None = None, used: DataFrame | None = None) -> DataFrame:
    """(question_id, claim_id, provenance_id, evidence_ids) of every claim that an answer rests on, one
    row a citation: an answer of any size stays distributed. Where ``evaluations`` and their ``used``
    inputs are given, a question for what is due cites the inputs of its evaluation."""
    asked = questions.where(~asks_what_is_due(F.col("question"))).select("question_id", "case_id", ascii_lower(F.col("question")).alias("_q"))
    matched = asked.join(grounded.select("case_id", "predicate").distinct(), "case_id").where(F.col("_q").contains(ascii_lower(F.col("predicate")))).select("question_id", "case_id", "predicate")
    cited = matched.join(grounded, ["case_id", "predicate"]).select("question_id", F.col("claim_id").cast("string").alias("claim_id"), "provenance_id", "evidence_ids")
    if evaluations is None or used is None:
        return cited
    due = questions.where(asks_what_is_due(F.col("question"))).select("question_id", "case_id").join(_last_satisfied(evaluations).select("case_id", "e.rule_id"), "case_id")
    return cited.unionByName(due.join(used, ["case_id", "rule_id"]).select("question_id", "claim_id", F.lit(None).cast("string").alias("provenance_id"), "evidence_ids"))


def lineage(claims: DataFrame, versions: DataFrame, artifacts: DataFrame, sources: DataFrame) -> DataFrame:
    """Of each claim the bytes and the source it goes back to."""
    v = versions.select(F.col("id").alias("artifact_version_id"), "artifact_id", "content_sha256").where("artifact_version_id is not null").distinct()
    a = artifacts.select(F.col("id").alias("artifact_id"), "source_id", "source_key").where("artifact_id is not null").distinct()
    s = sources.select(F.col("id").alias("source_id"), "connector").where("source_id is not null").distinct()
    origin = v.join(a.join(s, "source_id", "left"), "artifact_id", "left")
    return claims.select("claim_id", "artifact_version_id").join(origin, "artifact_version_id", "left").select("claim_id", "content_sha256", "source_key", "connector")


def evaluation_lineage(evaluations: DataFrame, used: DataFrame, claims: DataFrame, versions: DataFrame) -> DataFrame:
    """Why an evaluation came out: (evaluation_id, rule_id, claim_id, evidence_id, provenance_id,
    artifact_version_id, content_sha256) of each evidence of each of its inputs, down to the bytes. An
    input without evidence, or whose provenance names no version, has nulls there. ``claims`` have
    claim_id, provenance_id and artifact_version_id."""
    inputs = used.select("case_id", "rule_id", "claim_id", F.explode_outer("evidence_ids").alias("evidence_id"))
    of = claims.select(F.col("claim_id").cast("string").alias("claim_id"), "provenance_id", "artifact_version_id").dropDuplicates(["claim_id"])
    sha = versions.select(F.col("id").alias("artifact_version_id"), "content_sha256").where("artifact_version_id is not null").dropDuplicates(["artifact_version_id"])
    rows = evaluations.select("evaluation_id", "case_id", "rule_id").join(inputs, ["case_id", "rule_id"]).join(of, "claim_id", "left").join(sha, "artifact_version_id", "left")
    return rows.select("evaluation_id", "rule_id", "claim_id", "evidence_id", "provenance_id", "artifact_version_id", "content_sha256")
