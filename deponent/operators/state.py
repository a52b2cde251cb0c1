"""States of claims: append-only logs, reviews, corrections and what they affect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deponent.functions.codecs import code
from deponent.functions.values import deterministic_id, valid_text
from deponent.session import materialize

#: State of a claim after a review decision.
DECISIONS = {"verified": "verified", "rejected": "rejected", "needs_more_evidence": "unresolved"}
#: States in which a claim is no longer active.
ENDED = ("rejected", "superseded")


def latest_state(log: DataFrame) -> DataFrame:
    """(claim_id, state, changed_at_ms) of the last change, ties by the larger id. An aggregate, not a
    window: each claim's log is reduced before it is shuffled."""
    return log.groupBy("claim_id").agg(F.max(F.struct("changed_at_ms", "id", "state")).alias("s")).select("claim_id", "s.state", "s.changed_at_ms")


def current_claims(claims: DataFrame, log: DataFrame) -> DataFrame:
    """Claims with current_state: of the log, else the initial one."""
    last = latest_state(log).select("claim_id", F.col("state").alias("_last"))
    return claims.join(last, "claim_id", "left").withColumn("current_state", F.coalesce("_last", "initial_state")).drop("_last")


def active_claims(claims: DataFrame, log: DataFrame) -> DataFrame:
    return current_claims(claims, log).where(~F.col("current_state").isin(*ENDED))


def _rationale(df: DataFrame) -> Column:
    return (F.col("rationale") if "rationale" in df.columns else F.lit(None)).cast("string")


def review(decisions: DataFrame, claims: DataFrame, facts: DataFrame | None = None) -> dict[str, DataFrame]:
    """Reviews (claim_id, decision, actor, decided_at_ms and, where given, rationale) into reviews, state
    changes, facts, audit events and refusals.

    A verified claim becomes a fact, once: further verifications of it are refused as ``conflict``.
    ``corrected``, unknown decisions and actors without 1 to 300 characters are ``invalid_input``,
    unknown claims ``not_found``."""
    to = F.coalesce(*(F.when(F.col("decision") == d, F.lit(s)) for d, s in DECISIONS.items()))
    given = decisions.select("claim_id", "decision", "actor", "decided_at_ms", _rationale(decisions).alias("rationale"))
    joined = given.join(claims.select("claim_id", "case_id", "normalized_value"), "claim_id", "left").withColumn("state", F.when(valid_text(F.col("actor"), 1, 300), to))
    order = F.struct("decided_at_ms", "actor")
    first = joined.where("state = 'verified' and case_id is not null").groupBy("claim_id").agg(F.min(order).alias("_first"))
    if facts is not None:
        first = first.join(facts.select("claim_id").distinct(), "claim_id", "left_anti")
    judged = joined.join(first, "claim_id", "left").withColumn(
        "refusal",
        F.when(F.col("case_id").isNull(), code("failure", "not_found")).when(F.col("state").isNull(), code("failure", "invalid_input")).when((F.col("state") == "verified") & F.coalesce(F.col("_first") != order, F.lit(True)), code("failure", "conflict")),
    )
    good = judged.where("refusal is null")
    key = [F.col("claim_id"), F.col("decision"), F.col("decided_at_ms")]
    return {
        "human_reviews": good.select(deterministic_id("review", *key).alias("id"), "case_id", F.lit("claim").alias("target_kind"), F.col("claim_id").cast("string").alias("target_id"), "decision", "actor", "rationale", F.col("decided_at_ms").alias("reviewed_at_ms")),
        "claim_state_changes": good.select(deterministic_id("state", F.col("claim_id"), F.col("state"), F.col("decided_at_ms")).alias("id"), "claim_id", "state", F.col("decided_at_ms").alias("changed_at_ms"), "actor"),
        "facts": good.where("state = 'verified'").select(deterministic_id("fact", F.col("claim_id")).alias("id"), "claim_id", "case_id", F.col("normalized_value").alias("established_value"), F.col("decided_at_ms").alias("established_at_ms"), F.col("actor").alias("established_by")),
        "audit_events": good.select(deterministic_id("audit", F.lit("claim.review"), *key).alias("id"), "case_id", F.lit(code("operation", "claim.review")).alias("operation"), F.col("claim_id").cast("string").alias("target_id"), "actor", F.col("decided_at_ms").alias("occurred_at_ms")),
        "refused": judged.where("refusal is not null").select("claim_id", "decision", "refusal"),
    }


def correct(corrections: DataFrame, claims: DataFrame, edges: DataFrame, evaluation_evidence: DataFrame) -> dict[str, DataFrame]:
    """Corrections (claim_id, corrected_text, corrected_value, actor, corrected_at_ms and, where given,
    rationale) into new claims of human origin with their provenance, reviews, corrections, state
    changes, supersedes edges, audit events, the derivations affected and refusals. The original claim
    is superseded; the corrected one starts verified, without evidence, and is not compared. Unknown
    claims are refused as ``not_found``, texts of no or more than a million characters and actors
    without 1 to 300 as ``invalid_input``. Corrections meet their claims once, in a table that is
    written, of which all results but ``affected`` are projections."""
    given = corrections.select("claim_id", "corrected_text", "corrected_value", "actor", "corrected_at_ms", _rationale(corrections).alias("rationale"))
    ok = valid_text(F.col("actor"), 1, 300) & valid_text(F.col("corrected_text"), 1, 1_000_000)
    # merged by hint, as a compressed file's size says little of the memory that its rows take when broadcast
    joined = given.join(claims.select("claim_id", "case_id", "subject_key", "predicate", "normalized_value").hint("merge"), "claim_id", "left")
    judged = materialize(joined.withColumn("refusal", F.when(~ok, code("failure", "invalid_input")).when(F.col("case_id").isNull(), code("failure", "not_found"))), "corrections")
    at, key = F.col("corrected_at_ms"), [F.lit("correction"), F.col("claim_id"), F.col("corrected_at_ms")]
    made = {f"{k}_id": deterministic_id(k, *key) for k in ("claim", "provenance", "review", "correction")}
    c = judged.where("refusal is null").withColumn("old_id", F.col("claim_id").cast("string")).withColumns({f"new_{n}": v for n, v in made.items()})
    change = lambda claim, state: c.select(deterministic_id("state", F.col(claim), F.lit(state), at).alias("id"), F.col(claim).alias("claim_id"), F.lit(state).alias("state"), at.alias("changed_at_ms"), "actor")
    return {
        "provenance_records": c.select(F.col("new_provenance_id").alias("id"), F.lit("human_correction").alias("extraction_method"), F.col("actor").alias("extractor_name"), F.lit("human").alias("extractor_version"), at.alias("extracted_at_ms"), F.lit(code("verification_state", "corrected")).alias("verification_state"), F.col("corrected_text").alias("original_representation")),
        "claims": c.select(F.col("new_claim_id").alias("claim_id"), "case_id", "subject_key", "predicate", F.col("corrected_text").alias("original_value"), F.col("corrected_value").alias("normalized_value"), F.col("new_provenance_id").alias("provenance_id"), F.lit("human").alias("origin"), F.lit("verified").alias("initial_state"), at.alias("created_at_ms")),
        "human_reviews": c.select(F.col("new_review_id").alias("id"), "case_id", F.lit("claim").alias("target_kind"), F.col("old_id").alias("target_id"), F.lit(code("decision", "corrected")).alias("decision"), "actor", "rationale", at.alias("reviewed_at_ms")),
        "corrections": c.select(F.col("new_correction_id").alias("id"), "case_id", F.col("old_id").alias("original_claim_id"), F.col("new_claim_id").alias("corrected_claim_id"), F.col("new_review_id").alias("review_id"), F.col("new_provenance_id").alias("provenance_id"), F.col("normalized_value").alias("original_value"), "corrected_value", "actor", "rationale", "corrected_at_ms"),
        "claim_state_changes": change("old_id", "superseded").unionByName(change("new_claim_id", "verified")),
        "evidence_edges": c.select(deterministic_id("edge", F.col("new_claim_id"), F.lit("supersedes"), F.col("old_id")).alias("id"), "case_id", F.lit("claim").alias("from_kind"), F.col("new_claim_id").alias("from_id"), F.lit("supersedes").alias("relationship"), F.lit("claim").alias("to_kind"), F.col("old_id").alias("to_id"), at.alias("created_at_ms")),
        "audit_events": c.select(deterministic_id("audit", F.lit("claim.correct"), *key).alias("id"), "case_id", F.lit(code("operation", "claim.correct")).alias("operation"), F.col("old_id").alias("target_id"), "actor", at.alias("occurred_at_ms")),
        "affected": affected_derivations(c.select("claim_id"), edges, evaluation_evidence),
        "refused": judged.where("refusal is not null").select("claim_id", "refusal"),
    }


def affected_derivations(changed: DataFrame, edges: DataFrame, evaluation_evidence: DataFrame) -> DataFrame:
    """(claim_id, evaluation_id), distinct: evaluations that rest on evidence of a changed claim. Each
    side can be large, so both joins are merges."""
    support = edges.where("relationship = 'supported_by'").select(F.col("from_id").alias("claim_id"), F.col("to_id").alias("evidence_id"))
    return changed.select("claim_id").distinct().join(support.hint("merge"), "claim_id").join(evaluation_evidence.hint("merge"), "evidence_id").select("claim_id", "evaluation_id").distinct()
