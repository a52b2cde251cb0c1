"""Claims: fan-out of fields, corroboration and contradiction.

Two known claims of one (case_id, subject_key, predicate) corroborate if their canonical values are
equal and contradict otherwise. Pairs of claims are never enumerated: claims of equal value form a
class, classes contradict, and each claim carries its class and its numbers of links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deponent.functions.codecs import code
from deponent.functions.values import deterministic_id, knowledge
from deponent.operators.prefix import prefix_sum
from deponent.operators.state import active_claims
from deponent.session import materialize

#: Fixed value: description of a claim's evidence, before the predicate.
EXCERPT = "Artifact excerpt supporting predicate "
GROUP = ["case_id", "subject_key", "predicate"]
#: Fixed value: who changes the states of contradicting claims.
DETECTOR = "system:contradiction-detector"


def unpivot_claims(rows: DataFrame, case_id: Column, subject_key: Column, predicates: list[str]) -> DataFrame:
    """Columns of a wide table as (case_id, subject_key, predicate, original_value), nulls left out."""
    ready = rows.select(case_id.cast("string").alias("case_id"), subject_key.cast("string").alias("subject_key"), *(F.col(p).cast("string").alias(p) for p in predicates))
    return ready.unpivot(["case_id", "subject_key"], predicates, "predicate", "original_value").where("original_value is not null")


def fan_out(fields: DataFrame, case_id: Column, version_id: Column, connector: str, extractor: tuple[str, str], at_ms: int, actor: str) -> dict[str, DataFrame]:
    """One field into its provenance, observation, claim, evidence, edge and audit rows, with ids made
    from their content, so that a repeated run makes the same rows."""
    where = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source_field", "paragraph_number", "text_span_start", "row_number", "column_number")))
    base = fields.select(
        case_id.cast("string").alias("case_id"), version_id.cast("string").alias("artifact_version_id"), "subject_key", "predicate", "original_value", "normalized_value",
        "source_field", "paragraph_number", "text_span_start", "text_span_end", "row_number", "column_number", where.alias("_where"),
    )
    key = [F.col(c) for c in ("artifact_version_id", "subject_key", "predicate", "_where", "original_value")]
    base = base.withColumns({f"{k}_id": deterministic_id(k, *key) for k in ("provenance", "observation", "claim", "evidence")})
    at, who = F.lit(at_ms).cast("bigint"), F.lit(actor)
    return {
        "provenance_records": base.select(F.col("provenance_id").alias("id"), "artifact_version_id", F.lit(connector).alias("connector"), "source_field", "paragraph_number", "text_span_start", "text_span_end", "row_number", "column_number", F.lit("deterministic").alias("extraction_method"), F.lit(extractor[0]).alias("extractor_name"), F.lit(extractor[1]).alias("extractor_version"), at.alias("extracted_at_ms"), F.lit("not_reviewed").alias("verification_state"), F.col("original_value").alias("original_representation")),
        "observations": base.select(F.col("observation_id").alias("id"), "case_id", "provenance_id", "original_value", at.alias("observed_at_ms")),
        "claims": base.select(F.col("claim_id").alias("id"), "case_id", "subject_key", "predicate", "original_value", "normalized_value", "provenance_id", F.lit("external").alias("origin"), F.lit("extracted").alias("initial_state"), at.alias("created_at_ms")),
        "evidence": base.select(F.col("evidence_id").alias("id"), "case_id", "provenance_id", F.lit("artifact_excerpt").alias("kind"), F.concat(F.lit(EXCERPT), "predicate").alias("description")),
        "evidence_edges": base.select(F.lit("claim").alias("from_kind"), F.col("claim_id").alias("from_id"), F.lit("supported_by").alias("relationship"), F.lit("evidence").alias("to_kind"), F.col("evidence_id").alias("to_id"), at.alias("created_at_ms")),
        "audit_events": audit(base, "claim.record", F.col("claim_id"), at, who),
    }


def audit(rows: DataFrame, operation: str, target: Column, at: Column, actor: Column) -> DataFrame:
    """One audit event for each row; ``operation`` is one of the closed set."""
    code("operation", operation)
    return rows.select(deterministic_id("audit", F.lit(operation), target).alias("id"), "case_id", F.lit(operation).alias("operation"), target.alias("target_id"), actor.alias("actor"), at.alias("occurred_at_ms"))


def known_claims(claims: DataFrame) -> DataFrame:
    """Claims whose value is known; only these corroborate or contradict."""
    return claims.where(knowledge(F.col("normalized_value")) == "known")


def value_classes(claims: DataFrame) -> DataFrame:
    """Claims of one group and equal value as one class: (group, normalized_value, class_id (smallest
    claim_id), members). Combined map-side."""
    return known_claims(claims).groupBy(*GROUP, "normalized_value").agg(F.min("claim_id").alias("class_id"), F.count(F.lit(1)).alias("members"))


def claim_links(claims: DataFrame) -> DataFrame:
    """One row a known claim: claim_id, class_id, n_corroborates (other claims of its class) and
    n_contradicts (claims of the group's other classes). Classes are made once and written."""
    classes = materialize(value_classes(claims), "link-classes")
    groups = classes.groupBy(*GROUP).agg(F.sum("members").alias("in_group"))
    sized = classes.join(groups, GROUP)
    return known_claims(claims).select("claim_id", *GROUP, "normalized_value").join(sized, [*GROUP, "normalized_value"]).select("claim_id", "class_id", (F.col("members") - 1).alias("n_corroborates"), (F.col("in_group") - F.col("members")).alias("n_contradicts"))


def contradictions(claims: DataFrame) -> DataFrame:
    """Contradicting classes of a group, once each, the smaller class id first: (contradiction_id,
    class_a, class_b). Classes are made once and written, so that no later step meets single claims;
    groups of a single value are left out before the join."""
    classes = materialize(value_classes(claims), "contradiction-classes")
    mixed = classes.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*GROUP)
    c = classes.join(mixed, GROUP, "left_semi").select(*GROUP, "class_id")
    pairs = c.withColumnRenamed("class_id", "class_a").join(c.withColumnRenamed("class_id", "class_b"), GROUP).where("class_a < class_b")
    return pairs.select(deterministic_id("contradiction", F.col("class_a"), F.col("class_b")).alias("contradiction_id"), "case_id", "class_a", "class_b")


def conflict_groups(claims: DataFrame) -> DataFrame:
    """Of each group, whether its known values agree: (group, n_claims, n_values, verdict)."""
    g = value_classes(claims).groupBy(*GROUP).agg(F.sum("members").alias("n_claims"), F.count(F.lit(1)).alias("n_values"))
    return g.withColumn("verdict", F.when(F.col("n_values") > 1, "conflicting").otherwise("claimed"))


def links_when_recorded(claims: DataFrame, endings: DataFrame) -> DataFrame:
    """What each known claim met when it was recorded, one after another: of the group's claims that
    were active just then, how many it corroborates and contradicts.

    ``claims`` have claim_id and seq, ``endings`` (claim_id, seq) the moments at which claims were
    rejected or superseded. Each claim adds 1 to the active ones of its value and group at its seq and
    takes it away at its end, so both numbers are running totals and no pair is formed."""
    known = known_claims(claims).select(*GROUP, "normalized_value", "claim_id", "seq")
    ended = endings.groupBy("claim_id").agg(F.min("seq").alias("end_seq")).join(known.drop("seq"), "claim_id").select(*GROUP, "normalized_value", "claim_id", F.col("end_seq").alias("seq"), F.lit(-1).alias("delta"))
    log = known.withColumn("delta", F.lit(1)).unionByName(ended)
    order = ["seq", "delta", "claim_id"]
    same = prefix_sum(log, [*GROUP, "normalized_value"], order, F.col("delta"), "same_value")
    both = prefix_sum(same, GROUP, order, F.col("delta"), "all_values")
    return both.where("delta = 1").select("claim_id", F.col("same_value").alias("n_corroborates"), (F.col("all_values") - F.col("same_value")).alias("n_contradicts"))


def record_conflicts(new: DataFrame, prior: DataFrame | None = None, log: DataFrame | None = None) -> dict[str, DataFrame]:
    """What recording the claims ``new`` finds among themselves and with the active ones of ``prior``:
    claim_state_changes, contradictions and evidence_edges.

    Both claims of a contradiction become ``contradicted`` when the later one is recorded; a claim's
    last such moment is written, as earlier ones are overruled by it. Moments are found per class: of
    a group the two classes with the latest new claims are kept, and each claim takes the latest of a
    class that isn't its own, so no pair of claims is formed. contradictions are pairs of class
    representatives (the smallest claim_id) of which one class is met by a new claim; edges are
    ``contradicts`` between them, both ways, and ``corroborates`` from each new claim to its class.

    ``prior`` claims count if active by ``log`` (neither rejected nor superseded); without a log all
    do. Defined results: unknown values take no part; a null created_at_ms is 0; repeated rows of a
    claim count once; empty tables give none."""
    columns = ["claim_id", *GROUP, "normalized_value", F.coalesce("created_at_ms", F.lit(0)).cast("bigint").alias("at")]
    members = known_claims(new).select(*columns).distinct().withColumn("is_new", F.lit(True))
    if prior is not None:
        active = prior if log is None else active_claims(prior, log)
        members = members.unionByName(known_claims(active).select(*columns).distinct().withColumn("is_new", F.lit(False)))
    members = materialize(members, "conflict-members")
    own = [*GROUP, "normalized_value"]
    classes = members.groupBy(*own).agg(F.min("claim_id").alias("class_id"), F.min("at").alias("first_at"), F.max(F.when(F.col("is_new"), F.col("at"))).alias("last_new"))
    rank = F.row_number().over(W.partitionBy(*GROUP).orderBy(F.col("last_new").desc_nulls_last(), "class_id"))
    of = lambda n, c: F.max(F.when(F.col("r") == n, F.col(c)))
    two = classes.withColumn("r", rank).where("r <= 2").groupBy(*GROUP).agg(of(1, "class_id").alias("latest"), of(1, "last_new").alias("latest_ms"), of(2, "class_id").alias("second"), of(2, "last_new").alias("second_ms"))
    split = classes.join(two.where("second is not null and latest_ms is not null"), GROUP)
    split = materialize(split.withColumn("others_ms", F.when(F.col("class_id") == F.col("latest"), F.col("second_ms")).otherwise(F.col("latest_ms"))), "conflict-classes")
    met = members.join(split.select(*own, "others_ms"), own).where("is_new or others_ms is not null")
    met = met.withColumn("moment", F.when(F.col("is_new"), F.greatest("at", "others_ms")).otherwise(F.col("others_ms")))
    state = code("claim_state", "contradicted")
    changes = met.select(deterministic_id("claim_state", F.lit(state), F.col("claim_id"), F.col("moment")).alias("id"), "claim_id", F.lit(state).alias("state"), F.col("moment").alias("changed_at_ms"), F.lit(DETECTOR).alias("actor"))

    c = split.select(*GROUP, "class_id", "first_at", F.col("last_new").isNotNull().alias("met"))
    a, b = (c.select(*GROUP, *(F.col(x).alias(f"{x}_{side}") for x in ("class_id", "first_at", "met"))) for side in "ab")
    pairs = a.join(b, GROUP).where("class_id_a < class_id_b and (met_a or met_b)").select("case_id", F.col("class_id_a").alias("class_a"), F.col("class_id_b").alias("class_b"), F.greatest("first_at_a", "first_at_b").alias("created_at_ms"))
    found = pairs.select(deterministic_id("contradiction", F.col("class_a"), F.col("class_b")).alias("id"), "case_id", "class_a", "class_b", F.lit("unresolved").alias("status"), F.lit("automatic").alias("detection_method"), "created_at_ms")

    def edges(rows: DataFrame, start: str, relationship: str, end: str, at: str) -> DataFrame:
        f, t = F.col(start).cast("string"), F.col(end).cast("string")
        kind = F.lit(code("relationship", relationship))
        return rows.select(deterministic_id("edge", f, kind, t).alias("id"), "case_id", F.lit("claim").alias("from_kind"), f.alias("from_id"), kind.alias("relationship"), F.lit("claim").alias("to_kind"), t.alias("to_id"), F.col(at).alias("created_at_ms"))

    same = members.where("is_new").join(classes.select(*own, "class_id"), own).where("claim_id <> class_id")
    all_edges = edges(same, "claim_id", "corroborates", "class_id", "at").unionByName(edges(pairs, "class_a", "contradicts", "class_b", "created_at_ms")).unionByName(edges(pairs, "class_b", "contradicts", "class_a", "created_at_ms"))
    return {"claim_state_changes": changes, "contradictions": found, "evidence_edges": all_edges}


def incremental_links(new: DataFrame, prior: DataFrame, log: DataFrame) -> DataFrame:
    """Classes that each new known claim meets: (claim_id, class_id, members, relationship) of the active
    prior claims (neither rejected nor superseded by ``log``) and of the other new ones, which are
    recorded with it. Claims are reduced to classes before the join; members counts all of the
    class but the claim itself, and a class that holds nothing else is left out."""
    columns = ["claim_id", *GROUP, "normalized_value"]
    n = known_claims(new).select(*columns)
    every = n.unionByName(known_claims(active_claims(prior, log)).select(*columns))
    met = n.withColumnRenamed("normalized_value", "own_value").join(value_classes(every), GROUP)
    same = F.col("own_value") == F.col("normalized_value")
    return met.select("claim_id", "class_id", (F.col("members") - F.when(same, 1).otherwise(0)).alias("members"), F.when(same, "corroborates").otherwise("contradicts").alias("relationship")).where("members > 0")
