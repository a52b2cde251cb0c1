"""From bytes to claims: checked requests, versions, extraction, evidence rows and conflicts in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deponent.functions.values import deterministic_id, sha256_hex, storage_key
from deponent.operators.claims import audit, fan_out, record_conflicts
from deponent.operators.ingest import check_requests, dispositions
from deponent.session import materialize
from deponent.sources.scans import Extraction, Reader, extract, read_artifacts

#: Name and version under which extracted fields are recorded.
EXTRACTOR = ("core", "1")


def file_requests(spark: SparkSession, path: str, case_id: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """Files as requests for ``ingest_claims``: a file's path is its source key and locator, its extension
    tells the media type."""
    files = read_artifacts(spark, path, glob, recursive)
    name = F.element_at(F.split("source_key", "/"), -1)
    return files.select(F.xxhash64("source_key").alias("seq"), F.lit(case_id).alias("case_id"), "source_key", F.lit("filesystem").alias("connector"), F.col("source_key").alias("locator"), "media_type", name.alias("original_filename"), "content")


def ingest_claims(
    requests: DataFrame,
    cases: DataFrame,
    *,
    at_ms: int,
    actor: str,
    connector: str,
    existing: DataFrame | None = None,
    prior: DataFrame | None = None,
    log: DataFrame | None = None,
    readers: dict[str, Reader] | None = None,
) -> dict[str, DataFrame]:
    """Requests (seq, case_id, source_key, connector, locator, media_type, original_filename, content) to
    all rows they make: artifact_versions, the tables of ``fan_out``, claim_state_changes and
    contradictions with ``prior`` claims, audit_events, and refused (seq, reason) and failures
    (artifact_version_id, reason).

    Content that its (case_id, source_key) has already, here or in ``existing`` (case_id, source_key,
    content_sha256, version_number), is no new version and is not extracted again; one audit event
    tells of its duplicates. Each new version's
    bytes are read once. An artifact fails whole, after its version is kept."""
    accepted, refused = check_requests(requests, cases)
    hashed = accepted.withColumn("content_sha256", sha256_hex(F.col("content")))
    placed = dispositions(hashed.select("seq", "case_id", "source_key", "content_sha256"), existing)
    placed = materialize(placed.select("seq", "case_id", "source_key", "content_sha256", "version_number", "disposition"), "pipeline-placed")
    fresh = placed.where("disposition <> 'exact_duplicate'").select("seq", "version_number", "disposition")
    version_id = deterministic_id("artifact_version", F.col("case_id"), F.col("source_key"), F.col("content_sha256"))
    versions = hashed.join(fresh, "seq").withColumn("version_id", version_id)
    again = placed.where("disposition = 'exact_duplicate'").groupBy("case_id", version_id.alias("version_id")).agg(F.count(F.lit(1)).alias("n"))
    outcomes = extract(versions.select(F.to_json(F.struct("version_id", "case_id")).alias("artifact_id"), "media_type", "content"), readers).outcomes
    owner = F.from_json("artifact_id", "version_id string, case_id string")
    read = Extraction(materialize(outcomes.withColumn("_o", owner).select("artifact_id", "_o.version_id", "_o.case_id", "reason", "fields"), "pipeline-outcomes"))
    fields = read.outcomes.where("reason is null").select("version_id", "case_id", F.inline("fields"))
    made = fan_out(fields, F.col("case_id"), F.col("version_id"), connector, EXTRACTOR, at_ms, actor)
    claims = made["claims"].withColumnRenamed("id", "claim_id")
    found = record_conflicts(claims, prior, log)
    at = F.lit(at_ms).cast("bigint")
    kept = versions.select(F.col("version_id").alias("id"), "case_id", "source_key", "version_number", "content_sha256", F.octet_length("content").cast("bigint").alias("content_length"), "media_type", storage_key(F.col("content_sha256")).alias("storage_key"), at.alias("ingested_at_ms"), "original_filename", "disposition")
    events = [audit(kept.where(F.col("disposition") == d), operation, F.col("id"), at, F.lit(actor)) for d, operation in (("new_artifact", "artifact.ingest"), ("new_version", "artifact.version"))]
    events.append(audit(again, "artifact.duplicate", F.col("version_id"), at, F.lit(actor)))
    edge_columns = ["from_kind", "from_id", "relationship", "to_kind", "to_id", "created_at_ms"]
    return {
        **made,
        "artifact_versions": kept,
        "claim_state_changes": found["claim_state_changes"],
        "contradictions": found["contradictions"],
        "evidence_edges": made["evidence_edges"].select(*edge_columns).unionByName(found["evidence_edges"].select(*edge_columns)),
        "audit_events": reduce(DataFrame.unionByName, [made["audit_events"], *events]),
        "refused": refused.select("seq", "reason"),
        "failures": read.outcomes.where("reason is not null").select(F.col("version_id").alias("artifact_version_id"), "reason"),
    }
