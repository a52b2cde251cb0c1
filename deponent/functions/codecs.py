"""Closed sets of names that rows are written with; anything else is a failure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names of each set.
CODES = {
    "case_status": ("open", "suspended", "closed"),
    "verification_state": ("not_reviewed", "verified", "rejected", "corrected"),
    "origin": ("external", "human", "rule", "system"),
    "claim_state": ("observed", "extracted", "inferred", "corroborated", "disputed", "contradicted", "superseded", "verified", "rejected", "unresolved"),
    "contradiction_status": ("unresolved", "resolved", "superseded"),
    "detection_method": ("automatic", "human"),
    "decision": ("verified", "rejected", "corrected", "needs_more_evidence"),
    "evidence_kind": ("artifact_excerpt", "structured_field", "human_attestation", "rule_result"),
    "relationship": ("supported_by", "contradicted_by", "corroborates", "contradicts", "supersedes", "involves", "created_by", "applies_to", "satisfies", "produces"),
    "rule_result": ("satisfied", "not_satisfied", "indeterminate"),
    "answer_mode": ("established", "claimed", "suggested", "conflicting", "unknown"),
    "operation": ("case.create", "artifact.ingest", "artifact.version", "artifact.duplicate", "claim.record", "claim.review", "claim.correct", "rule.register", "rule.evaluate"),
    "failure": ("invalid_input", "not_found", "conflict", "unsupported", "too_large", "storage", "internal"),
    "extraction_failure": ("unsupported_format", "unreadable_artifact", "malformed_input", "no_observations", "validation_rejected", "internal"),
}


def is_code(c: Column, name: str) -> Column:
    """Whether a name is one of its set; false for null."""
    return F.coalesce(c.isin(*CODES[name]), F.lit(False))


def code(name: str, value: str) -> str:
    """``value``, which has to be one of its set."""
    if value not in CODES[name]:
        raise ValueError(f"{value} is no {name}")
    return value
