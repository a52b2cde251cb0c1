"""Lookups and ordered lists over the tables of a ledger. An unknown key or case gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deponent.sources.ledger import Ledger

#: Tables and what the lists of a case are ordered by.
ORDERS = {
    "artifact_versions": ("created_at_ms", "version_number", "id"),
    "claims": ("created_at_ms", "id"),
    "contradictions": ("created_at_ms", "id"),
    "audit_events": ("occurred_at_ms", "id"),
    "rule_evaluations": ("evaluated_at_ms", "id"),
}


def ordered(rows: DataFrame, name: str) -> DataFrame:
    """Rows of a table in the order of its lists, by those of the columns that it has."""
    return rows.orderBy(*(c for c in ORDERS[name] if c in rows.columns))


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text in the column ``json``; nulls are written."""
    return rows.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), {"ignoreNullFields": "false"}).alias("json"))


class Repository:
    """What readers ask a ledger for; rows of batches that are delivered twice come out once."""

    def __init__(self, ledger: Ledger):
        self.ledger = ledger

    def table(self, name: str) -> DataFrame:
        found = self.ledger.read(name)
        if found is None:
            raise ValueError(f"the ledger has no {name}")
        return found.distinct()

    def get(self, name: str, **keys: str | int) -> DataFrame:
        """Rows of a table with these values, such as ``get("claims", id=...)``,
        ``get("artifacts", case_id=..., source_key=...)`` or
        ``get("artifact_versions", artifact_id=..., content_sha256=...)``. The filters reach the scan."""
        rows = self.ledger.read(name)
        if rows is None:
            raise ValueError(f"the ledger has no {name}")
        for column, value in keys.items():
            rows = rows.where(F.col(column) == F.lit(value))
        return rows.distinct()

    def of_case(self, name: str, case_id: str) -> DataFrame:
        """The list of a table for one case, ordered."""
        return ordered(self.get(name, case_id=case_id), name)
