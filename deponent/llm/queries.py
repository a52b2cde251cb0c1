"""Queries of problems 2 and 6 to 8 over their whole tables, and their SQL. Problems 6 to 8 aren't
expressible in SQL; they are tested against other encoders, brute force and written examples in
tests/llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deponent.llm.encoding import encode_documents
from deponent.llm.mixing import mix_documents
from deponent.llm.spam import shape_profile, spam_documents
from deponent.llm.survivorship import ATTRIBUTES, best_records


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = encode_documents(_documents(spark, d), count_only=True, keep=("source",))
    return mix_documents(sized, spark.read.parquet(f"{d}/mix_targets.parquet"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return best_records(spark.read.parquet(f"{d}/provenance_records.parquet"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("survivor_id", "extracted_id", "confidence_id")


def p2_record(spark: SparkSession, d: str) -> DataFrame:
    """The surviving records themselves."""
    return _records(spark, d)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_documents(_documents(spark, d))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam_documents(_documents(spark, d))


def p8_shapes(spark: SparkSession, d: str) -> DataFrame:
    """The shapes of the whole crawl with their counts."""
    return shape_profile(_documents(spark, d))


_RANKED = r"""
WITH r AS (
  SELECT DISTINCT * REPLACE (lower(regexp_replace(source_field, '[\s_-]+', '', 'g')) AS source_field), source_field AS field,
    CASE lower(regexp_replace(verification_state, '^\s+|\s+$', '', 'g')) WHEN 'verified' THEN 0 WHEN 'corrected' THEN 1 WHEN 'rejected' THEN 3 ELSE 2 END AS state,
    CASE WHEN extracted_at_ms >= epoch_ms(TIMESTAMP '2015-01-01') AND extracted_at_ms < epoch_ms(TIMESTAMP '2027-01-01') THEN extracted_at_ms END AS t,
    CASE WHEN confidence >= 0 AND confidence <= 1 THEN confidence END AS c
  FROM provenance_records
), n AS (
  SELECT *, count(*) OVER g AS members,
    row_number() OVER (g ORDER BY state, t DESC NULLS LAST, c DESC NULLS LAST, id) AS a,
    row_number() OVER (g ORDER BY t DESC NULLS LAST, id) AS b,
    row_number() OVER (g ORDER BY c IS NULL, state, t DESC NULLS LAST, c DESC NULLS LAST, id) AS d
  FROM r WINDOW g AS (PARTITION BY artifact_version_id, page_number, paragraph_number, row_number, column_number, source_field)
)
"""
_IDS = """max(CASE WHEN a = 1 THEN id END) AS survivor_id,
  coalesce(max(CASE WHEN b = 1 AND t IS NOT NULL THEN id END), 'none') AS extracted_id,
  coalesce(max(CASE WHEN d = 1 AND c IS NOT NULL THEN id END), 'none') AS confidence_id"""
_GROUPED = "FROM n WHERE members > 1 GROUP BY artifact_version_id, page_number, paragraph_number, row_number, column_number, source_field"


def _best_sql(group: tuple[str, ...]) -> str:
    """Columns of one copy, the best whose first one isn't null."""
    written = {"source_field": "field"}
    first = written.get(group[0], group[0])
    return ", ".join(f"(arg_min({{'x': {written.get(c, c)}}}, a) FILTER ({first} IS NOT NULL)).x AS {c}" for c in group)


SQL: dict[str, str] = {
    "p2_found": f"{_RANKED} SELECT {_IDS} {_GROUPED}",
    "p2_record": f"{_RANKED} SELECT artifact_version_id, page_number, paragraph_number, row_number, column_number, {_IDS}, "
    + "['verified', 'corrected', 'not_reviewed', 'rejected'][min(state) + 1] AS verification_state, max(t) AS extracted_at_ms, "
    + f"max(CASE WHEN d = 1 THEN c END) AS confidence, {', '.join(map(_best_sql, ATTRIBUTES))} {_GROUPED}",
}

QUERIES = {f.__name__: f for f in (p2_found, p2_record, p6_ids, p7_mix, p7_shares, p8_found, p8_shapes)}
