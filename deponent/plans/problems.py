"""Queries of the problems of the core, each over its whole tables, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deponent.functions.text import squeeze_name
from deponent.operators.history import History, version_updates
from deponent.operators.instants import connector_of_versions, normalise
from deponent.operators.rejects import split_records
from deponent.operators.wide import as_text, melted, wide_table
from deponent.session import materialize
from deponent.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split_records(table(spark, d, "uneven")).failed.select("line_id", "reason")


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    return split_records(table(spark, d, "uneven")).loaded.select("line_id", "row_number", "name", *(F.col(c).cast("string").alias(c) for c in ("received_date", "response_required")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    of = connector_of_versions(*(table(spark, d, t) for t in ("artifact_versions", "artifacts", "sources", "connectors")))
    of = materialize(of, "version-connector")
    rules = of.select("version_id", "zone", "date_order")
    holds = table(spark, d, "predicate_types").where("holds_time").select(squeeze_name(F.col("predicate")).alias("_p")).distinct()
    claims = table(spark, d, "extracted_fields").select(F.col("field_id").alias("k"), "artifact_version_id", F.col("original_value").alias("raw"), squeeze_name(F.col("predicate")).alias("_p"))
    records = table(spark, d, "simple_records").select(F.col("record_id").alias("k"), "artifact_version_id", F.col("received_date").alias("raw"))

    def rows(name: str, values: DataFrame) -> DataFrame:
        known = values.where("raw is not null and k is not null").withColumnRenamed("artifact_version_id", "version_id").join(rules, "version_id", "left")
        return known.select(F.lit(name).alias("table_name"), F.col("k").cast("string").alias("record_key"), "raw", "zone", "date_order")

    own = of.where("received_at is not null").select(F.lit("artifact_versions").alias("table_name"), F.col("version_id").alias("record_key"), F.col("received_at").alias("raw"), "zone", "date_order")
    columns = {"artifact_versions": own, "simple_records": rows("simple_records", records), "extracted_fields": rows("extracted_fields", claims.join(holds, "_p", "left_semi").drop("_p"))}
    return normalise(reduce(DataFrame.unionByName, columns.values()), one_by_one=tuple(columns))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    types = table(spark, d, "predicate_types")
    return melted(wide_table(table(spark, d, "extracted_fields"), types), types)


def p4_wide(spark: SparkSession, d: str) -> DataFrame:
    """The wide table itself, its typed cells as text."""
    types = table(spark, d, "predicate_types")
    return as_text(wide_table(table(spark, d, "extracted_fields"), types), types)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    updates = version_updates(table(spark, d, "artifact_versions"), table(spark, d, "artifacts"))
    return History(["case_id", "source_key"]).periods_by_batches(updates)


QUERIES = {f.__name__: f for f in (p1_found, p1_loaded, p3_found, p4_found, p4_wide, p5_found)}
