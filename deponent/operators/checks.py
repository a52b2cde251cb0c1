"""Integrity: constraint violations as rows, existence splits, quality of an extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose non-null ``key`` has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys (without nulls) of more than one row: (keys, n)."""
    return df.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """(constraint, n): of each named frame of violating rows, how many there are."""
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("constraint"), "n") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, counted)


def failing(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with ``errors``, the names of the rules that a row breaks (a rule that is null is broken)."""
    return df.withColumn("errors", F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()))))


def split_existing(requests: DataFrame, key: str, known: DataFrame, known_key: str) -> tuple[DataFrame, DataFrame]:
    """Requests whose key exists, and the ones not found."""
    ids = known.select(F.col(known_key).alias(key)).distinct()
    return requests.join(ids, key, "left_semi"), requests.join(ids, key, "left_anti")


def extraction_quality(expected: DataFrame, extracted: DataFrame) -> DataFrame:
    """One row: expected (subject_key, predicate, type) against extracted fields: counts of fields, of
    right predicates, known typed values, complete locations and unsupported fields."""
    located = F.col("row_number").isNotNull() | F.col("text_span_start").isNotNull() | F.col("source_field").isNotNull()
    joined = extracted.withColumn("_got", F.lit(True)).join(expected.withColumn("_want", F.lit(True)), ["subject_key", "predicate"], "full")
    return joined.agg(
        F.count("_want").alias("expected"),
        F.count("_got").alias("extracted"),
        F.count_if(F.col("_want") & F.col("_got")).alias("right_predicates"),
        F.count_if(F.col("_want") & (F.col("kind") == F.col("type"))).alias("right_types"),
        F.count_if(F.col("_got") & located).alias("located"),
        F.count_if(F.col("_got") & F.col("_want").isNull()).alias("unsupported"),
    )
