"""Parquet tables of one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deponent.session import materialize


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """``<directory>/<name>.parquet``, a file or a folder of part files."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """A tab-separated table of exactly these columns, a file or several: its rows, and the lines that are
    no row of it (another number of cells, an empty or padded cell). Each file's first line that
    isn't empty is its header, by its place, so a row that reads like a header stays a row. Raises if
    there is no file with a line or a header isn't ``columns``."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = materialize(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), place.alias("place")).where("value <> ''"), "tsv-lines")
    heads = lines.groupBy("file").agg(F.min_by("value", "place").alias("head"), F.min("place").alias("first"))
    faults = heads.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("head") != "\t".join(columns)).alias("wrong")).first()
    if not faults["files"] or faults["wrong"]:
        raise ValueError(f"header of {path} isn't {columns}")
    cells = lines.join(heads, "file").where(F.col("place") != F.col("first")).select("value", F.split("value", "\t").alias("c"))
    ok = (F.size("c") == len(columns)) & F.forall("c", lambda x: (x != "") & (x == F.trim(x)))
    return cells.where(ok).select(*(F.col("c")[i].alias(n) for i, n in enumerate(columns))), cells.where(~ok).select("value")
