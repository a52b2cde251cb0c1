"""Problem 1: load the valid records of raw CSV files, set the faulty ones apart with a reason.

Records of files are assembled quote-aware from their physical lines by running totals of quotes
(``read_records``); records that come one a row are assembled in the row. Stage one runs in Python,
once per partition: each record is parsed by the ``csv`` module in strict mode, whose structural
exceptions are the verdicts. Stage two joins each record with the layout of its own file and runs the
typed field constructors as Column expressions, so the join and the checks stay in the JVM.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deponent.functions.text import squeeze_name, trim_ws
from deponent.operators.prefix import prefix_sum
from deponent.session import materialize

#: Spellings of a column (squeezed) that the typed fields are taken from.
NAME, AMOUNT, RECEIVED, RESPONSE = ("name",), ("amount", "monthlyamount"), ("receiveddate",), ("responserequired",)
#: Texts that stand for a missing value.
MISSING = ("", "null", "unknown")

#: A quoted cell, with the comma before it, in a record that the strict reader takes.
_QUOTED_CELL = re.compile(r'(?:\A|,)"(?:[^"]++|"")*+"')
#: Signs that may stand for a line break while a record is read.
_STANDING_IN = range(0xE000, 0xF8FF)


def assemble_records(lines: Iterable[str]) -> Iterator[str]:
    """Join physical lines into records: a line break inside an open quote belongs to the record.

    A record whose quote never closes comes out as one last, open record. Line ends outside quotes
    are removed, a carriage return before them too."""
    held: list[str] = []
    is_open = False
    for line in lines:
        held.append(line)
        is_open ^= bool(line.count('"') & 1)
        if not is_open:
            yield "".join(held).rstrip("\r\n")
            held.clear()
    if held:
        yield "".join(held)


def parse_record(record: str) -> list[str]:
    """Cells of one record, by the strict csv reader; what it raises (csv.Error on an open quote or on
    text after a closing one) is raised. It needs help twice: line breaks, which it takes for the end
    of a record, are read as other signs and put back; text before an opening quote, which it lets
    pass, leaves a quote outside the quoted cells and raises."""
    breaks = {}
    if "\n" in record or "\r" in record:
        unused = (chr(c) for c in _STANDING_IN if chr(c) not in record)
        breaks = {next(unused): b for b in "\r\n"}
        for sign, b in breaks.items():
            record = record.replace(b, sign)
    cells = next(csv.reader([record], strict=True), [])
    if '"' in record and '"' in _QUOTED_CELL.sub("", record):
        raise csv.Error("text before an opening quote")
    for sign, b in breaks.items():
        cells = [c.replace(sign, b) for c in cells]
    return cells


def parse_header(record: str) -> list[str]:
    """Cells of a header, which isn't judged: what the strict reader refuses is read leniently."""
    record = record.removeprefix("\ufeff")
    try:
        return parse_record(record)
    except csv.Error:
        return next(csv.reader([record.replace("\r", " ").replace("\n", " ")], skipinitialspace=True), [])


def _record(raw: str) -> str:
    """The record that a raw line holds. Assembled by its quotes it is one; breaks outside quotes, of
    which there should be none, don't cut it."""
    lines = re.split(r"(?<=\n)", raw) if "\n" in raw else [raw]
    records = list(assemble_records(line for line in lines if line))
    return records[0] if len(records) == 1 else raw.rstrip("\r\n")


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(sys.maxsize)
    kind, kept = pa.list_(pa.string()), ["line_id", "file_id", "row_number", "digest"]
    for batch in batches:
        cells: list[list[str] | None] = []
        faults: list[str | None] = []
        for number, raw in zip(batch.column("row_number").to_pylist(), batch.column("raw_line").to_pylist()):
            got, fault = None, None
            try:
                got = parse_header(_record(raw)) if number == 0 else parse_record(_record(raw))
            except csv.Error:
                fault = "quoting"
            cells.append(got)
            faults.append(fault)
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(cells, kind), pa.array(faults, pa.string())], names=[*kept, "cells", "fault"])


@dataclass(frozen=True)
class Split:
    """loaded: record rows with typed columns; failed: (line_id, file_id, row_number, reason, digest) of
    records with their reason. ``failed_texts`` joins the raw text, for callers who need it."""

    loaded: DataFrame
    failed: DataFrame
    records: DataFrame

    def failed_texts(self) -> DataFrame:
        """``failed`` with raw_line, of copies that differ in their line end the smallest."""
        keys = ["line_id", "file_id", "row_number", "digest"]
        texts = self.records.groupBy(*keys).agg(F.min("raw_line").alias("raw_line"))
        f, t = self.failed.alias("f"), texts.alias("t")
        same = [F.col(f"f.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
        return f.join(t, reduce(lambda a, b: a & b, same)).select("f.line_id", "f.file_id", "f.row_number", "f.reason", "t.raw_line")


def assemble_lines(lines: DataFrame, order: list[str]) -> DataFrame:
    """Physical lines (file_id, line, columns of ``order`` that sort a file's lines) to records (file_id,
    row_number from 0, raw_line, n_lines, is_open).

    A line break belongs to the record if a quote is open there, which the parity of all quotes
    before it in the file tells: a running total, as is the number of the record. Both are
    distributed prefix sums, so a file of any size is cut by many tasks. Of a record whose quote
    never closes, the rest of its file, only the first line is kept, with is_open and its number of
    lines. Null lines are empty ones."""
    counted = lines.withColumn("line", F.coalesce("line", F.lit(""))).withColumn("odd", F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))).withColumn("odd", F.col("odd") % 2)
    opened = prefix_sum(counted.select("file_id", *order, "line", "odd"), ["file_id"], order, F.col("odd"), "opened").withColumn("starts", (F.col("opened") % 2 == 0).cast("int"))
    numbered = prefix_sum(opened, ["file_id"], order, F.col("starts"), "before").withColumn("row_number", (F.col("before") + F.col("starts") - 1).cast("int"))
    numbered = materialize(numbered.select("file_id", *order, "line", "odd", "starts", "row_number"), "record-lines")
    never = numbered.groupBy("file_id", "row_number").agg(F.sum("odd").alias("odd")).where("odd % 2 = 1").select(F.col("file_id").alias("_file"), F.col("row_number").alias("_row"))
    tagged = numbered.join(never, F.col("file_id").eqNullSafe(F.col("_file")) & (F.col("row_number") == F.col("_row")), "left").withColumn("is_open", F.col("_row").isNotNull())
    kept = F.collect_list(F.when(~F.col("is_open") | (F.col("starts") == 1), F.struct(*order, "line")))
    grouped = tagged.groupBy("file_id", "row_number").agg(F.array_sort(kept).alias("parts"), F.count(F.lit(1)).alias("n_lines"), F.bool_or("is_open").alias("is_open"))
    return grouped.select("file_id", "row_number", F.array_join(F.transform("parts", lambda x: x["line"]), "\n").alias("raw_line"), "n_lines", "is_open")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """CSV files as the records that ``split_records`` takes (line_id, artifact_version_id: the file's
    path, row_number: 0 is the header, raw_line), whatever a file's size: files are read in splits,
    in which lines keep their order. A record that never closes keeps its first line and fails."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")
    )
    records = assemble_lines(lines, ["block", "at"])
    return records.select(F.xxhash64("file_id", "row_number").alias("line_id"), F.col("file_id").alias("artifact_version_id"), "row_number", "raw_line")


def _position(names: Column, accepted: tuple[str, ...]) -> Column:
    found = [F.array_position(names, n) for n in accepted]
    return F.coalesce(*(F.when(p > 0, p) for p in found))


def _missing(c: Column) -> Column:
    return F.lower(c).isin(*MISSING)


def checked_records(lines: DataFrame, *, file_col: str = "artifact_version_id") -> DataFrame:
    """Every data record of ``lines`` (line_id, <file_col>, row_number, raw_line), parsed, joined
    with its file's header and checked: columns line_id, file_id, row_number, digest (of the text
    but for its line end), reason and the typed fields. ``reason`` is null for a valid record."""
    return _checked(_picked(lines, file_col))


def _picked(lines: DataFrame, file_col: str) -> DataFrame:
    raw = F.col("raw_line").cast("string")
    return lines.select(
        F.col("line_id").cast("bigint").alias("line_id"),
        F.col(file_col).cast("string").alias("file_id"),
        F.col("row_number").cast("int").alias("row_number"),
        raw.alias("raw_line"),
        F.unhex(F.md5(F.rtrim(raw, F.lit("\r\n")))).alias("digest"),
    ).where(trim_ws(F.col("raw_line")) != "")


def _checked(picked: DataFrame) -> DataFrame:
    schema = "line_id bigint, file_id string, row_number int, digest binary, cells array<string>, fault string"
    heads = (
        picked.where("row_number = 0")
        .mapInArrow(_parse_batches, schema)
        .where("cells is not null and file_id is not null")
        .groupBy("file_id")
        .agg(F.min_by("cells", "line_id").alias("head"))
        .select("file_id", F.transform("head", squeeze_name).alias("names"))
        .select(
            "file_id",
            F.size("names").alias("width"),
            *(_position(F.col("names"), accepted).alias(c) for c, accepted in (("p_name", NAME), ("p_amount", AMOUNT), ("p_received", RECEIVED), ("p_response", RESPONSE))),
        )
    )
    rows = picked.where("row_number is null or row_number <> 0").mapInArrow(_parse_batches, schema)

    def cell(p: str) -> Column:
        return trim_ws(F.get("cells", F.col(p) - 1))

    typed = rows.join(heads, "file_id", "left").withColumns({"c_name": cell("p_name"), "c_amount": cell("p_amount"), "c_received": cell("p_received"), "c_response": cell("p_response")})
    name, amount, day, answer = (F.col(c) for c in ("c_name", "c_amount", "c_received", "c_response"))
    day_ok = day.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & (day >= "0001") & F.try_to_date(day, "yyyy-MM-dd").isNotNull()
    amount_ok = amount.rlike(r"^-?[0-9]+(\.[0-9]{1,18})?$") | amount.rlike(r"^\$([0-9]+|[0-9]{1,3}(,[0-9]{3})+)\.[0-9]{1,18}$")
    bad_value = (
        F.coalesce((name == "") | name.rlike(r"[\p{Cc}&&[^\r\n]]"), F.lit(False))
        | F.coalesce(~_missing(amount) & ~amount_ok, F.lit(False))
        | F.coalesce(~_missing(day) & ~day_ok, F.lit(False))
        | F.coalesce(~_missing(answer) & ~F.lower(answer).isin("true", "false"), F.lit(False))
    )
    return typed.select(
        "line_id",
        "file_id",
        "row_number",
        "digest",
        F.when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("width").isNull() | (F.size("cells") != F.col("width")), "columns").when(bad_value, "value").alias("reason"),
        name.alias("name"),
        F.when(~_missing(amount), amount).alias("amount_text"),
        F.expr("try_cast(regexp_replace(c_amount, '[$,]', '') as decimal(38,18))").alias("amount"),
        F.when(day_ok, F.try_to_date(day, "yyyy-MM-dd")).alias("received_date"),
        F.when(F.lower(answer).isin("true", "false"), F.lower(answer) == "true").alias("response_required"),
    )


def split_records(lines: DataFrame, *, file_col: str = "artifact_version_id") -> Split:
    """Separate loaded rows from failed records.

    Reasons, first that holds: ``quoting`` (open quote or text beside a quoted cell), ``columns`` (another number of cells than the file's header, or no readable
    header), ``value`` (a typed field can't be built). Defined results: header rows (row_number 0)
    and blank or null raw lines are neither loaded nor failed; a null row_number is a data record; a
    null or headerless file fails as ``columns``; of several headers of a file that of the smallest
    line_id counts; redelivered copies (same line_id, file, row_number and raw line but for its
    line end, where null equals null) come out once; a null line_id or one of several different
    records merges nothing, each of them is loaded or failed; texts of any length are parsed whole; an empty table gives two empty tables; further input columns are ignored, whatever their
    names. The row-to-header join is on a unique key, so a file that holds a large share of all rows
    is split by adaptive execution without changing the result."""
    records = _picked(lines, file_col)
    checked = _checked(records)
    failed = checked.where("reason is not null").select("line_id", "file_id", "row_number", "reason", "digest").distinct()
    loaded = checked.where("reason is null").drop("reason").distinct().drop("digest")
    return Split(loaded, failed, records)
