"""Scans of artifacts: raw bytes, ``key: value`` text, flat JSON and CSV, to rows of fields.

A reader takes one text and gives its fields; it is plain Python, as byte offsets, the exact texts of
JSON numbers and quoted CSV cells are beyond the built-in parsers. ``extract`` reads each artifact
once, types its values as Column expressions and sets failed artifacts apart whole: one bad value
fails its artifact. Nothing is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deponent.functions.text import trim_ws
from deponent.functions.values import classify, kind_of_trimmed, media_type_of, normalized, sha256_hex, valid_text, with_value

#: Fixed value: default limit of an artifact's size.
MAX_BYTES = 26_214_400
#: The characters that count as white space at the ends of keys and values.
WHITE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Fixed value: deepest nesting of a JSON text.
MAX_DEPTH = 127
#: Fields that a reader's output batch holds about.
BATCH_FIELDS = 20_000

#: What a reader gives of each field, in this order.
FIELDS = {
    "subject_key": pa.string(),
    "predicate": pa.string(),
    "original_value": pa.string(),
    "source_field": pa.string(),
    "paragraph_number": pa.int32(),
    "text_span_start": pa.int64(),
    "text_span_end": pa.int64(),
    "row_number": pa.int32(),
    "column_number": pa.int32(),
}
FIELD_COLUMNS = ["artifact_id", *FIELDS]
_FIELD = "struct<subject_key string, predicate string, original_value string, source_field string, paragraph_number int, text_span_start bigint, text_span_end bigint, row_number int, column_number int>"
Reader = Callable[[str], list[tuple]]


def read_artifacts(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """Files as artifacts: (source_key, media_type, content, length, content_sha256), one row a file."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select(F.col("path").alias("source_key"), media_type_of(F.col("path")).alias("media_type"), "content", "length", sha256_hex(F.col("content")).alias("content_sha256"))


def decode_fault(content: Column, max_bytes: int = MAX_BYTES) -> Column:
    """Why bytes are no text: unreadable_artifact (none), too_large or malformed_input (no UTF-8)."""
    return F.when(content.isNull(), "unreadable_artifact").when(F.length(content) > max_bytes, "too_large").when(~F.is_valid_utf8(content.cast("string")), "malformed_input")


def decode(artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Artifacts with ``text``, and those whose ``content`` can't be one, with a reason."""
    checked = artifacts.withColumn("reason", decode_fault(F.col("content")))
    return checked.where("reason is null").withColumn("text", F.col("content").cast("string")).drop("reason", "content"), checked.where("reason is not null").select("artifact_id", "reason")


def text_fields(text: str) -> list[tuple]:
    """Lines of the form ``key: value``; spans are byte offsets in the whole text, of the value's first
    occurrence in its line. Lines without key or value are skipped."""
    out, offset, plain = [], 0, text.isascii()
    for number, raw in enumerate(text.split("\n"), 1):
        line = raw.rstrip("\r")
        key, colon, value = line.partition(":")
        if colon and (key := key.strip(WHITE)) and (value := value.strip(WHITE)):
            before = line[: line.index(value)]
            start = offset + (len(before) if plain else len(before.encode()))
            out.append(("document", key, value, key, number, start, start + (len(value) if plain else len(value.encode())), None, None))
        offset += (len(raw) if plain else len(raw.encode())) + 1
    return out


def _integer(digits: str) -> int | float:
    """An integer of 64 bits, signed or not; any other is a floating-point number, as is -0."""
    if len(digits) <= 20 and digits != "-0" and -(2**63) <= (n := int(digits)) < 2**64:
        return n
    return _float(digits)


def _float(digits: str) -> float:
    x = float(digits)
    if x in (float("inf"), float("-inf")):
        raise ValueError("number out of range")
    return x


def number_text(x: float) -> str:
    """The shortest text that reads back as ``x``: a point and a digit at least, an exponent only
    beyond 16 digits before the point or 5 after it."""
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    point = len(digits) + exponent
    body = "".join(map(str, digits))
    if not x:
        body = "0.0"
    elif 0 < point <= 16:
        body = body + "0" * exponent + ".0" if exponent >= 0 else f"{body[:point]}.{body[point:]}"
    elif -5 < point <= 0:
        body = "0." + "0" * -point + body
    else:
        body = body[:1] + ("." + body[1:] if len(body) > 1 else "") + f"e{point - 1}"
    return "-" * sign + body


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _depth(value: object) -> int:
    deepest, level = 0, [value]
    while level := [v for v in level if isinstance(v, (dict, list))]:
        deepest += 1
        level = [x for v in level for x in (v.values() if isinstance(v, dict) else v)]
    return deepest


def json_fields(text: str) -> list[tuple]:
    """Scalars of a top-level object, by key; arrays and objects are skipped, of a repeated key the last
    counts. Anything else than one object, whole, is malformed, also a string with half a surrogate
    pair, a number beyond the floating-point range and nesting deeper than MAX_DEPTH."""
    try:
        whole = json.loads(text, parse_int=_integer, parse_float=_float, parse_constant=_refuse)
    except RecursionError:
        raise ValueError("nested too deep") from None
    if not isinstance(whole, dict):
        raise ValueError("no object")
    if "\\u" in text:
        json.dumps(whole, ensure_ascii=False).encode()
    if text.count("[") + text.count("{") > MAX_DEPTH and _depth(whole) > MAX_DEPTH:
        raise ValueError("nested too deep")
    out = []
    for key in sorted(whole):
        v = whole[key]
        if not isinstance(v, (dict, list)):
            shown = v if isinstance(v, str) else number_text(v) if isinstance(v, float) else json.dumps(v)
            out.append(("document", key, shown, key, None, None, None, None, None))
    return out


def csv_records(text: str) -> list[list[str]]:
    """Records of a CSV text. A quote opens or closes quoting wherever it stands, two inside quotes are
    one; line ends inside quotes belong to the cell; records of empty cells only are dropped. Cut at
    quotes, every second part is quoted, and an empty part between two quoted ones is a quote sign."""
    parts = text.split('"')
    if len(parts) % 2 == 0:
        raise ValueError("open quote")
    records: list[list[str]] = []
    record: list[str] = []
    cell = ""
    for i, part in enumerate(parts):
        if i % 2:
            cell += part
        elif not part and 0 < i < len(parts) - 1:
            cell += '"'
        else:
            for n, line in enumerate(part.split("\n")):
                if n:
                    record.append(cell.removesuffix("\r"))
                    if any(record):
                        records.append(record)
                    record, cell = [], ""
                first, *rest = line.split(",")
                cell += first
                for c in rest:
                    record.append(cell)
                    cell = c
    if cell or record:
        records.append([*record, cell])
    return records


def csv_fields(text: str) -> list[tuple]:
    """Non-empty cells under a header row; no records give no fields. An open quote, a blank header or a
    row of another width is malformed."""
    records = csv_records(text)
    if not records:
        return []
    heads = [h.strip(WHITE) for h in records[0]]
    if not all(heads) or any(len(r) != len(heads) for r in records[1:]):
        raise ValueError("header or width")
    return [(f"row:{n}", head, v, head, None, None, None, n, c) for n, row in enumerate(records[1:], 1) for c, (head, v) in enumerate(zip(heads, row)) if v]


#: Readers by format; a caller may add one. A reader raises ValueError for a malformed text.
READERS: dict[str, Reader] = {"text": text_fields, "json": json_fields, "csv": csv_fields}


def _read(texts: DataFrame, readers: dict[str, Reader]) -> DataFrame:
    """(artifact_id, reason, fields) of texts (artifact_id, format, text, reason): each text is read once;
    one that has a reason already isn't."""
    struct = pa.struct(list(FIELDS.items()))
    names = ["artifact_id", "reason", "fields"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            columns = list(zip(*cells)) or [()] * len(FIELDS)
            values = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, FIELDS.values())], fields=list(struct))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(reasons, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=names)

        for b in batches:
            ids, reasons, ends, cells = [], [], [0], []
            for artifact, form, text, reason in zip(*(b.column(c).to_pylist() for c in ("artifact_id", "format", "text", "reason"))):
                if reason is None:
                    try:
                        cells += readers[form](text)
                    except ValueError:
                        reason = "malformed_input"
                ids.append(artifact)
                reasons.append(reason)
                ends.append(len(cells))
                if len(cells) >= BATCH_FIELDS:
                    yield batch()
                    ids, reasons, ends, cells = [], [], [0], []
            yield batch()

    return texts.mapInArrow(run, f"artifact_id string, reason string, fields array<{_FIELD}>")


def _scan(texts: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Fields of (artifact_id, text), and (artifact_id, reason) of malformed ones, a null text too."""
    given = texts.select(F.col("artifact_id").cast("string").alias("artifact_id"), F.lit(name).alias("format"), F.col("text").cast("string").alias("text"), F.when(F.col("text").isNull(), "malformed_input").alias("reason"))
    read = _read(given, READERS)
    return read.select("artifact_id", F.inline("fields")), read.where("reason is not null").select("artifact_id", "reason")


def scan_text(texts: DataFrame) -> DataFrame:
    return _scan(texts, "text")[0]


def scan_json(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _scan(texts, "json")


def scan_csv(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _scan(texts, "csv")


@dataclass(frozen=True)
class Extraction:
    """outcomes: (artifact_id, reason, fields) of each artifact, its fields typed where reason is null.
    A caller who needs both views writes them once and makes an Extraction of what was written."""

    outcomes: DataFrame

    @property
    def fields(self) -> DataFrame:
        """Typed fields of the artifacts read whole, one row each."""
        return self.outcomes.where("reason is null").select("artifact_id", F.inline("fields"))

    @property
    def failures(self) -> DataFrame:
        """(artifact_id, reason) of the others."""
        return self.outcomes.where("reason is not null").select("artifact_id", "reason")


def temporal(value: Column, t: Column, k: Column) -> Column:
    """The temporal value of a text (``t`` trimmed) of kind date: (kind, date, original), null for other kinds."""
    day = F.when(k == "date", F.try_to_date(t, "yyyy-MM-dd"))
    return F.when(k == "date", F.struct(F.lit("exact_date").alias("kind"), day.alias("date"), value.alias("original")))


def _typed(field: Column) -> Column:
    """A field with kind, normalized_value and temporal. One-element arrays bind the trimmed text and the
    kind, which are used many times."""
    value = field["original_value"]

    def with_kind(t: Column, k: Column) -> Column:
        return F.struct(*(field[c].alias(c) for c in FIELDS), k.alias("kind"), normalized(value, k, t).alias("normalized_value"), temporal(value, t, k).alias("temporal"))

    return F.transform(F.array(trim_ws(value)), lambda t: F.transform(F.array(kind_of_trimmed(t)), lambda k: with_kind(t, k))[0])[0]


def typed_fields(fields: DataFrame) -> DataFrame:
    """Fields with kind, canonical JSON and temporal value of their text."""
    typed = with_value(fields.withColumn("_t", trim_ws(F.col("original_value"))), "original_value")
    return typed.withColumn("temporal", temporal(F.col("original_value"), F.col("_t"), F.col("kind"))).drop("_t")


def extract(artifacts: DataFrame, readers: dict[str, Reader] | None = None, max_bytes: int = MAX_BYTES) -> Extraction:
    """Fields of artifacts (artifact_id, media_type, content, and content_sha256 where it is known).

    Reasons of failure, first that holds: unsupported_format (no reader for the media type),
    unreadable_artifact (no content, or content of another hash), too_large, malformed_input,
    no_observations, validation_rejected (a value that can't be typed, a value or predicate that is
    empty, too long or has control characters). An artifact fails whole. Each is read once, where it
    lies. Defined results: a null media type is unsupported; repeated artifacts are read each time; an
    empty table gives an empty outcome; further columns are ignored."""
    by_format = readers or READERS
    form, content = classify(F.col("media_type")), F.col("content").cast("binary")
    wrong = sha256_hex(content) != F.col("content_sha256") if "content_sha256" in artifacts.columns else F.lit(False)
    reason = F.when(~F.coalesce(form.isin(*by_format), F.lit(False)), "unsupported_format").when(F.coalesce(wrong, F.lit(False)), "unreadable_artifact").otherwise(decode_fault(content, max_bytes))
    tagged = artifacts.select(F.col("artifact_id").cast("string").alias("artifact_id"), form.alias("format"), content.alias("content"), reason.alias("reason"))
    read = _read(tagged.select("artifact_id", "format", F.when(F.col("reason").isNull(), F.col("content").cast("string")).alias("text"), "reason"), by_format)
    typed = read.select("artifact_id", "reason", F.transform("fields", _typed).alias("fields"))
    bad = F.exists("fields", lambda f: (f["kind"] == "error") | ~valid_text(f["original_value"], 1, 1_000_000) | ~valid_text(f["predicate"], 1, 300) | ~valid_text(f["subject_key"], 1, 300))
    return Extraction(typed.select("artifact_id", F.coalesce("reason", F.when(F.size("fields") == 0, "no_observations").when(bad, "validation_rejected")).alias("reason"), "fields"))
