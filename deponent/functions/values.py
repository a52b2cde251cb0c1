"""Typed values: the reading ladder of scalar texts, canonical JSON, checks of ids and dates.

All are Column expressions. Equality of values is equality of their canonical JSON: decimals are
compared by structure (1.0 is not 1.00), unknown is a value of its own and never SQL null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deponent.functions.text import ascii_lower, trim_ws

#: The kinds that ``kind`` gives.
KINDS = ("unknown", "boolean", "date", "money", "integer", "decimal", "text", "error")
#: Fixed value: most digits after the point.
MAX_SCALE = 18

_DECIMAL = r"^-?[0-9]+\.[0-9]+$"


def iso_date(c: Column) -> Column:
    """DATE of a text of exactly the form YYYY-MM-DD, years 1 to 9999, else null."""
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & (c >= "0001"), F.try_to_date(c, "yyyy-MM-dd"))


def add_days(day: Column, days: Column) -> Column:
    """Day plus days, null where the result leaves the years 1 to 9999 or days is too large."""
    moved = F.when(days.between(-3_652_059, 3_652_059), F.date_add(day, days.cast("int")))
    return F.when(F.year(moved).between(1, 9999), moved)


def _money_body(t: Column) -> Column:
    return F.regexp_replace(F.substring(t, 2, 2**31 - 1), ",", "")


def _coefficient(body: Column) -> Column:
    return F.regexp_replace(body, r"\.", "").try_cast("bigint")


def _scale(body: Column) -> Column:
    return F.length(F.substring_index(body, ".", -1))


def _fits(body: Column) -> Column:
    return body.rlike(_DECIMAL) & (_scale(body) <= MAX_SCALE) & _coefficient(body).isNotNull()


def kind_of_trimmed(t: Column) -> Column:
    """``kind`` of a text without white space at its ends, which is best a column or bound already."""
    low = ascii_lower(t)
    plain = F.when(t.rlike(r"^[+-]?[0-9]+$") & t.try_cast("bigint").isNotNull(), "integer").when(t.rlike(_DECIMAL), F.when(_fits(t), "decimal").otherwise("error"))
    return F.when(
        t.isNotNull(),
        F.when(low.isin("null", "unknown"), "unknown")
        .when(low.isin("true", "false"), "boolean")
        .when(iso_date(t).isNotNull(), "date")
        .when(t.startswith("$"), F.when(_fits(_money_body(t)), "money").otherwise("error"))
        # only what begins like a number can be one
        .when(t.rlike("^[-+]?[0-9]"), F.coalesce(plain, F.lit("text")))
        .otherwise("text"),
    )


def kind(c: Column) -> Column:
    """First rung of the ladder that takes the trimmed text; ``error`` for a text that begins as
    money or is written as a decimal but can't be one (no point, more than 18 digits after it,
    outside 64 bits). Null for null."""
    # a one-element array binds the trimmed text, so it is made once
    return F.transform(F.array(trim_ws(c)), kind_of_trimmed)[0]


def with_value(df: DataFrame, column: str) -> DataFrame:
    """``df`` with kind and normalized_value of a text column; each text is trimmed and classified once."""
    ready = df.withColumn("_trimmed", trim_ws(F.col(column))).withColumn("kind", kind_of_trimmed(F.col("_trimmed")))
    return ready.withColumn("normalized_value", normalized(F.col(column), F.col("kind"), F.col("_trimmed"))).drop("_trimmed")


def _known(type_: str, value: Column) -> Column:
    return F.concat(F.lit(f'{{"knowledge":"known","value":{{"type":"{type_}","value":'), value, F.lit("}}"))


def _decimal_json(body: Column) -> Column:
    return F.concat(F.lit('{"coefficient":'), _coefficient(body).cast("string"), F.lit(',"scale":'), _scale(body).cast("string"), F.lit("}"))


def normalized(c: Column, k: Column | None = None, t: Column | None = None) -> Column:
    """Canonical JSON of the value that a text holds, null for null and ``error`` texts. Text keeps
    its padding. ``k`` is its kind and ``t`` the trimmed text, where these are columns already."""
    t, k = trim_ws(c) if t is None else t, kind(c) if k is None else k
    day = F.concat(F.lit('{"year":'), F.substring(t, 1, 4).cast("int"), F.lit(',"month":'), F.substring(t, 6, 2).cast("int"), F.lit(',"day":'), F.substring(t, 9, 2).cast("int"), F.lit("}"))
    return (
        F.when(k == "unknown", F.lit('{"knowledge":"unknown"}'))
        .when(k == "boolean", _known("boolean", ascii_lower(t)))
        .when(k == "date", _known("date", day))
        .when(k == "money", _known("money", F.concat(F.lit('{"amount":'), _decimal_json(_money_body(t)), F.lit(',"currency":"USD"}'))))
        .when(k == "integer", _known("integer", t.try_cast("bigint").cast("string")))
        .when(k == "decimal", _known("decimal", _decimal_json(t)))
        .when(k == "text", F.to_json(F.struct(F.lit("known").alias("knowledge"), F.struct(F.lit("text").alias("type"), c.alias("value")).alias("value"))))
    )


def knowledge(json: Column) -> Column:
    """known, unknown, not_applicable or not_evaluated; null for anything else, also broken JSON."""
    k = F.try_variant_get(F.try_parse_json(json), "$.knowledge", "string")
    return F.when(k.isin("known", "unknown", "not_applicable", "not_evaluated"), k)


def value_type(json: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(json), "$.value.type", "string")


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def storage_key(sha: Column) -> Column:
    """Place of a blob by its content hash."""
    return F.concat(F.lit("blobs/"), F.substring(sha, 1, 2), F.lit("/"), sha)


def valid_storage_key(key: Column) -> Column:
    return F.coalesce(key.rlike(r"^blobs/[0-9a-f]{2}/[0-9a-f]{64}$") & (F.substring(key, 7, 2) == F.substring(key, 10, 2)), F.lit(False))


def valid_record_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9_-]{3,100}$"), F.lit(False))


def valid_sha256(c: Column) -> Column:
    """64 lower-case hexadecimal digits."""
    return F.coalesce(c.rlike(r"^[0-9a-f]{64}\z"), F.lit(False))


def valid_span(start: Column, end: Column) -> Column:
    """The end does not precede the start; a missing side is valid."""
    return F.coalesce(end >= start, F.lit(True))


def valid_model(provider: Column, *others: Column) -> Column:
    """A provider is given where a model's name, version or configuration is."""
    return provider.isNotNull() | F.coalesce(*others).isNull()


def valid_time(ms: Column) -> Column:
    """Not negative; a missing time is valid."""
    return F.coalesce(ms >= 0, F.lit(True))


def valid_text(c: Column, least: int, most: int) -> Column:
    """Trimmed length within bounds and no control character."""
    return F.coalesce(F.char_length(trim_ws(c)).between(least, most) & ~c.rlike(r"\p{Cc}"), F.lit(False))


def valid_filename(c: Column) -> Column:
    """A bare name of 1 to 255 characters: one path component, which slashes may follow, as they add none."""
    first = F.substring_index(c, "/", 1)
    return F.coalesce(valid_text(c, 1, 255) & c.rlike(r"^[^/]+(?:/+\.?)*$") & ~first.isin(".", ".."), F.lit(False))


def valid_decimal(coefficient: Column, scale: Column) -> Column:
    return F.coalesce(coefficient.isNotNull() & scale.between(0, MAX_SCALE), F.lit(False))


def valid_money(coefficient: Column, scale: Column, currency: Column) -> Column:
    """A decimal and three upper-case letters."""
    return valid_decimal(coefficient, scale) & F.coalesce(currency.rlike(r"^[A-Z]{3}\z"), F.lit(False))


def valid_confidence(c: Column) -> Column:
    """From 0 to 1; a missing one is valid, NaN isn't."""
    return F.coalesce((c >= 0) & (c <= 1), F.lit(True))


def deterministic_id(kind_: str, *parts: Column) -> Column:
    """``kind_`` and 32 hex digits of the hash of kind and parts, separated by zero bytes; the same
    for a repeated run, so retries add nothing."""
    zero = F.lit("\0")
    joined = F.concat(F.lit(kind_), *(x for p in parts for x in (zero, p.cast("string"))))
    return F.concat(F.lit(f"{kind_}_"), F.substring(sha256_hex(joined), 1, 32))


def classify(media_type: Column) -> Column:
    """text, json, csv or null (unsupported) by the type before ``;``, case-sensitive."""
    m = trim_ws(F.substring_index(media_type, ";", 1))
    return F.when(m == "text/plain", "text").when(m == "application/json", "json").when(m.isin("text/csv", "application/csv"), "csv")


def media_type_of(path: Column) -> Column:
    """Media type by a file's extension."""
    #: Extensions and their media types.
    known = {"txt": "text/plain", "json": "application/json", "csv": "text/csv", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}
    ext = ascii_lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    out = F.lit("application/octet-stream")
    for e, m in known.items():
        out = F.when(ext == e, m).otherwise(out)
    return out


def temporal_errors(t: Column) -> Column:
    """Faults of a temporal struct (kind, date, year, month, earliest, latest, inclusive, original)."""
    k = t["kind"]
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(k.isin("exact_date", "month", "year", "before", "after", "range", "unknown"), F.lit(False)), "kind"),
            F.when(k.isin("exact_date", "before", "after") & t["date"].isNull(), "date"),
            F.when(k.isin("month", "year") & ~F.coalesce(t["year"].between(1, 9999), F.lit(False)), "year"),
            F.when((k == "month") & ~F.coalesce(t["month"].between(1, 12), F.lit(False)), "month"),
            F.when((k == "range") & ~F.coalesce(t["earliest"] <= t["latest"], F.lit(False)), "range"),
        )
    )
