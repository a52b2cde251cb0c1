"""Problem 4: attribute-value rows into one typed row per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deponent.functions.text import hyphen_key, squeeze_name, trim_ws

#: Types of a value that a declared type takes.
TAKES = {"text": ("text",), "boolean": ("boolean",), "date": ("date",), "integer": ("integer",), "decimal": ("decimal", "integer"), "money": ("money", "decimal", "integer")}
#: Largest number of attributes of one wide table; beyond it a wide table is refused.
MAX_ATTRIBUTES = 5_000

_ENTITY = ["case_id", "subject_key"]
_VALUE = "struct<knowledge string, value struct<type string, value variant>>"
_PARTS = "struct<coefficient bigint, scale int, year int, month int, day int, amount struct<coefficient bigint, scale int>>"


def attribute_list(types: DataFrame) -> list[tuple[str, str]]:
    """(attribute, declared type) in order of the attribute's name; the column list of the wide
    table, so it must be known while planning. Its size is checked."""
    rows = types.where("predicate is not null").groupBy("predicate").agg(F.min("value_type").alias("value_type")).orderBy("predicate").limit(MAX_ATTRIBUTES + 1).collect()
    if len(rows) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes")
    return [(r["predicate"], r["value_type"]) for r in rows]


def _plain_decimal(c: Column) -> Column:
    """A decimal(38,18) as plain text without trailing zeros, never in scientific notation."""
    whole = F.floor(F.abs(c)).cast("decimal(20,0)")
    # 1 is added so that the text of the fraction, a decimal(19,18), has no exponent in any mode
    part = (F.abs(c) % F.lit(1).cast("decimal(1,0)")).cast("decimal(19,18)") + F.lit(1).cast("decimal(1,0)")
    frac = F.rtrim(F.substring_index(part.cast("string"), ".", -1), F.lit("0"))
    return F.concat(F.when(c < 0, "-").otherwise(""), whole.cast("string"), F.when(frac == "", "").otherwise(F.concat(F.lit("."), frac)))


def _typed(text: Column, kind: str) -> Column:
    t = {"text": "string", "boolean": "boolean", "date": "date", "integer": "bigint", "decimal": "decimal(38,18)", "money": "decimal(38,18)"}[kind]
    return text.try_cast(t)


def _as_text(c: Column, kind: str) -> Column:
    if kind in ("decimal", "money"):
        return _plain_decimal(c)
    return c.cast("string")


def latest_cells(claims: DataFrame, attributes: list[tuple[str, str]]) -> DataFrame:
    """(case_id, subject_key, position, cell): of each entity and attribute the cast text of the
    latest usable claim. Position null holds entities whose claims name no known attribute."""
    squeezed = squeeze_name(F.col("predicate"))
    spelled = {squeeze(p): i for i, (p, _) in enumerate(attributes)}
    position = F.try_element_at(F.create_map(*(F.lit(x) for pair in spelled.items() for x in pair)), squeezed) if spelled else F.lit(None).cast("int")
    kinds = F.array(*(F.lit(k) for _, k in attributes)) if attributes else F.array().cast("array<string>")
    # in an array, so that what follows a complete object makes it broken JSON, too
    whole = F.try_parse_json(F.concat(F.lit("["), F.col("normalized_value"), F.lit("]")))
    read = claims.select(
        F.col("case_id").cast("string").alias("case_id"),
        hyphen_key(F.col("subject_key")).alias("subject_key"),
        position.alias("position"),
        F.col("extracted_at_ms").cast("bigint").alias("at"),
        F.col("field_id").cast("bigint").alias("field_id"),
        F.col("normalized_value"),
    ).where("case_id is not null and subject_key is not null")
    read = read.withColumn("x", F.when(F.col("position").isNotNull(), F.try_variant_get(whole, "$[0]", _VALUE)))
    kept = [*_ENTITY, "position", "at", "field_id"]
    tagged = read.select(*kept, F.get(kinds, F.col("position")).alias("declared"), F.when(F.col("x.knowledge") == "known", F.col("x.value.type")).alias("tag"), F.col("x.value.value").alias("raw"))
    parts = tagged.select(*kept, "declared", "tag", "raw", F.when(F.col("tag").isin("money", "decimal", "date"), F.try_variant_get("raw", "$", _PARTS)).alias("n"))
    money = F.col("tag") == "money"
    numbers = parts.select(
        *kept,
        "declared",
        "tag",
        F.when(F.col("tag").isin("text", "boolean", "integer"), F.try_variant_get("raw", "$", "string")).alias("plain"),
        F.when(money, F.col("n.amount.coefficient")).otherwise(F.col("n.coefficient")).cast("decimal(20,0)").alias("c"),
        F.when(money, F.col("n.amount.scale")).otherwise(F.col("n.scale")).alias("s"),
        F.when(F.col("n.year").between(1, 9999), F.format_string("%04d-%02d-%02d", "n.year", "n.month", "n.day")).alias("day"),
    )
    digits = numbers.withColumn("digits", F.lpad(F.abs("c").cast("string"), F.greatest(F.length(F.abs("c").cast("string")), F.col("s") + 1), F.lit("0")))
    decimal = F.when(
        F.col("s").between(0, 18),
        F.concat(F.when(F.col("c") < 0, "-").otherwise(""), F.substring("digits", F.lit(1), F.length("digits") - F.col("s")), F.lit("."), F.substring("digits", F.length("digits") - F.col("s") + 1, F.col("s"))),
    )
    takes = F.coalesce(*(F.when(F.col("declared") == d, F.col("tag").isin(*tags)) for d, tags in TAKES.items()), F.lit(False))
    cell = F.when(
        takes,
        F.when(F.col("tag") == "text", trim_ws(F.col("plain")))
        .when(F.col("tag") == "boolean", F.when(F.col("plain").isin("true", "false"), F.col("plain")))
        .when(F.col("tag") == "integer", F.col("plain").try_cast("bigint").cast("string"))
        .when(F.col("tag") == "date", F.col("day").try_cast("date").cast("string"))
        .otherwise(decimal),
    )
    usable = digits.select(*kept, cell.alias("cell"))
    return usable.groupBy(*_ENTITY, "position").agg(F.max(F.when(F.col("cell").isNotNull(), F.struct("at", "field_id", "cell")))["cell"].alias("cell"))


def squeeze(name: str) -> str:
    """``squeeze_name`` for an attribute list, in Python."""
    return "".join(ch for ch in name if ch not in "-_" and not ch.isspace()).lower()


def wide_table(claims: DataFrame, types: DataFrame) -> DataFrame:
    """One row for each subject of a case, one typed column per attribute of ``types``.

    Claims are pre-aggregated to the latest usable cell of each entity and attribute (map-side
    combined: a hot entity never meets unaggregated) and brought together by entity, at most one cell
    an attribute. There the grid is completed: an entity has one element for each attribute
    position, in their order, that takes the value of its position, as a left join does, or null;
    fixed indices of this array are cast to the declared types. Claims are read once, and no row of
    the grid is shuffled.

    Defined results: keys that differ in case, padding or separators are one; an entity all of whose
    claims are unusable has a row of nulls; null case or subject: ignored; null, empty, broken or
    unknown values and values of a wrong type never win over a usable one; ties in time go to the
    larger field_id; repeated rows change nothing; null extracted_at_ms is the oldest; a decimal
    with more than 18 digits after the point, a number outside 64 bits or an impossible day is not
    of its type; unknown attributes are ignored; empty tables give an empty wide table."""
    attributes = attribute_list(types)
    return _project(_gathered(claims, attributes), attributes)


def _gathered(claims: DataFrame, attributes: list[tuple[str, str]]) -> DataFrame:
    values = F.map_from_entries(F.collect_list(F.when(F.col("position").isNotNull() & F.col("cell").isNotNull(), F.struct("position", "cell"))))
    by_entity = latest_cells(claims, attributes).groupBy(*_ENTITY).agg(values.alias("values"))
    grid = F.sequence(F.lit(0), F.lit(len(attributes) - 1)) if attributes else F.array().cast("array<int>")
    return by_entity.select(*_ENTITY, F.transform(grid, lambda position: F.try_element_at("values", position)).alias("cells"))


def _project(gathered: DataFrame, attributes: list[tuple[str, str]]) -> DataFrame:
    return gathered.select(*_ENTITY, *(_typed(F.col("cells")[i], kind).alias(p) for i, (p, kind) in enumerate(attributes)))


def as_text(wide: DataFrame, types: DataFrame) -> DataFrame:
    """A wide table with every cell as text: plain decimals, days as YYYY-MM-DD, true or false."""
    return wide.select(*_ENTITY, *(_as_text(F.col(f"`{p}`"), kind).alias(p) for p, kind in attribute_list(types)))


def melted(wide: DataFrame, types: DataFrame) -> DataFrame:
    """The non-null cells of a wide table as (case_id, subject_key, predicate, value_text)."""
    attributes = attribute_list(types)
    pairs = F.array(*(F.struct(F.lit(p).alias("predicate"), _as_text(F.col(f"`{p}`"), kind).alias("value_text")) for p, kind in attributes))
    return wide.select(*_ENTITY, F.explode(pairs).alias("x")).select(*_ENTITY, "x.predicate", "x.value_text").where("value_text is not null")
