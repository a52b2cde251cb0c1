"""Problem 2: the best representative of each duplicate group, built field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deponent.functions.text import squeeze_name, trim_ws

#: States in order of trust; anything else counts as not_reviewed.
STATES = ("verified", "corrected", "not_reviewed", "rejected")
#: Usable times, 2015-01-01 up to and including 2026-12-31 (UTC), in epoch ms.
FIRST_MS, END_MS = 1_420_070_400_000, 1_798_761_600_000
#: Fixed value: columns that locate a record in its source, besides source_field.
LOCATION = ("artifact_version_id", "page_number", "paragraph_number", "row_number", "column_number")
#: Attributes of the surviving record. Columns that mean something only together come from one copy,
#: the best that has the first of them.
ATTRIBUTES = (
    ("connector",),
    ("endpoint",),
    ("external_record_id",),
    ("source_field",),
    ("text_span_start", "text_span_end"),
    ("table_number",),
    ("bounding_region_json",),
    ("extraction_method", "extractor_name", "extractor_version"),
    ("model_provider", "model_name", "model_version", "model_configuration_json"),
    ("original_representation",),
    ("correlation_id",),
)


def _best(usable: Column, order: tuple[Column, ...], *values: Column) -> Column:
    """The composite struct (ranks, id, values) of the best usable copy. Ranks are written so that
    smaller is better, as ids, of which the smaller wins, can't be negated: the greatest copy is the
    struct's minimum, one comparison that combines map-side."""
    return F.min(F.when(usable, F.struct(*(o.alias(f"k{i}") for i, o in enumerate(order)), F.col("id").alias("id"), *(v.alias(f"v{i}") for i, v in enumerate(values)))))


def best_records(records: DataFrame, attributes: tuple[tuple[str, ...], ...] = ATTRIBUTES) -> DataFrame:
    """One surviving record for each source location described by two or more record ids: the location,
    survivor_id, extracted_id and confidence_id, verification_state (of the survivor), extracted_at_ms,
    confidence and every column of ``attributes`` that ``records`` has.

    One aggregation, no window: each attribute is the best composite struct (non-null, source
    priority, timestamp, value) of its group, so map tasks send at most one row a group and a group
    of any size never meets in one task unaggregated; attributes that a query doesn't select aren't
    aggregated. Defined results: locations agree null-safe, source_field regardless of case, white
    space, ``-`` and ``_`` (a null one only with null; the surviving record has it as the best copy
    writes it); rows without id are ignored; redelivered rows count once; unusable times and
    confidences (null, NaN, out of range) rank last; ids are ``none`` and values null where no record
    has a usable one; ties go to the smaller id, then the smaller value; an empty table gives no rows;
    further columns are ignored."""
    state = F.lower(trim_ws(F.col("verification_state")))
    rank = F.coalesce(*(F.when(state == s, F.lit(i)) for i, s in enumerate(STATES)), F.lit(2))
    ms, conf = F.col("extracted_at_ms"), F.col("confidence")
    time_ok = F.coalesce((ms >= FIRST_MS) & (ms < END_MS), F.lit(False))
    conf_ok = F.coalesce((conf >= 0) & (conf <= 1), F.lit(False))
    late = F.when(time_ok, -ms).otherwise(F.lit(1))
    sure = F.when(conf_ok, -conf).otherwise(F.lit(1.0))
    kept = [g for g in attributes if set(g) <= set(records.columns)]
    own = [F.col(f"`{c}`").alias(f"a_{c}") for g in kept for c in g]
    prepared = records.where("id is not null").select(
        F.col("id").cast("string").alias("id"),
        *(F.col(c) for c in LOCATION),
        squeeze_name(F.col("source_field")).alias("place"),
        rank.alias("rank"),
        late.cast("bigint").alias("late"),
        sure.cast("double").alias("sure"),
        *own,
    )
    order = F.col("rank"), F.col("late"), F.col("sure")
    best = prepared.groupBy(*LOCATION, "place").agg(
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
        _best(F.lit(True), order).alias("s"),
        _best(F.col("late") <= 0, (F.col("late"),)).alias("t"),
        _best(F.col("sure") <= 0, order).alias("c"),
        *(_best(F.col(f"a_{g[0]}").isNotNull(), order, *(F.col(f"a_{c}") for c in g)).alias(f"b_{g[0]}") for g in kept),
    )
    values = [F.col(f"b_{g[0]}")[f"v{i}"].alias(c) for g in kept for i, c in enumerate(g)]
    return best.where("first_id <> last_id").select(
        *LOCATION,
        F.col("s.id").alias("survivor_id"),
        F.coalesce("t.id", F.lit("none")).alias("extracted_id"),
        F.coalesce("c.id", F.lit("none")).alias("confidence_id"),
        F.element_at(F.array(*(F.lit(s) for s in STATES)), F.col("s.k0") + 1).alias("verification_state"),
        (-F.col("t.k0")).alias("extracted_at_ms"),
        # 0 is added so that a confidence of 0 isn't -0
        (-F.col("c.k2") + 0.0).alias("confidence"),
        *values,
    )
