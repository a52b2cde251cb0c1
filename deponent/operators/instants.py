"""Problem 3: date and time texts of many formats and zones, normalised through a dictionary.

Raw texts are deduplicated with what their reading depends on (zone and date order of their source)
into a distinct-value dictionary; only values that the dictionary doesn't hold yet are parsed, each
once, and appended to it; the normalised values are joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deponent.functions.instants import parse_instant
from deponent.functions.text import trim_ws
from deponent.session import materialize, scratch_path

_KEY = ["raw", "zone", "date_order"]
_ENTRY = "raw string, zone string, date_order string, n bigint, normalized string"
#: What every date or time text begins with: a number after at most two words.
BEGINNING = r"(?U)^(?:[\w&&[^0-9_]]+\.?,? ){0,2}[0-9]"
#: A value is hot if it holds more than this part of all rows, so at most 1 / HOT values are.
HOT = 1 / 1000


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, zones, orders = (b.column(n).to_pylist() for n in _KEY)
        out = [parse_instant(t, z, o) for t, z, o in zip(texts, zones, orders)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "normalized"])


def _known(wanted: DataFrame, path: str) -> DataFrame | None:
    """The dictionary at ``path``, None only where there is no such path: one that can't be read fails."""
    spark = wanted.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    found = spark.read.parquet(path)
    if set(found.columns) != {c.split()[0] for c in _ENTRY.split(", ")}:
        raise ValueError(f"{path} is no dictionary of instants")
    return found.select(*(c.split()[0] for c in _ENTRY.split(", ")))


def extend_dictionary(wanted: DataFrame, path: str) -> DataFrame:
    """Parse the (raw, zone, date_order) of ``wanted`` that the dictionary at ``path`` doesn't hold
    and append them; return the entries of ``wanted`` with this input's row counts. A run that is
    cut short appends nothing; a repeated run parses nothing."""
    old = _known(wanted, path)
    new = wanted if old is None else wanted.join(old.select(*_KEY), _KEY, "left_anti")
    new.select(*_KEY, "n").mapInArrow(_parse, _ENTRY).write.mode("append").parquet(path)
    return _entries(wanted, path)


def _entries(wanted: DataFrame, path: str) -> DataFrame:
    entries = wanted.sparkSession.read.schema(_ENTRY).parquet(path).select(*_KEY, "normalized")
    return entries.join(wanted, _KEY).select(*_KEY, "n", "normalized")


def normalise(rows: DataFrame, dictionary: str | None = None, one_by_one: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (table_name, record_key, raw, zone, date_order) to (table_name, record_key,
    normalized), one row for each resolvable value.

    The dictionary, at the path ``dictionary`` where it is kept for later runs, grows by the values of
    all tables at once, or first of those ``one_by_one``, each parsing only what the ones before it
    lacked. Values are counted once and looked up once, whatever the steps.

    Defined results: null, empty and digitless texts and prose of any length are not resolvable, white
    space of any length counts as one space; a null zone means no zone known, a null date order leaves
    numeric dates unresolvable; repeated rows come out once; an empty table gives no rows. A hot value
    (at most 1000 can be) is looked up by a broadcast of at most 1000 short entries and its rows are
    spread by record key, so no value gathers its rows in one task."""
    spark = rows.sparkSession
    raw = F.regexp_replace(trim_ws(F.col("raw")), r"(?U)[\s\x1c-\x1f]+", " ")
    cleaned = rows.select(
        F.col("table_name"),
        F.col("record_key"),
        raw.alias("raw"),
        F.coalesce("zone", F.lit("")).alias("zone"),
        F.coalesce("date_order", F.lit("")).alias("date_order"),
    ).where(F.col("raw").rlike(BEGINNING))
    kept = materialize(cleaned, "instant-rows")
    values = materialize(kept.groupBy("table_name", *_KEY).agg(F.count(F.lit(1)).alias("n")), "instant-values")
    path = dictionary or scratch_path(spark, "instant-dictionary")
    for name in one_by_one:
        extend_dictionary(values.where(F.col("table_name") == name), path)
    wanted = values.groupBy(*_KEY).agg(F.sum("n").alias("n"))
    rest = values.where(~F.coalesce(F.col("table_name").isin(*one_by_one), F.lit(False))) if one_by_one else values
    if not one_by_one or not rest.isEmpty():
        extend_dictionary(rest.groupBy(*_KEY).agg(F.sum("n").alias("n")), path)
    entries = materialize(_entries(wanted, path), "instant-entries")
    total = entries.agg(F.sum("n")).first()[0] or 0
    good = entries.where("normalized is not null")
    hot = good.where(F.col("n") > total * HOT).select(*_KEY, F.col("normalized").alias("hot_value"))
    cold = good.where(F.col("n") <= total * HOT).select(F.col("raw").alias("look_up"), "zone", "date_order", F.col("normalized").alias("cold_value"))
    spread = kept.join(F.broadcast(hot), _KEY, "left").withColumn("look_up", F.when(F.col("hot_value").isNull(), F.col("raw")).otherwise(F.concat(F.lit("\0"), "record_key")))
    found = spread.join(cold, ["look_up", "zone", "date_order"], "left").withColumn("normalized", F.coalesce("hot_value", "cold_value"))
    return found.where("normalized is not null").select("table_name", "record_key", "normalized").distinct()


def connector_of_versions(versions: DataFrame, artifacts: DataFrame, sources: DataFrame, connectors: DataFrame) -> DataFrame:
    """(version_id, received_at, zone, date_order), one row a version: the reading rules of the
    connector that its artifact's source came through. Missing links leave them null."""
    v = versions.select(F.col("id").alias("version_id"), "artifact_id", "received_at").where("version_id is not null").distinct()
    a = artifacts.select(F.col("id").alias("artifact_id"), "source_id").where("artifact_id is not null").distinct()
    s = sources.select(F.col("id").alias("source_id"), "connector").where("source_id is not null").distinct()
    c = connectors.select("connector", F.col("local_zone").alias("zone"), "date_order").where("connector is not null").distinct()
    return v.join(a.join(s.join(c, "connector"), "source_id"), "artifact_id", "left").select("version_id", "received_at", "zone", "date_order")
