"""Content-addressed ingestion: dispositions, version numbers, sources, blobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deponent.functions.codecs import code
from deponent.functions.values import deterministic_id, sha256_hex, storage_key, valid_filename, valid_storage_key, valid_text
from deponent.operators.claims import audit
from deponent.operators.prefix import prefix_sum
from deponent.sources.scans import MAX_BYTES


def create_cases(requests: DataFrame, at_ms: int) -> dict[str, DataFrame]:
    """Requests (title, actor) as open cases with ids made from their content, their audit_events, and
    the refused ones: title and actor take 1 to 300 characters without control characters."""
    ok = valid_text(F.col("title"), 1, 300) & valid_text(F.col("actor"), 1, 300)
    at = F.lit(at_ms).cast("bigint")
    made = requests.where(ok).select(deterministic_id("case", F.col("title"), F.col("actor"), at).alias("id"), "title", "actor")
    return {
        "cases": made.select("id", "title", F.lit(code("case_status", "open")).alias("status"), at.alias("created_at_ms"), F.lit("{}").alias("metadata_json")),
        "audit_events": audit(made.withColumn("case_id", F.col("id")), "case.create", F.col("id"), at, F.col("actor")),
        "refused": requests.where(~ok).withColumn("reason", F.lit(code("failure", "invalid_input"))),
    }


def dispositions(deliveries: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Disposition and version number of each delivery (case_id, source_key, content_sha256, seq).

    Under one (case_id, source_key), content met first is version max + 1 (``new_artifact`` for the
    key's first, else ``new_version``), content known there is an ``exact_duplicate`` of its version.
    ``existing`` (case_id, source_key, content_sha256, version_number) is what the ledger holds. First
    deliveries are found by aggregation and numbered by a distributed prefix count, so a hot key is
    no task of its own."""
    keys, content = ["case_id", "source_key"], ["case_id", "source_key", "content_sha256"]
    first = deliveries.groupBy(*content).agg(F.min("seq").alias("first_seq"))
    if existing is None:
        new = first.withColumn("top", F.lit(0))
        old = None
    else:
        old = existing.groupBy(*content).agg(F.min("version_number").alias("version_number"))
        top = existing.groupBy(*keys).agg(F.max("version_number").alias("top"))
        new = first.join(old, content, "left_anti").join(top, keys, "left").withColumn("top", F.coalesce("top", F.lit(0)))
    numbered = prefix_sum(new, keys, ["first_seq", "content_sha256"], F.lit(1), "before").select(*content, "first_seq", (F.col("top") + F.col("before") + 1).cast("int").alias("version_number"))
    if old is not None:
        numbered = numbered.unionByName(old.select(*content, F.lit(None).cast("bigint").alias("first_seq"), F.col("version_number").cast("int").alias("version_number")))
    met = deliveries.join(numbered, content)
    is_first = F.coalesce(F.col("seq") == F.col("first_seq"), F.lit(False))
    return met.withColumn("disposition", F.when(~is_first, "exact_duplicate").when(F.col("version_number") == 1, "new_artifact").otherwise("new_version")).drop("first_seq")


def check_requests(requests: DataFrame, cases: DataFrame | None = None, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Ingest requests (source_key, connector, locator, media_type, original_filename, content and, where
    ``cases`` are given, case_id) split before anything is stored into accepted ones and refused ones
    with their reason: texts out of bounds, then size, then a case that isn't there. A missing
    file name or content is no fault."""
    short = [~valid_text(F.col(c), 1, most) for c, most in (("source_key", 2048), ("connector", 100), ("locator", 2048), ("media_type", 255))]
    named = F.col("original_filename").isNotNull() & ~valid_filename(F.col("original_filename"))
    reason = F.when(reduce(lambda a, b: a | b, short) | named, code("failure", "invalid_input")).when(F.octet_length("content") > max_bytes, code("failure", "too_large"))
    checked = requests.withColumn("reason", reason)
    if cases is not None:
        there = cases.select(F.col("id").alias("case_id"), F.lit(True).alias("_there")).where("case_id is not null").distinct()
        checked = checked.join(there, "case_id", "left").withColumn("reason", F.when(F.col("reason").isNull() & F.col("_there").isNull(), code("failure", "not_found")).otherwise(F.col("reason"))).drop("_there")
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null")


def upsert_sources(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of ``new`` to append to ``existing``: those whose (case_id, connector, locator,
    source_revision) isn't there yet, one for each. A null revision never collides: such rows are all
    new."""
    keys = ["case_id", "connector", "locator", "source_revision"]
    dated = new.where("source_revision is not null").groupBy(*keys).agg(F.min("id").alias("id"))
    fresh = dated.join(existing.select(*keys).where("source_revision is not null").distinct(), keys, "left_anti")
    return fresh.select("id", *keys).unionByName(new.where("source_revision is null").select("id", *keys))


def blobs(contents: DataFrame) -> DataFrame:
    """One row for each distinct content: (content_sha256, storage_key, content_length, content). Where
    the content isn't selected, only hashes and lengths are shuffled."""
    hashed = contents.select(sha256_hex(F.col("content")).alias("content_sha256"), F.octet_length("content").cast("bigint").alias("n"), "content")
    once = hashed.groupBy("content_sha256").agg(F.max("n").alias("content_length"), F.any_value("content").alias("content"))
    return once.select("content_sha256", storage_key(F.col("content_sha256")).alias("storage_key"), "content_length", "content")


def verified_read(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored blobs (storage_key, content_sha256, content) whose key and re-computed hash agree, and
    the corrupt ones."""
    ok = valid_storage_key(F.col("storage_key")) & (sha256_hex(F.col("content")) == F.col("content_sha256")) & (storage_key(F.col("content_sha256")) == F.col("storage_key"))
    checked = stored.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    return checked.where("_ok").drop("_ok"), checked.where("not _ok").drop("_ok")
