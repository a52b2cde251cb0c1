"""Continuous ingestion: the batch operators on each micro-batch of arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from deponent.functions.values import media_type_of, sha256_hex
from deponent.session import materialize
from deponent.sources.ledger import Ledger
from deponent.sources.scans import Extraction, extract


def stream_files(spark: SparkSession, folder: str, ledger: Ledger, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Files arriving in ``folder`` to the ledger's fields and failures. A micro-batch is one ledger
    batch named by its number, so a batch that is run again after a failure adds nothing twice."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(folder)

    def commit(batch: DataFrame, number: int) -> None:
        artifacts = batch.select(sha256_hex(F.col("content")).alias("artifact_id"), media_type_of(F.col("path")).alias("media_type"), "content").dropDuplicates(["artifact_id"])
        got = Extraction(materialize(extract(artifacts).outcomes, "stream-outcomes"))  # both tables come of one reading
        ledger.append(f"stream-{number:010d}", {"fields": got.fields, "failures": got.failures})

    writer = files.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_states(changes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Of a stream (claim_id, id, state, changed_at timestamp) the states of claims per hour, closed once
    the watermark has passed; later changes than ``delay`` are left to the batch operator."""
    seen = changes.withWatermark("changed_at", delay).groupBy(F.window("changed_at", "1 hour"), "claim_id")
    return seen.agg(F.max(F.struct("changed_at", "id", "state")).alias("s")).select("claim_id", "s.state", F.col("s.changed_at").alias("changed_at"))
