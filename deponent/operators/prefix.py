"""Running totals per key at any skew: a distributed, exact prefix sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deponent.session import materialize


def prefix_sum(rows: DataFrame, keys: list[str], order: list[str], value: Column, out: str, chunks: int | None = None) -> DataFrame:
    """``rows`` with ``out``, the sum of ``value`` over the rows of the same keys before the own one in
    ``order`` (which should be unique for each key; ties are split by chance). Null values add 0.

    Rows are range-partitioned by keys and order, so a key of any size spreads over as many chunks as
    it fills; each chunk is summed by itself and chunks of the same key pass on their totals. Only
    keys that span chunks pass any on, at most two a chunk, so what is joined back is bounded by the
    number of chunks, not by the data."""
    n = chunks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("_v", F.coalesce(value, F.lit(0))).repartitionByRange(n, *keys, *order).withColumn("_chunk", F.spark_partition_id())
    ranged = materialize(ranged, "prefix-chunks")
    totals = ranged.groupBy(*keys, "_chunk").agg(F.sum("_v").alias("_t"))
    carried = totals.withColumn("_carry", F.sum("_t").over(W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))).where("_carry is not null").drop("_t")
    inside = F.sum("_v").over(W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    joined = ranged.withColumn("_inside", inside).join(F.broadcast(carried), [*keys, "_chunk"], "left")
    return joined.withColumn(out, F.coalesce("_inside", F.lit(0)) + F.coalesce("_carry", F.lit(0))).drop("_v", "_chunk", "_inside", "_carry")
