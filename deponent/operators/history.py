"""Problem 5: full history of changing attributes as a type-two dimension.

The state of the dimension holds, per key and in order of time, each version higher than all before
it, with the hash of its attributes, whether it opened a period (its hash differs from the then
current one) and when that period ended. Absorbed versions (same hash, no period) stay in the state,
as a later merge must know them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deponent.session import materialize

#: A key with more events than this is scanned in chunks by several tasks instead of in one.
HOT_EVENTS = 1_000_000


def attribute_hash(*columns: str) -> Column:
    """Hash of the attributes that make a version differ; null-safe. A single text column that is a
    content hash already stands for itself."""
    if len(columns) == 1:
        return F.coalesce(F.col(columns[0]).cast("string"), F.lit(""))
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def first_seen(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Updates (keys, at, version, hash, tie, seed) to one event for each key and time: a version counts
    from its earliest time, of several at one time the highest stays. Both steps combine map-side."""
    known = updates.where(" and ".join(f"`{c}` is not null" for c in [*keys, "at", "version"]))
    versions = known.groupBy(*keys, "version").agg(F.min(F.struct("at", "tie", "hash", "seed")).alias("e"))
    of_time = F.max(F.struct(F.col("version"), F.col("e.hash").alias("hash"), F.col("e.tie").alias("tie"), F.col("e.seed").alias("seed")))
    return versions.groupBy(*keys, F.col("e.at").alias("at")).agg(of_time.alias("x")).select(*keys, "at", "x.*")


def _carried(rows: DataFrame, keys: list[str], agg: Column, over: Column, carry: str) -> DataFrame:
    """Join to each row what ``over`` makes of the chunk summaries ``agg`` around its own chunk. There
    is one summary for each key and chunk, so about as many as there are chunks."""
    s = rows.groupBy(*keys, "chunk").agg(agg.alias("_s")).withColumn(carry, over).drop("_s")
    return rows.join(s, [*keys, "chunk"])


def _rising(events: DataFrame, keys: list[str], chunked: bool) -> DataFrame:
    parts, event = [*keys, "chunk"] if chunked else keys, ["at", "version", "hash", "tie", "seed"]
    w, by_chunk = W.partitionBy(*parts).orderBy("at"), W.partitionBy(*keys).orderBy("chunk")
    before = F.max("version").over(w.rowsBetween(W.unboundedPreceding, -1))
    if chunked:
        events = _carried(events, keys, F.max("version"), F.max("_s").over(by_chunk.rowsBetween(W.unboundedPreceding, -1)), "_top")
        before = F.greatest(before, F.col("_top"))
    rising = events.withColumn("_before", before).where("_before is null or version > _before").select(*parts, *event)
    last = F.lag(F.struct("hash")).over(w)
    if chunked:
        rising = materialize(rising, "history-rising")
        rising = _carried(rising, keys, F.max_by(F.struct("hash"), "at"), F.lag("_s").over(by_chunk), "_hash")
        last = F.when(F.row_number().over(w) == 1, F.col("_hash")).otherwise(last)
    return rising.withColumn("_last", last).withColumn("opens", F.col("_last").isNull() | ~F.col("_last.hash").eqNullSafe(F.col("hash"))).select(*parts, *event, "opens")


def _ended(rising: DataFrame, keys: list[str], chunked: bool) -> DataFrame:
    """Rising events with ``ended``, the time of the key's next opening event, null for the last period
    and for events that open none."""
    parts = [*keys, "chunk"] if chunked else keys
    after = W.partitionBy(*parts).orderBy("at").rowsBetween(1, W.unboundedFollowing)
    opening = F.when(F.col("opens"), F.col("at"))
    end = F.min(opening).over(after)
    if chunked:
        # of this chunk's events only the last has nothing behind it here
        chunks = W.partitionBy(*keys).orderBy("chunk").rowsBetween(1, W.unboundedFollowing)
        rising = _carried(materialize(rising, "history-opening"), keys, F.min(opening), F.min("_s").over(chunks), "_next")
        end = F.coalesce(end, F.col("_next"))
    return rising.withColumn("ended", F.when(F.col("opens"), end)).drop("chunk", "_next")


class History:
    """A type-two dimension over ``keys``.

    ``merge`` takes updates in any order, late ones too, and gives the state after them. A key whose
    updates all come after its last event is merged against its current version alone: attribute
    hashes are compared, a changed row is closed with the time of the next and new versions are
    inserted open; its older rows aren't read into the comparison. Only keys with late updates are
    made anew, from all their events. Merging batch by batch, in any order, and merging all at once
    give the same state. Defined results: updates with a null key, time or version are ignored;
    repeated updates change nothing; a null hash is a value of its own (attribute_hash takes a null
    for an empty text); at equal times the higher version wins; of one version's rows the earliest
    (then the smallest tie) gives the hash; an empty table gives no periods. Keys with more than
    ``hot_events`` new events are range-partitioned by time and scanned chunk by chunk with carried
    summaries, the rest in one window; both give the same rows."""

    def __init__(self, keys: list[str], hot_events: int = HOT_EVENTS):
        self.keys, self.hot_events = keys, hot_events
        self.columns = [*keys, "at", "version", "hash", "tie", "opens", "ended"]

    def _split(self, events: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Events of ordinary keys, and those of hot keys with their chunk."""
        events = materialize(events, "history-events")
        counted = events.groupBy(*self.keys).count()
        if (counted.agg(F.max("count")).first()[0] or 0) <= self.hot_events:
            return events, None
        hot = materialize(counted.where(F.col("count") > self.hot_events), "history-hot")
        total = hot.agg(F.sum("count")).first()[0]
        chunks = 1 + int(2 * total // self.hot_events)
        ranged = events.join(hot, self.keys, "left_semi").repartitionByRange(chunks, *self.keys, "at").withColumn("chunk", F.spark_partition_id())
        return events.join(hot, self.keys, "left_anti"), materialize(ranged, "history-chunks")

    def _versions(self, updates: DataFrame) -> DataFrame:
        """State rows of ``updates``, with their seed flag."""
        plain, hot = self._split(first_seen(updates, self.keys))
        out = _ended(_rising(plain, self.keys, False), self.keys, False)
        return out if hot is None else out.unionByName(_ended(_rising(hot, self.keys, True), self.keys, True))

    def merge(self, updates: DataFrame, state: DataFrame | None = None) -> DataFrame:
        """The state (keys, at, version, hash, tie, opens, ended) after ``updates`` (keys, at, version,
        hash, tie)."""
        event = [*self.keys, "at", "version", "hash", "tie", "seed"]
        updates = updates.withColumns({"tie": F.col("tie").cast("string"), "seed": F.lit(False)}).select(*event)
        if state is None:
            return self._versions(updates).select(*self.columns)
        current = state.groupBy(*self.keys).agg(F.max(F.struct("at", "version", "hash", "tie")).alias("c"))
        arrived = updates.where("at is not null and version is not null").groupBy(*self.keys).agg(F.min("at").alias("first_at"))
        touched = materialize(arrived.join(current, self.keys).withColumn("late", F.col("first_at") <= F.col("c.at")), "history-touched")
        seeds = touched.where("not late").select(*self.keys, "c.*", F.lit(True).alias("seed"))
        again = state.join(touched.where("late"), self.keys, "left_semi").withColumn("seed", F.lit(False)).select(*event)
        versions = materialize(self._versions(updates.unionByName(seeds).unionByName(again)), "history-versions")
        closings = versions.where("seed and ended is not null").select(*self.keys, F.col("ended").alias("_closed"), F.lit(False).alias("_late"))
        changed = closings.unionByName(touched.where("late").select(*self.keys, F.lit(None).cast("bigint").alias("_closed"), F.lit(True).alias("_late")))
        kept = state.join(changed, self.keys, "left").where("not coalesce(_late, false)")
        closed = kept.withColumn("ended", F.when(F.col("opens"), F.coalesce("ended", "_closed"))).select(*self.columns)
        return closed.unionByName(versions.where("not seed").select(*self.columns))

    def view(self, state: DataFrame) -> DataFrame:
        """The periods of a state: (keys, version_number, valid_from_ms, valid_to_ms); -1 is open."""
        return state.where("opens").select(*self.keys, F.col("version").alias("version_number"), F.col("at").alias("valid_from_ms"), F.coalesce("ended", F.lit(-1)).alias("valid_to_ms"))

    def periods(self, updates: DataFrame, state: DataFrame | None = None) -> DataFrame:
        """The periods after ``updates``."""
        return self.view(self.merge(updates, state))

    def periods_by_batches(self, updates: DataFrame, batches: int = 2) -> DataFrame:
        """``periods`` of ``updates`` that come in as so many batches, in order of time: each is merged
        into the written state of the ones before it. Of few different times some batches hold none."""
        updates = materialize(updates, "history-updates")
        cuts = updates.agg(F.percentile_approx("at", [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
        state = None
        ends = [None, *sorted(set(cuts)), None]
        for after, until in zip(ends, ends[1:-1]):
            part = updates.where(F.col("at") <= until)
            part = part if after is None else part.where(F.col("at") > after)
            state = materialize(self.merge(part, state), "history-state")
        return self.periods(updates if ends[-2] is None else updates.where(F.col("at") > ends[-2]), state)


def version_updates(versions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Updates of each (case_id, source_key) over all its artifact ids."""
    owners = artifacts.select(F.col("id").alias("artifact_id"), "case_id", "source_key").where("artifact_id is not null and case_id is not null and source_key is not null").distinct()
    v = versions.select("artifact_id", F.col("ingested_at_ms").alias("at"), F.col("version_number").alias("version"), attribute_hash("content_sha256").alias("hash"), F.col("id").alias("tie")).where(
        "artifact_id is not null and at is not null and version is not null"
    )
    return v.join(owners, "artifact_id").select("case_id", "source_key", "at", "version", "hash", "tie")
