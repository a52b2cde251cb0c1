"""Problem 7: mixing sources to target weights as a time-varying curriculum.

Training time runs from 0 to 1. Each source has a weight schedule over it, piecewise linear, whose
integral is its share; integrated and scaled it is the source's cumulative token demand. A document
whose tokens begin at offset c of its source stands where that demand reaches c: the schedule's
integral is inverted. Documents are range-sorted by that position.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deponent.operators.prefix import prefix_sum
from deponent.session import materialize

#: Largest number of sources of a mix; the plan of a mix is made on the driver and broadcast.
MAX_SOURCES = 10_000
#: Documents that one bucket of a source holds about; offsets inside are one task's running sum.
BUCKET_DOCS = 20_000
#: Default schedules: points (time, relative weight) between which weights are linear. Sources that
#: may repeat grow towards the end, the others shrink.
REPEATING, SINGLE = ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.25), (1.0, 0.75))


@dataclass(frozen=True)
class Share:
    """Of one source: its target, the tokens at hand and the tokens that the mix takes."""

    source: str
    target_share: float
    max_repeats: int
    available: int
    demand: float


def exact_total(targets: list[tuple[str, float, int]], available: dict[str, int]) -> float:
    """The largest total at which every source that has tokens reaches its share; what sources without
    any lack goes to the others in proportion, as in ``plan_shares``."""
    cap = {s: available.get(s, 0) * r for s, w, r in targets if w > 0}
    able = {s: w for s, w, _ in targets if w > 0 and cap[s] > 0}
    return min((cap[s] * sum(able.values()) / w for s, w in able.items()), default=0.0)


def plan_shares(targets: list[tuple[str, float, int]], available: dict[str, int], total: float | None = None) -> list[Share]:
    """Tokens to take from each source, of ``total`` (default: one pass over the listed sources).

    A source that can't give its target share, with all its repeats, gives all it can; what it lacks
    goes to the sources that still can, in proportion to their targets, until the total is reached
    or all are used up."""
    left = {s: w for s, w, _ in targets if w > 0}
    cap = {s: available.get(s, 0) * r for s, _, r in targets}
    want = float(sum(available.get(s, 0) for s, _, _ in targets) if total is None else total)
    demand = {s: 0.0 for s, _, _ in targets}
    while left:
        weight = sum(left.values())
        short = [s for s, w in left.items() if want * w / weight >= cap[s]]
        if not short:
            demand |= {s: want * w / weight for s, w in left.items()}
            break
        for s in short:
            demand[s] = float(cap[s])
            want -= cap[s]
            del left[s]
    return [Share(s, w, r, available.get(s, 0), demand[s]) for s, w, r in targets]


def integrate(points: tuple[tuple[float, float], ...], demand: float) -> list[tuple[float, float, float, float, float, float]]:
    """Pieces (c0, c1, t0, t1, w0, w1) of the cumulative demand: from time t0 to t1 the weight goes
    from w0 to w1 (scaled so that all pieces together demand ``demand`` tokens) and the demand from
    c0 to c1."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    if area <= 0 or any(w < 0 for _, w in points):
        raise ValueError("a schedule needs weights that aren't negative and an area above 0")
    scale, c, out = demand / area, 0.0, []
    for (t0, w0), (t1, w1) in zip(points, points[1:]):
        step = (t1 - t0) * (w0 + w1) / 2 * scale
        if step > 0:
            out.append((c, c + step, t0, t1, w0 * scale, w1 * scale))
        c += step
    return out[:-1] + [(*out[-1][:1], math.inf, *out[-1][2:])] if out else []


def invert(c: Column) -> Column:
    """Time at which the cumulative demand of the piece in c0, t0, t1, w0, w1 reaches ``c``."""
    t0, t1, w0, w1, rest = F.col("t0"), F.col("t1"), F.col("w0"), F.col("w1"), c - F.col("c0")
    slope = (w1 - w0) / (t1 - t0)
    # rest = w0 x + slope x^2 / 2, in the form that also holds for a slope of 0
    x = 2 * rest / (w0 + F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * rest)))
    return F.least(t1, t0 + F.coalesce(x, F.lit(0.0)))


def _bucketed(sized: DataFrame, targets: DataFrame, n_docs: int) -> tuple[DataFrame, int]:
    buckets = max(1, -(-n_docs // BUCKET_DOCS))
    picked = sized.where("n_tokens > 0").join(targets.select("source"), "source", "left_semi")
    return picked.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")), buckets


def mix_documents(
    sized: DataFrame,
    targets: DataFrame,
    *,
    total: float | str | None = None,
    schedules: dict[str, tuple[tuple[float, float], ...]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The mix of documents ``sized`` (doc_id, source, n_tokens) and its report.

    mix: (position, source, doc_id, repeat, n_tokens), one row for each time a document is used,
    range-sorted by position; repeat counts from 0 and stays below the source's max_repeats. ``total``
    are the tokens to reach (default: one pass over the listed sources), or ``"exact"``: the most at
    which every source that has tokens reaches its share.
    report: of each source target_share, max_repeats, tokens at hand, exact_up_to (the total up to
    which it can hold its share), tokens in the mix, passes over it and the share really reached.

    Inside a source documents follow the hash of their id; their token offsets are a prefix sum over
    buckets of about BUCKET_DOCS documents and a running sum inside each, so a source of any size is
    spread over many tasks; the table of bucket offsets has at most (sources x buckets) rows, a
    20,000th of the documents, and is joined, not collected; its offsets are a distributed prefix sum,
    too. Defined results: sources without
    documents, or with texts of no token only, reach 0; a null source, a document of 0 tokens (empty
    or null text) and sources that aren't listed are not in the mix; a document is whole or not in a
    pass, so a source may exceed its demand by less than its longest document; redelivered rows
    (same doc_id) count once; targets with a null or zero share or no repeats give nothing; of targets
    listed twice the larger share counts; an empty table gives an empty mix."""
    spark = sized.sparkSession
    goal = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = goal.orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"a mix of more than {MAX_SOURCES} sources")
    listed = [(r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in rows]
    once = sized.where("doc_id is not null").groupBy("doc_id").agg(F.min("source").alias("source"), F.max("n_tokens").cast("bigint").alias("n_tokens"))
    sized = materialize(once, "mix-sizes")
    picked, buckets = _bucketed(sized, goal, sized.count())
    per_bucket = materialize(picked.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens")), "mix-buckets")
    available = {r["source"]: r["tokens"] for r in per_bucket.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    shares = plan_shares(listed, available, exact_total(listed, available) if total == "exact" else total)

    pieces, passes = [], []
    for s in shares:
        if s.demand <= 0 or s.available <= 0:
            continue
        default = REPEATING if s.max_repeats > 1 else SINGLE
        pieces += [(s.source, *p) for p in integrate((schedules or {}).get(s.source, default), s.demand)]
        passes.append((s.source, s.available, s.demand, min(s.max_repeats, math.ceil(s.demand / s.available))))
    piece = spark.createDataFrame(pieces, "source string, c0 double, c1 double, t0 double, t1 double, w0 double, w1 double")
    taken = spark.createDataFrame(passes, "source string, available bigint, demand double, passes int")

    begin = prefix_sum(per_bucket, ["source"], ["bucket"], F.col("tokens"), "begin").drop("tokens")
    within = W.partitionBy("source", "bucket").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").rowsBetween(W.unboundedPreceding, -1)
    placed = picked.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(begin, ["source", "bucket"])
    used = placed.join(F.broadcast(taken), "source").select("source", "doc_id", "n_tokens", "available", "demand", (F.col("begin") + F.col("inside")).alias("first"), F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("repeat"))
    offset = F.col("first") + F.col("repeat") * F.col("available")
    chosen = used.withColumn("c", offset.cast("double")).where("c < demand")
    timed = chosen.join(F.broadcast(piece), (chosen["source"] == piece["source"]) & (chosen["c"] >= piece["c0"]) & (chosen["c"] < piece["c1"])).select(invert(F.col("c")).alias("position"), chosen["source"], "doc_id", "repeat", "n_tokens")
    mix = materialize(timed, "mix").orderBy("position", "source", "doc_id", "repeat")

    got = mix.groupBy("source").agg(F.sum("n_tokens").alias("mixed"), F.countDistinct("repeat").alias("passes"))
    plan = spark.createDataFrame(
        [(s.source, s.target_share, s.max_repeats, s.available, s.available * s.max_repeats / s.target_share if s.target_share > 0 else None) for s in shares],
        "source string, target_share double, max_repeats int, available_tokens bigint, exact_up_to double",
    )
    everything = F.sum("mixed_tokens").over(W.partitionBy())
    report = (
        plan.join(F.broadcast(got), "source", "left")
        .select("source", "target_share", "max_repeats", "available_tokens", "exact_up_to", F.coalesce("mixed", F.lit(0)).alias("mixed_tokens"), F.coalesce("passes", F.lit(0)).cast("int").alias("passes"))
        .withColumn("reached_share", F.when(everything > 0, F.col("mixed_tokens") / everything).otherwise(0.0))
        .orderBy("source")
    )
    return mix, report
