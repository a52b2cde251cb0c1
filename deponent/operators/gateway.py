"""Optional interpreters: untrusted text-to-claims functions behind a policy and a strict schema.

No core path needs one. An interpreter's output is JSON text that is checked in full before any of
it counts; failures carry a kind, never the text or the output.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Policies, and the kinds of failure.
POLICIES = ("disabled", "local_only", "allow_listed_remote")
KINDS = ("disabled", "policy_denied", "provider_unavailable", "malformed_output", "validation_rejected")
#: The fields of a claim in an interpreter's output; the first four are required.
FIELDS = ("subject_key", "predicate", "original_value", "normalized_value", "text_span_start", "text_span_end")
KNOWLEDGE = ("known", "unknown", "not_applicable", "not_evaluated")

_OUT = "text_id string, subject_key string, predicate string, original_value string, normalized_value string, text_span_start bigint, text_span_end bigint, kind string"


@dataclass(frozen=True)
class Interpreter:
    """call takes a list of texts and gives one output for each; it runs on executors."""

    provider: str
    model: str
    version: str
    local: bool
    call: Callable[[list[str]], list[str]]


def _count(x: object) -> bool:
    return x is None or (isinstance(x, int) and not isinstance(x, bool) and 0 <= x < 2**63)


def read_output(output: object) -> tuple[list[dict], str | None]:
    """Claims of one output, or the kind of its failure: unknown or missing fields and wrong types are
    malformed, blank keys and spans that end before they start are rejected."""
    try:
        whole = json.loads(output)
        claims = whole["claims"]
        ok = set(whole) == {"claims"} and all(set(FIELDS[:4]) <= set(c) <= set(FIELDS) for c in claims)
        ok = ok and all(all(isinstance(c[f], str) for f in FIELDS[:3]) and _count(c.get(FIELDS[4])) and _count(c.get(FIELDS[5])) for c in claims)
        ok = ok and all(c["normalized_value"]["knowledge"] in KNOWLEDGE and ("value" in c["normalized_value"]) == (c["normalized_value"]["knowledge"] == "known") for c in claims)
    except (ValueError, TypeError, KeyError, AttributeError):
        ok = False
    if not ok:
        return [], "malformed_output"
    for c in claims:
        start, end = c.get("text_span_start"), c.get("text_span_end")
        if not c["subject_key"].strip() or not c["predicate"].strip() or (start is not None and end is not None and end < start):
            return [], "validation_rejected"
    return claims, None


def interpret(texts: DataFrame, interpreter: Interpreter | None, policy: str = "disabled") -> tuple[DataFrame, DataFrame]:
    """Claims that an interpreter finds in ``texts`` (text_id, text), and (text_id, provider, model, kind)
    of the texts it failed on. Without interpreter or against the policy nothing is called. A text
    fails whole."""
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {POLICIES}")
    ids = texts.select(F.col("text_id").cast("string").alias("text_id"), "text")
    refusal = "disabled" if interpreter is None else "policy_denied" if policy == "disabled" or (policy == "local_only" and not interpreter.local) else None
    who = [F.lit(interpreter and interpreter.provider).cast("string").alias("provider"), F.lit(interpreter and interpreter.model).cast("string").alias("model")]
    names = [c.split()[0] for c in _OUT.split(", ")]
    if refusal:
        none = ids.sparkSession.createDataFrame([], _OUT).drop("kind")
        return none, ids.select("text_id", *who, F.lit(refusal).alias("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, given = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            try:
                outputs = list(interpreter.call(given))
                read = [read_output(o) for o in outputs] if len(outputs) == len(given) else [([], "malformed_output")] * len(given)
            except Exception:  # whatever an interpreter raises is one kind of failure
                read = [([], "provider_unavailable")] * len(given)
            rows = []
            for key, (claims, kind) in zip(keys, read):
                rows += [(key, None, None, None, None, None, None, kind)] if kind else []
                rows += [(key, *(c[f] for f in FIELDS[:3]), json.dumps(c["normalized_value"], separators=(",", ":"), ensure_ascii=False), c.get("text_span_start"), c.get("text_span_end"), None) for c in claims]
            kinds = [pa.string()] * 5 + [pa.int64()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    out = ids.mapInArrow(run, _OUT)
    return out.where("kind is null").drop("kind"), out.where("kind is not null").select("text_id", *who, "kind")
