"""Declared rules: conjunctions of equality conditions over verified claims.

A rule is data: a dict of rule_id, conditions (subject_key, predicate, expected JSON), anchor_predicate
and days_after. Conditions are a small table by predicate that goes to the claims; each claim sets
bits of the conditions it meets or fails, and one aggregation by case and rule gives every verdict.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deponent.functions.codecs import code
from deponent.functions.values import add_days, deterministic_id, sha256_hex

#: Fixed value: largest number of conditions of a rule.
MAX_CONDITIONS = 32
#: Explanations of a verdict, {} for the predicates.
DISAGREE = "Verified facts disagree; human adjudication is required."
MISSING = "Required verified facts are missing: {}."
FAILED = "Rule conditions were not satisfied: {}."
NO_ANCHOR = "A verified deadline anchor ({}) is missing."
SATISFIED = "All conditions and the deadline anchor are established by verified evidence."
#: Most characters of a definition's texts.
TEXT_BOUNDS = {"obligation_kind": 200, "obligation_description": 1000, "anchor_predicate": 300, "task_title": 500}
#: Largest number of rules of one evaluation: their conditions, at most 33 rows a rule, are broadcast.
MAX_RULES = 5_000


def _fits(text: str, most: int) -> bool:
    return 1 <= len(text.strip()) <= most and not any(ord(ch) < 32 or 127 <= ord(ch) < 160 for ch in text)


def rule_fault(rule: dict) -> str | None:
    """What is wrong with a definition: its conditions (1 to 32, texts of 1 to 300 characters), or a text
    of its effect; None if nothing is."""
    if not 1 <= len(rule["conditions"]) <= MAX_CONDITIONS:
        return "conditions"
    if not all(_fits(subject, 300) and _fits(predicate, 300) for subject, predicate, _ in rule["conditions"]):
        return "condition text"
    return next((name for name, most in TEXT_BOUNDS.items() if name in rule and not _fits(rule[name], most)), None)


def checked_rules(rules: Iterable[dict]) -> list[dict]:
    """Rules declared by packages, checked: at most MAX_RULES; of a rule_id declared twice the last
    counts. The engine also works with none."""
    once = list({r["rule_id"]: r for r in rules}.values())
    if len(once) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    for r in once:
        if fault := rule_fault(r):
            raise ValueError(f"rule {r['rule_id']}: {fault}")
    return once


def definition_json(rule: dict) -> str:
    """The canonical JSON of a definition, from which its hash is made."""
    dump = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    conditions = ",".join(f'{{"subject_key":{dump(s)},"predicate":{dump(p)},"expected":{expected}}}' for s, p, expected in rule["conditions"])
    effect = {
        "obligation_kind": rule.get("obligation_kind", ""),
        "obligation_description": rule.get("obligation_description", ""),
        "deadline_anchor_predicate": rule["anchor_predicate"],
        "deadline_days_after": rule["days_after"],
        "task_title": rule.get("task_title", ""),
    }
    return f'{{"all":[{conditions}],"effect":{dump(effect)}}}'


def register(spark: SparkSession, declared: list[dict], at_ms: int, actor: str) -> dict[str, DataFrame]:
    """Declarations (package_id, stable_key, title, version and a definition) into rules, immutable
    rule_versions with the hash of their definition, audit_events and refused ones (stable_key,
    version, reason). Ids are made from the package, the key and the version, so registering again
    adds nothing; of one version declared twice the first counts, another definition of it is a
    ``conflict``. Declarations are a list of at most MAX_RULES."""
    if len(declared) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    made_id = lambda kind, *parts: f"{kind}_{hashlib.sha256(chr(0).join([kind, *map(str, parts)]).encode()).hexdigest()[:32]}"
    rules, versions, refused = {}, {}, []
    for r in declared:
        rule_id = made_id("rule", r["package_id"], r["stable_key"])
        version_id, definition = made_id("rule_version", rule_id, r["version"]), definition_json(r)
        sha = hashlib.sha256(definition.encode()).hexdigest()
        if rule_fault(r):
            refused.append((r["stable_key"], r["version"], code("failure", "invalid_input")))
        elif version_id in versions and versions[version_id][4] != sha:
            refused.append((r["stable_key"], r["version"], code("failure", "conflict")))
        else:
            rules.setdefault(rule_id, (rule_id, r["package_id"], r["stable_key"], r["title"], at_ms))
            versions.setdefault(version_id, (version_id, rule_id, r["version"], definition, sha, r.get("effective_from"), r.get("effective_until"), at_ms))
    audit = [(made_id("audit", "rule.register", v), None, code("operation", "rule.register"), v, actor, at_ms) for v in versions]
    return {
        "rules": spark.createDataFrame(list(rules.values()), "id string, package_id string, stable_key string, title string, created_at_ms bigint"),
        "rule_versions": spark.createDataFrame(list(versions.values()), "id string, rule_id string, version int, definition_json string, definition_sha256 string, effective_from string, effective_until string, created_at_ms bigint"),
        "audit_events": spark.createDataFrame(audit, "id string, case_id string, operation string, target_id string, actor string, occurred_at_ms bigint"),
        "refused": spark.createDataFrame(refused, "stable_key string, version int, reason string"),
    }


def _asked_of(rules: list[dict]) -> list[tuple]:
    """(predicate, rule_id, conditions of that predicate, whether it is the anchor): at most 33 a rule."""
    out: dict[tuple[str, str], tuple[list, bool]] = {}
    for r in rules:
        for i, (subject, predicate, expected) in enumerate(r["conditions"]):
            out.setdefault((predicate, r["rule_id"]), ([], predicate == r["anchor_predicate"]))[0].append((i, subject, expected))
        out.setdefault((r["anchor_predicate"], r["rule_id"]), ([], True))
    return [(p, rule, conditions, anchor) for (p, rule), (conditions, anchor) in out.items()]


def inputs(verified: DataFrame, declared: list[dict]) -> DataFrame:
    """(case_id, rule_id, claim_id, subject_key, predicate, normalized_value, evidence_ids, asked,
    is_anchor) of each verified claim that a rule takes, once a rule however many of its conditions
    it serves. ``evidence_ids`` are empty where claims have none."""
    spark = verified.sparkSession
    asked = spark.createDataFrame(_asked_of(checked_rules(declared)), "predicate string, rule_id string, conditions array<struct<pos int, subject_key string, expected string>>, is_anchor boolean")
    evidence = F.sort_array(F.coalesce("evidence_ids", F.array().cast("array<string>"))) if "evidence_ids" in verified.columns else F.array().cast("array<string>")
    claims = verified.select("case_id", F.col("claim_id").cast("string").alias("claim_id"), "subject_key", "predicate", "normalized_value", evidence.alias("evidence_ids"))
    met = claims.join(F.broadcast(asked), "predicate").withColumn("asked", F.filter("conditions", lambda c: c["subject_key"] == F.col("subject_key")))
    return met.where("is_anchor or size(asked) > 0").drop("conditions")


def _bits(conditions: Column) -> Column:
    return F.aggregate(conditions, F.lit(0).cast("bigint"), lambda bits, c: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), c["pos"])))


def evaluate(requests: DataFrame, verified: DataFrame, declared: list[dict]) -> DataFrame:
    """(case_id, rule_id, result, explanation, due_date, n_inputs, inputs_sha256) of each request: a
    case_id and rule_id, or a case_id alone, for all rules.

    ``verified`` are claims in state verified, with evidence_ids where they have any. Precedence:
    disagreeing conditions or several anchor dates, missing conditions, failed conditions, no anchor
    date, satisfied. A condition disagrees if some but not all of its claims have the expected value.
    The anchor is the date of any subject. Explanations name predicates in order of the conditions.

    inputs_sha256 identifies the inputs (claim, evidence ids, subject, predicate and value), so an
    evaluation known by (case, rule, inputs) need not be stored again. It is a hash of their number
    and of sums of their hashes, which needs no order: inputs of a case of any size are combined
    map-side and never gathered. Claims are read once and shuffled as one row a case and rule."""
    rules = checked_rules(declared)
    spark = verified.sparkSession
    heads = spark.createDataFrame(
        [(r["rule_id"], r["anchor_predicate"], r["days_after"], [p for _, p, _ in r["conditions"]]) for r in rules], "rule_id string, anchor_predicate string, days_after int, predicates array<string>"
    )
    if "rule_id" in requests.columns:
        wanted = requests.select("case_id", "rule_id").distinct()
    else:
        ids = F.array(*(F.lit(r["rule_id"]) for r in rules)) if rules else F.array().cast("array<string>")
        wanted = requests.select("case_id").distinct().select("case_id", F.explode(ids).alias("rule_id"))
    day = F.try_parse_json("normalized_value")
    part = lambda name, n: F.lpad(F.try_variant_get(day, f"$.value.value.{name}", "string"), n, "0")
    as_date = F.when(F.col("is_anchor") & (F.try_variant_get(day, "$.value.type", "string") == "date"), F.concat_ws("-", part("year", 4), part("month", 2), part("day", 2)).try_cast("date"))
    expected = lambda c: F.coalesce(c["expected"] == F.col("normalized_value"), F.lit(False))
    member = sha256_hex(F.concat_ws("\0", "claim_id", F.array_join("evidence_ids", ","), "subject_key", "predicate", "normalized_value"))
    used = inputs(verified, rules).select("case_id", "rule_id", _bits(F.col("asked")).alias("seen"), _bits(F.filter("asked", expected)).alias("hit"), as_date.alias("day"), member.alias("member"))
    used = used.withColumn("miss", F.col("seen").bitwiseAND(F.bitwise_not("hit")))
    word = lambda i: F.conv(F.substring("member", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
    found = used.groupBy("case_id", "rule_id").agg(
        *(F.bit_or(c).alias(c) for c in ("seen", "hit", "miss")), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("n_inputs"), *(F.sum(word(i)).alias(f"h{i}") for i in range(3))
    )
    all_ = wanted.join(F.broadcast(heads), "rule_id").join(found, ["case_id", "rule_id"], "left").fillna(0, ["seen", "hit", "miss", "n_inputs"])

    def told(sentence: str, about: Column) -> Column:
        before, _, after = sentence.partition("{}")
        return F.concat(F.lit(before), about, F.lit(after))

    def names(bits: Column) -> Column:
        chosen = F.filter("predicates", lambda p, i: F.call_function("shiftright", bits, i).bitwiseAND(F.lit(1).cast("bigint")) == 1)
        return F.array_join(chosen, ", ")

    every = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.size("predicates")) - 1
    missing, failed = every.bitwiseAND(F.bitwise_not("seen")), F.col("seen").bitwiseAND(F.bitwise_not("hit"))
    conflict = (F.col("hit").bitwiseAND(F.col("miss")) != 0) | F.coalesce(F.col("first_day") != F.col("last_day"), F.lit(False))
    anchorless = F.col("first_day").isNull()
    result = F.when(conflict | (missing != 0), "indeterminate").when(failed != 0, "not_satisfied").when(anchorless, "indeterminate").otherwise("satisfied")
    why = (
        F.when(conflict, DISAGREE)
        .when(missing != 0, told(MISSING, names(missing)))
        .when(failed != 0, told(FAILED, names(failed)))
        .when(anchorless, told(NO_ANCHOR, F.col("anchor_predicate")))
        .otherwise(SATISFIED)
    )
    return all_.select(
        "case_id",
        "rule_id",
        result.alias("result"),
        why.alias("explanation"),
        F.when(result == "satisfied", add_days(F.col("first_day"), F.col("days_after"))).alias("due_date"),
        "n_inputs",
        sha256_hex(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("n_inputs", "h0", "h1", "h2")))).alias("inputs_sha256"),
    )


def with_ids(evaluated: DataFrame) -> DataFrame:
    """Evaluations with evaluation_id, made from case, rule and inputs."""
    return evaluated.withColumn("evaluation_id", deterministic_id("evaluation", F.col("case_id"), F.col("rule_id"), F.col("inputs_sha256")))


def new_evaluations(evaluated: DataFrame, known: DataFrame) -> DataFrame:
    """Evaluations that aren't stored yet, by case, rule and inputs, with their id."""
    return with_ids(evaluated.join(known.select("case_id", "rule_id", "inputs_sha256"), ["case_id", "rule_id", "inputs_sha256"], "left_anti"))


def evaluation_evidence(evaluations: DataFrame, used: DataFrame) -> DataFrame:
    """(evaluation_id, evidence_id), distinct: the evidence of the ``inputs`` of each evaluation."""
    evidence = used.select("case_id", "rule_id", F.explode("evidence_ids").alias("evidence_id")).distinct()
    return evaluations.select("evaluation_id", "case_id", "rule_id").join(evidence, ["case_id", "rule_id"]).select("evaluation_id", "evidence_id")
