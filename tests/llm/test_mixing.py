import pytest
from pyspark.sql import functions as F

from deponent.llm import mixing
from deponent.llm.mixing import exact_total, integrate, mix_documents, plan_shares

TARGETS = "source string, target_share double, max_repeats int"


def mixed(spark, docs, targets, **kw):
    sized = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens int").withColumns({"position": F.lit("clash"), "bucket": F.lit("x"), "c": F.lit(1)})
    mix, report = mix_documents(sized, spark.createDataFrame(targets, TARGETS), **kw)
    return [r.asDict() for r in mix.collect()], {r["source"]: r.asDict() for r in report.collect()}


def test_shares_are_filled_from_what_is_left():
    got = {s.source: s.demand for s in plan_shares([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 9)], {"a": 100, "b": 10, "c": 900}, 400)}
    assert got == {"a": 100.0, "b": 20.0, "c": 280.0}
    assert [s.demand for s in plan_shares([("a", 0.5, 1), ("b", 0.5, 1)], {}, 10)] == [0.0, 0.0]
    assert [s.demand for s in plan_shares([("a", 0.5, 1), ("b", 0.5, 4)], {"a": 100, "b": 100})] == [100.0, 100.0]


def test_integrated_schedule_ends_at_the_demand():
    pieces = integrate(((0.0, 0.0), (0.5, 2.0), (1.0, 1.0)), 100)
    assert pieces[0][0] == 0 and pieces[0][1] == pytest.approx(40) == pieces[1][0]
    with pytest.raises(ValueError):
        integrate(((0.0, 0.0), (1.0, 0.0)), 1)


def test_mix_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 50)  # several buckets a source
    docs = [(i, "big" if i % 10 else "small", 1 + i % 7) for i in range(1000)] + [(5000 + i, "other", 9) for i in range(20)] + [(7000, "small", 0), (7001, None, 5)]
    targets = [("big", 0.5, 1), ("small", 0.4, 3), ("gone", 0.1, 2)]
    mix, report = mixed(spark, docs + docs[:9], targets, total=1500.0)
    size = {d: n for d, s, n in docs}
    have = {s: sum(n for _, x, n in docs if x == s) for s in ("big", "small")}
    plan = {s.source: s for s in plan_shares(targets, have, 1500.0)}
    for s in ("big", "small"):
        own = sorted((r for r in mix if r["source"] == s), key=lambda r: r["position"])
        used = {}
        for r in own:
            used.setdefault(r["doc_id"], []).append(r["repeat"])
            assert r["n_tokens"] == size[r["doc_id"]] > 0
        assert all(sorted(v) == list(range(len(v))) and len(v) <= plan[s].max_repeats for v in used.values())
        tokens = sum(r["n_tokens"] for r in own)
        assert plan[s].demand <= tokens < plan[s].demand + 7 or tokens == plan[s].demand
        assert report[s]["mixed_tokens"] == tokens and report[s]["available_tokens"] == have[s]
        # a document stands where the integrated schedule reaches its offset
        points = mixing.REPEATING if plan[s].max_repeats > 1 else mixing.SINGLE
        (t0, w0), (t1, w1) = points
        offset = 0
        for r in own:
            x = r["position"]
            assert plan[s].demand * (w0 * x + (w1 - w0) * x * x / 2) / ((w0 + w1) / 2) == pytest.approx(offset, abs=1e-6 * plan[s].demand + 1e-6)
            offset += r["n_tokens"]
    assert report["gone"]["mixed_tokens"] == 0 == report["gone"]["reached_share"]
    assert sum(r["reached_share"] for r in report.values()) == pytest.approx(1)
    assert {r["source"] for r in mix} == {"big", "small"}
    assert [r["position"] for r in mix] == sorted(r["position"] for r in mix)


def test_schedules_move_sources(spark):
    docs = [(i, "ab"[i % 2], 1) for i in range(400)]
    mix, _ = mixed(spark, docs, [("a", 0.5, 1), ("b", 0.5, 1)], total=200.0, schedules={"a": ((0.0, 1.0), (0.5, 1.0), (0.5, 0.0), (1.0, 0.0)), "b": ((0.0, 1.0), (1.0, 1.0))})
    assert max(r["position"] for r in mix if r["source"] == "a") < 0.5 < max(r["position"] for r in mix if r["source"] == "b")


def test_edges(spark):
    targets = [("a", 1.0, 1), ("a", 0.5, 2), (None, 0.2, 1), ("z", None, None)]
    mix, report = mixed(spark, [], targets)
    assert mix == [] and report["a"]["reached_share"] == 0 and report["z"]["mixed_tokens"] == 0
    mix, report = mixed(spark, [(1, "a", 3), (1, "a", 3), (None, "a", 3)], targets)
    assert [(r["doc_id"], r["repeat"]) for r in mix] == [(1, 0)] and report["a"]["reached_share"] == 1
    assert mixed(spark, [(1, "a", 3)], [])[0] == []


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 1)
    with pytest.raises(ValueError):
        mixed(spark, [], [("a", 0.5, 1), ("b", 0.5, 1)])


def test_the_largest_total_at_which_shares_hold(spark):
    docs = [(i, "big", 1) for i in range(1000)] + [(5000 + i, "small", 1) for i in range(60)]
    targets = [("big", 0.5, 1), ("small", 0.3, 2), ("gone", 0.2, 9)]
    assert exact_total(targets, {"big": 1000, "small": 60}) == pytest.approx(120 * 0.8 / 0.3) and exact_total(targets, {}) == 0
    mix, report = mixed(spark, docs, targets, total="exact")
    assert report["small"]["mixed_tokens"] == 120 and report["big"]["mixed_tokens"] == 200
    assert report["big"]["reached_share"] / report["small"]["reached_share"] == pytest.approx(5 / 3)
    assert report["small"]["exact_up_to"] == pytest.approx(400) and report["gone"]["exact_up_to"] == 0
    assert mixed(spark, docs, [("gone", 1.0, 2)], total="exact")[0] == []
