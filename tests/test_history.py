import random

from pyspark.sql import functions as F

from deponent.operators.history import History, version_updates
from tests.conftest import rows

EVENT = "k string, at bigint, version int, hash string, tie string"


def brute(data):
    out = []
    for k in {r[0] for r in data if r[0] is not None}:
        first = {}
        for _, at, v, h, tie in (r for r in data if r[0] == k and r[1] is not None and r[2] is not None):
            first[v] = min(first.get(v, (at, tie, h)), (at, tie, h))
        at_time = {}
        for v, (at, _, h) in first.items():
            at_time[at] = max(at_time.get(at, (v, h)), (v, h))
        top, open_ = None, None
        for at in sorted(at_time):
            v, h = at_time[at]
            if top is not None and v <= top:
                continue
            top = v
            if open_ and open_[4] == h:
                continue
            if open_:
                out.append((k, open_[1], open_[2], at))
            open_ = (k, v, at, -1, h)
        if open_:
            out.append(open_[:4])
    return sorted(out, key=repr)


def some(seed, n, keys=4, times=40, versions=12):
    r = random.Random(seed)
    return [(f"k{r.randrange(keys)}", r.choice([None, *range(times)]), r.choice([None, *range(1, versions)]), r.choice("abc"), str(i)) for i in range(n)]


def test_periods(spark):
    data = [("k", 10, 1, "a", "1"), ("k", 20, 2, "a", "2"), ("k", 30, 4, "b", "3"), ("k", 40, 3, "c", "4"), ("k", 50, 5, "d", "5"), ("k", 50, 6, "e", "6"), ("k", 5, 4, "b", "7")]
    assert rows(History(["k"]).periods(spark.createDataFrame(data[:6], EVENT))) == [("k", 1, 10, 30), ("k", 4, 30, 50), ("k", 6, 50, -1)]
    assert rows(History(["k"]).periods(spark.createDataFrame(data, EVENT))) == [("k", 4, 5, 50), ("k", 6, 50, -1)]


def test_against_brute_force_plain_and_hot(spark):
    data = some(1, 400) + some(2, 600, keys=1, times=500, versions=400)
    df = spark.createDataFrame(data + data[:100], EVENT).withColumns({"chunk": F.lit("x"), "opens": F.lit(1)})
    want = brute(data)
    assert rows(History(["k"]).periods(df)) == want
    assert rows(History(["k"], hot_events=20).periods(df)) == want


def test_merging_batches_in_any_order_gives_the_same(spark):
    data = some(5, 300, keys=6)
    random.Random(7).shuffle(data)
    h, state = History(["k"]), None
    for part in (data[:120], data[120:200], data[200:]):
        if state is not None:
            state = spark.createDataFrame(state.collect(), state.schema)
        last = state
        state = h.merge(spark.createDataFrame(part, EVENT), state)
    assert rows(h.periods(spark.createDataFrame(data[200:], EVENT), last)) == brute(data)
    assert rows(state) == rows(h.merge(spark.createDataFrame(data, EVENT)))


def test_edges(spark):
    data = [(None, 1, 1, "a", "1"), ("k", None, 1, "a", "1"), ("k", 1, None, "a", "1"), ("n", 3, 1, None, "1"), ("n", 4, 2, None, "1"), ("n", 5, 3, "", "1")]
    updates = spark.createDataFrame(data, EVENT)
    assert rows(History(["k"]).periods(updates)) == [("n", 1, 3, 5), ("n", 3, 5, -1)]
    assert History(["k"]).periods(spark.createDataFrame([], EVENT)).count() == 0


def test_versions_over_all_artifact_ids(spark):
    v = spark.createDataFrame([("v1", "a1", 1, "x", 10), ("v1", "a1", 1, "x", 10), ("v2", "a2", 2, "y", 20), ("v3", "a2", 3, None, None), ("v4", "zz", 1, "x", 1)], "id string, artifact_id string, version_number int, content_sha256 string, ingested_at_ms bigint")
    a = spark.createDataFrame([("a1", "c", "s"), ("a1", "c", "s"), ("a2", "c", "s")], "id string, case_id string, source_key string")
    assert rows(History(["case_id", "source_key"]).periods(version_updates(v, a))) == [("c", "s", 1, 10, 20), ("c", "s", 2, 20, -1)]


def test_batches_merge_into_a_written_state(spark):
    data, seen = some(9, 300, keys=6) + [("late", 1, 1, "a", "x")], []

    class Watched(History):
        def merge(self, updates, state=None):
            seen.append((updates.agg(F.min("at"), F.max("at")).first(), None if state is None else state.count()))
            return super().merge(updates, state)

    df = spark.createDataFrame(data, EVENT)
    assert rows(Watched(["k"]).periods_by_batches(df, 3)) == brute(data)
    assert [bool(s) for _, s in seen] == [False, True, True]
    assert seen[0][0][1] < seen[1][0][0] <= seen[1][0][1] < seen[2][0][0]
    assert rows(History(["k"], hot_events=20).periods_by_batches(df)) == brute(data)
    assert History(["k"]).periods_by_batches(spark.createDataFrame([], EVENT)).count() == 0
    same = [("k", 5, v, h, "1") for v, h in ((1, "a"), (2, "b"))]
    assert rows(History(["k"]).periods_by_batches(spark.createDataFrame(same, EVENT))) == brute(same)


def test_the_query_merges_into_a_state(spark, tables, monkeypatch):
    from deponent.plans.problems import p5_found

    states = []
    run = History.merge
    monkeypatch.setattr(History, "merge", lambda self, updates, state=None: states.append(state is not None) or run(self, updates, state))
    assert p5_found(spark, tables).count() and states == [False, True]


def written(spark, df):
    return spark.createDataFrame(df.collect(), df.schema)


def test_a_late_row_of_a_known_version_and_time(spark):
    h = History(["k"])
    first, late = [("k", 1, 1, "H1", "z"), ("k", 2, 2, "H2", "b")], [("k", 1, 1, "H2", "a")]
    state = written(spark, h.merge(spark.createDataFrame(first, EVENT)))
    assert rows(h.periods(spark.createDataFrame(late, EVENT), state)) == [("k", 1, 1, -1)] == brute(first + late)


def test_only_keys_with_late_updates_are_made_anew(spark):
    h, seen = History(["k"]), []
    old = [("a", 1, 1, "x", "1"), ("a", 5, 2, "y", "2"), ("b", 1, 1, "x", "3"), ("b", 5, 2, "y", "4"), ("c", 1, 1, "x", "5")]
    new = [("a", 6, 3, "y", "6"), ("a", 7, 4, "z", "7"), ("a", 8, 1, "q", "8"), ("b", 3, 3, "w", "9"), ("d", 1, 1, "n", "0")]
    state = written(spark, h.merge(spark.createDataFrame(old, EVENT)))
    versions = h._versions
    h._versions = lambda updates: seen.extend(sorted(tuple(r)[:3] for r in updates.collect())) or versions(updates)
    merged = h.merge(spark.createDataFrame(new, EVENT), state)
    # of a only its current version is compared, of b all events, of c none
    assert [x for x in seen if x[0] == "a"] == [("a", 5, 2), ("a", 6, 3), ("a", 7, 4), ("a", 8, 1)]
    assert [x for x in seen if x[0] == "b"] == [("b", 1, 1), ("b", 3, 3), ("b", 5, 2)] and not [x for x in seen if x[0] == "c"]
    assert rows(h.view(merged)) == brute(old + new)
    assert rows(merged) == rows(History(["k"]).merge(spark.createDataFrame(old + new, EVENT)))


def test_any_batches_in_any_order_give_one_state(spark):
    for seed in range(4):
        r = random.Random(seed)
        data = some(seed + 20, 120, keys=3, times=12, versions=6)
        h = History(["k"], hot_events=r.choice([10, 10**6]))
        whole = rows(History(["k"]).merge(spark.createDataFrame(data, EVENT)))
        r.shuffle(data)
        if seed % 2:
            data.sort(key=lambda x: x[1] or 0)
        state, cuts = None, sorted(r.sample(range(1, 119), 2))
        for a, b in zip([0, *cuts], [*cuts, 120]):
            state = written(spark, h.merge(spark.createDataFrame(data[a:b], EVENT), state))
        assert rows(state) == whole and rows(h.view(state)) == brute(data)
