import pytest
from pyspark.sql import functions as F

from deponent.functions.instants import parse_instant
from deponent.operators.instants import connector_of_versions, extend_dictionary, normalise
from tests.conftest import rows

B, NY, S = "Europe/Berlin", "America/New_York", "Australia/Sydney"


@pytest.mark.parametrize(
    "text, zone, order, want",
    [
        ("2024-05-01", None, None, "2024-05-01"),
        (" \t2024-05-01 ", B, "dmy", "2024-05-01"),
        ("20240501", None, None, "2024-05-01"),
        ("2024/5/1", None, "dmy", "2024-05-01"),
        ("05/01/2024", NY, "mdy", "2024-05-01"),
        ("05/01/2024", B, "dmy", "2024-01-05"),
        ("1.5.24", NY, "mdy", "2024-05-01"),
        ("28-2-2025", B, "dmy", "2025-02-28"),
        ("11-MAR-25", None, None, "2025-03-11"),
        ("6 Mar 2025", None, None, "2025-03-06"),
        ("February 27, 2025", None, None, "2025-02-27"),
        ("24. November 2022", None, None, "2022-11-24"),
        ("5. März 2025", None, None, "2025-03-05"),
        ("2 de mayo de 2024", None, None, "2024-05-02"),
        ("20240304T105951Z", None, None, "2024-03-04T10:59:51.000Z"),
        ("2021-07-19t21:19:30z", None, None, "2021-07-19T21:19:30.000Z"),
        ("2022-10-14T02:38:02.194983000+02:00", None, None, "2022-10-14T00:38:02.194Z"),
        ("2020-09-23T15:42:27+1000", None, None, "2020-09-23T05:42:27.000Z"),
        ("2024-08-25T12:21:18+02", None, None, "2024-08-25T10:21:18.000Z"),
        ("2023-05-08T00:22:13+01:00[Europe/Lisbon]", None, None, "2023-05-07T23:22:13.000Z"),
        ("2019-09-30T18:14:32+00:00[UTC]", None, None, "2019-09-30T18:14:32.000Z"),
        ("Fri, 21 Oct 2022 10:09:40 +0200", None, None, "2022-10-21T08:09:40.000Z"),
        ("Wed, 26 May 2021 16:53:26 GMT", None, None, "2021-05-26T16:53:26.000Z"),
        ("2020-05-17 13:48 UTC+5:30", None, None, "2020-05-17T08:18:00.000Z"),
        ("2022-10-11 09:18 UTC-4", None, None, "2022-10-11T13:18:00.000Z"),
        ("2021-07-30 04:23:50 CEST", B, "dmy", "2021-07-30T02:23:50.000Z"),
        ("9/29/2023 11:16 AM EDT", NY, "mdy", "2023-09-29T15:16:00.000Z"),
        ("2024-05-28 08:07:00 AEST", S, "dmy", "2024-05-27T22:07:00.000Z"),
        ("05/24/2019 12:00:56 PM", NY, "mdy", "2019-05-24T16:00:56.000Z"),
        ("07/01/2022 12:14:10 AM", NY, "mdy", "2022-07-01T04:14:10.000Z"),
        ("Apr 13, 2024 4:21:04 AM UTC", None, None, "2024-04-13T04:21:04.000Z"),
        ("20.10.2024 um 23:10 Uhr", B, "dmy", "2024-10-20T21:10:00.000Z"),
        ("27.02.2020, 16:09", B, "dmy", "2020-02-27T15:09:00.000Z"),
        ("2024-07-15 04:45:18 America/New_York", B, "dmy", "2024-07-15T08:45:18.000Z"),
        ("2024-10-27 02:30:00 CET", B, "dmy", "2024-10-27T01:30:00.000Z"),
        ("1595425506", None, None, "2020-07-22T13:45:06.000Z"),
        ("1588223368.1049", None, None, "2020-04-30T05:09:28.104Z"),
        ("1718750766374", None, None, "2024-06-18T22:46:06.374Z"),
        ("1672184964279952", None, None, "2022-12-27T23:49:24.279Z"),
    ],
)
def test_resolvable(text, zone, order, want):
    assert parse_instant(text, zone, order) == want


@pytest.mark.parametrize(
    "text, zone, order",
    [
        (None, B, "dmy"), ("", B, "dmy"), ("unknown", B, "dmy"), ("last week", B, "dmy"), ("2026-02-30", B, "dmy"), ("31.04.2025", B, "dmy"), ("00/00/0000", B, "dmy"),
        ("2024-07-12T25:61:00Z", B, "dmy"), ("2025-13-05T10:00:00Z", NY, "mdy"), ("2024-01-01 10:00", None, "ymd"), ("2024-01-01 10:00", "No/Where", "ymd"),
        ("2024-10-27 02:30", B, "dmy"), ("2024-03-31 02:30", B, "dmy"), ("2024-03-10 02:08:49 America/New_York", NY, "mdy"), ("2024-07-01 10:00 EDT", B, "dmy"), ("2024-07-01 10:00 CEST", None, "ymd"),
        ("01/02/2024", None, None), ("13:00 PM 2024-01-01", B, "dmy"), ("01/02/2024 13:00 PM", NY, "mdy"), ("20251399", B, "dmy"), ("1234567", B, "dmy"), ("9" * 40, B, "dmy"), ("2024-01-01" + " " * 3 + "x" * 90, B, "dmy"), ("0001-01-01T00:00:00+10:00", B, "ymd"),
    ],
)
def test_not_resolvable(text, zone, order):
    assert parse_instant(text, zone, order) is None


ROWS = "table_name string, record_key string, raw string, zone string, date_order string"


def test_values_go_back_to_their_rows(spark):
    data = [("t", str(i), "2024-05-01", B, "dmy") for i in range(2500)]  # a hot value
    data += [("t", f"n{i}", f"{i % 28 + 1:02}/02/20{i % 20 + 10}", B, "dmy") for i in range(500)]
    data += [("t", "a", "03/04/2024", NY, "mdy"), ("t", "b", "03/04/2024", B, "dmy"), ("t", "c", "03/04/2024", None, None), ("t", "d", None, B, "dmy"), ("t", "d2", "unknown", B, "dmy"), ("u", "a", " 2024-05-01", B, "dmy"), ("u", "a", " 2024-05-01", B, "dmy"), ("u", "e", "z" * 100_000, B, "dmy")]
    got = rows(normalise(spark.createDataFrame(data, ROWS).withColumn("normalized", F.lit("clash"))))
    want = {(t, k, parse_instant(raw, z, o)) for t, k, raw, z, o in data}
    assert got == sorted((w for w in want if w[2]), key=repr)
    assert len(got) == 3003


def test_no_length_is_too_long(spark):
    named = "Wednesday, 1 May 2024 10:00:00.123456789 -03:00 [America/Argentina/ComodRivadavia]"
    data = [("t", "a", "2024-05-01" + " " * 400 + "10:00Z", None, None), ("t", "b", named, None, None), ("t", "c", "2024-05-01" + "\n" * 100_000, None, None), ("t", "d", "5 rooms " * 50_000, B, "dmy"), ("t", "e", "so " * 3 + "2024-05-01", B, "dmy")]
    assert len(named) > 80
    got = rows(normalise(spark.createDataFrame(data, ROWS)))
    assert got == [("t", "a", "2024-05-01T10:00:00.000Z"), ("t", "b", "2024-05-01T13:00:00.123Z"), ("t", "c", "2024-05-01")]
    assert got == sorted((t, k, p) for t, k, raw, z, o in data if (p := parse_instant(raw, z, o)))


def test_a_dictionary_that_cannot_be_read_is_an_error(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "other"))
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"no parquet")
    wanted = spark.createDataFrame([("2024-05-01", B, "dmy", 2)], "raw string, zone string, date_order string, n bigint")
    for name in ("other", "broken"):
        with pytest.raises(Exception):
            extend_dictionary(wanted, str(tmp_path / name)).count()
    assert spark.read.parquet(str(tmp_path / "other")).count() == 3


def test_empty(spark):
    assert normalise(spark.createDataFrame([], ROWS)).count() == 0


def test_dictionary_grows_by_new_values_only(spark, tmp_path):
    path = str(tmp_path / "dictionary")
    schema = "raw string, zone string, date_order string, n bigint"
    extend_dictionary(spark.createDataFrame([("2024-05-01", B, "dmy", 2), ("x1", B, "dmy", 1)], schema), path)
    got = extend_dictionary(spark.createDataFrame([("2024-05-01", B, "dmy", 7), ("2.5.2024", B, "dmy", 1)], schema), path)
    assert rows(got) == [("2.5.2024", B, "dmy", 1, "2024-05-02"), ("2024-05-01", B, "dmy", 7, "2024-05-01")]
    assert spark.read.parquet(path).count() == 3
    data = [("t", "1", "2024-05-01", B, "dmy"), ("t", "2", "3.5.2024", B, "dmy")]
    assert rows(normalise(spark.createDataFrame(data, ROWS), path)) == [("t", "1", "2024-05-01"), ("t", "2", "2024-05-03")]
    assert spark.read.parquet(path).count() == 4


def test_reading_rules_follow_the_source(spark):
    v = spark.createDataFrame([("v1", "a1", "x"), ("v1", "a1", "x"), ("v2", "a9", None), ("v3", None, None)], "id string, artifact_id string, received_at string")
    a = spark.createDataFrame([("a1", "s1"), ("a1", "s1")], "id string, source_id string")
    s = spark.createDataFrame([("s1", "mail"), ("s1", "mail")], "id string, connector string")
    c = spark.createDataFrame([("mail", B, "dmy")], "connector string, local_zone string, date_order string")
    assert rows(connector_of_versions(v, a, s, c)) == [("v1", "x", B, "dmy"), ("v2", None, None, None), ("v3", None, None, None)]


def test_the_query_feeds_its_columns_through_one_dictionary(spark, tables, monkeypatch):
    from deponent.operators import instants
    from deponent.plans.problems import p3_found

    sizes, extend = [], instants.extend_dictionary

    def watched(wanted, path):
        old = instants._known(wanted, path)
        sizes.append((path, 0 if old is None else old.count()))
        return extend(wanted, path)

    monkeypatch.setattr(instants, "extend_dictionary", watched)
    p3_found(spark, tables)
    assert len({path for path, _ in sizes}) == 1 and len(sizes) == 3
    assert 0 == sizes[0][1] < sizes[1][1] < sizes[2][1]
    entries = spark.read.parquet(sizes[0][0])
    assert entries.count() == entries.select("raw", "zone", "date_order").distinct().count()
