import json

import pytest
from pyspark.sql import functions as F

from deponent.sources.ledger import Ledger, Migration
from deponent.sources.tables import read_tsv
from deponent.streaming.ingest import latest_states, stream_files
from tests.conftest import rows


def test_batches_are_appended_once_and_atomically(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.read("t") is None and ledger.batches() == []
    one = spark.createDataFrame([(1, "a")], "id int, v string")
    assert ledger.append("b1", {"t": one}) and not ledger.append("b1", {"t": one})
    assert ledger.append("b2", {"t": spark.createDataFrame([(2, "b")], "id int, v string"), "u": one})
    assert rows(ledger.read("t")) == [(1, "a"), (2, "b")] and rows(ledger.read("u")) == [(1, "a")]
    # a batch without manifest, as a lost writer leaves it, is not there
    one.write.parquet(str(tmp_path / "ledger/batches/b3-lost/t"))
    assert ledger.read("t").count() == 2 and ledger.batches() == ["b1", "b2"]
    with pytest.raises(ValueError):
        ledger.append("b4", {"t": one.withColumn("more", F.lit(1))})


def test_only_new_keys(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    ledger.append_new("b1", "t", spark.createDataFrame([(1, "a"), (1, "a")], "id int, v string"), ["id"])
    ledger.append_new("b2", "t", spark.createDataFrame([(1, "x"), (2, "b")], "id int, v string"), ["id"])
    assert rows(ledger.read("t")) == [(1, "a"), (2, "b")]


def test_newer_schema_is_refused(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    ledger.append("b1", {"t": spark.range(1)})
    m = tmp_path / "ledger/_manifests/b1.json"
    m.write_text(json.dumps(json.loads(m.read_text()) | {"schema_version": 99}))
    (tmp_path / "ledger/_manifests/.b1.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        ledger.read("t")


def test_migrations_are_applied_in_order(spark, tmp_path):
    root, base = str(tmp_path / "ledger"), spark.createDataFrame([(1, "a")], "id int, v string")
    note, size = Migration(2, "note", "t", (("note", "string"),)), Migration(3, "size", "t", (("size", "bigint"), ("unit", "string")))
    Ledger(spark, root).append("b1", {"t": base, "u": base})
    one = Ledger(spark, root, (note,))
    with pytest.raises(ValueError, match="due"):
        one.append("b2", {"t": base})
    assert one.schema_version() == 1 and one.migrate() == [2] and one.migrate() == [] and one.schema_version() == 2
    one.append("b2", {"t": base.withColumn("note", F.lit("n"))})
    with pytest.raises(ValueError, match="differ"):
        one.append("b3", {"t": base})
    both = Ledger(spark, root, (note, size))
    assert both.migrate() == [3]
    both.append("b4", {"t": base.withColumns({"note": F.lit("m"), "size": F.lit(4).cast("bigint"), "unit": F.lit("kg")}), "u": base})
    assert rows(both.read("t")) == [(1, "a", "m", 4, "kg"), (1, "a", "n", None, None), (1, "a", None, None, None)] and both.read("u").count() == 2
    for other in ((), (note,), (note._replace(name="other"), size)):
        with pytest.raises(ValueError, match="doesn't know"):
            Ledger(spark, root, other).read("t")
    with pytest.raises(ValueError, match="consecutive"):
        Ledger(spark, root, (size,))


def test_tsv_headers_go_by_their_place(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("\nid\tname\n1\tAnn\nid\tname\n2\n3\t x\n\n4\tBo\n")
    (tmp_path / "b.tsv").write_text("id\tname\n5\tCy\n")
    good, bad = read_tsv(spark, str(tmp_path), ["id", "name"])
    assert rows(good) == [("1", "Ann"), ("4", "Bo"), ("5", "Cy"), ("id", "name")] and rows(bad) == [("2",), ("3\t x",)]
    (tmp_path / "c.tsv").write_text("name\tid\n5\tCy\n")
    with pytest.raises(ValueError):
        read_tsv(spark, str(tmp_path), ["id", "name"])
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.tsv").write_text("\n")
    with pytest.raises(ValueError):
        read_tsv(spark, str(tmp_path / "empty"), ["id", "name"])


def test_stream_of_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("name: Ann\n")
    (folder / "bad.csv").write_text('a\n"')
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    stream_files(spark, str(folder), ledger, str(tmp_path / "cp")).awaitTermination(120)
    assert rows(ledger.read("fields"), "predicate", "original_value") == [("name", "Ann")]
    assert rows(ledger.read("failures"), "reason") == [("malformed_input",)]
    (folder / "b.txt").write_text("name: Bo\n")
    stream_files(spark, str(folder), ledger, str(tmp_path / "cp")).awaitTermination(120)
    assert rows(ledger.read("fields"), "original_value") == [("Ann",), ("Bo",)]


def test_windowed_states(spark, tmp_path):
    path = str(tmp_path / "changes")
    schema = "claim_id string, id string, state string, changed_at timestamp"
    spark.sql("select 'c' claim_id, stack(3, '1', 'a', timestamp'2024-01-01 10:01:00', '2', 'b', timestamp'2024-01-01 10:02:00', '3', 'z', timestamp'2024-01-01 19:00:00') as (id, state, changed_at)").write.parquet(path)
    out = latest_states(spark.readStream.schema(schema).parquet(path))
    q = out.writeStream.format("memory").queryName("states").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("states"), "claim_id", "state") == [("c", "b")]
