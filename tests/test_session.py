import os
import subprocess
import sys

import __spark_entry__ as entry
import pytest
from pyspark.sql import SparkSession

SCRIPT = """
import os, sys
from deponent.session import build_session, materialize, shared_dir
where, how = sys.argv[1:]
s = build_session("t", "local[1]", 1, **({"spark.checkpoint.dir": where} if how == "setting" else {}))
if how == "context":
    s.sparkContext.setCheckpointDir(where)
assert materialize(s.range(3), "x").count() == 3
folder = shared_dir(s)
print(folder, sum(len(f) for *_, f in os.walk(folder.removeprefix("file:"))))
s.stop()
"""


@pytest.mark.parametrize("how", ["context", "setting", "unset"])
def test_tables_go_to_the_shared_folder_and_end_with_the_process(tmp_path, how):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "conf").mkdir()
    env = {**os.environ, "PYTHONPATH": root, "SPARK_CONF_DIR": str(tmp_path / "conf")}
    out = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path / "shared"), how], capture_output=True, text=True, timeout=120, env=env)
    folder, files = out.stdout.split()
    assert int(files) > 0 and (how == "unset") == (str(tmp_path) not in folder)
    assert not [f for *_, files in os.walk(folder.removeprefix("file:")) for f in files if f.endswith(".parquet")]


def test_a_broken_import_is_no_missing_subpackage(monkeypatch):
    if entry._llm() is None:
        pytest.skip("without the subpackage")
    monkeypatch.setitem(sys.modules, "deponent.llm.queries", None)
    with pytest.raises(ImportError):
        entry.queries()


def test_session_is_utc(spark):
    assert isinstance(spark, SparkSession) and spark.conf.get("spark.sql.session.timeZone") == "UTC"
