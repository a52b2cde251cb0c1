"""Session set-up and the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex[:12]
_ENDING: set[str] = set()
_OWN: list[str] = []


def build_session(app: str = "deponent", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE and its skew-join splitting."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or else the one set by ``setCheckpointDir``.
    Only where neither is set and all executors are this process (tests, a local session) a temporary
    folder of this machine is made and removed at exit."""
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="deponent-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, never reused by another run or call. What is written there
    lasts until ``cleanup`` or the end of the process."""
    run = os.path.join(shared_dir(spark), f"deponent-{_RUN}")
    if run not in _ENDING:
        _ENDING.add(run)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run)
        atexit.register(_delete, path, spark.sparkContext._jsc.hadoopConfiguration())
    return os.path.join(run, f"{name}-{uuid.uuid4().hex[:8]}")


def _delete(path, conf) -> None:
    """Delete a folder through the JVM, which outlives a stopped session; a lost JVM leaves it."""
    with contextlib.suppress(Py4JError, OSError):
        path.getFileSystem(conf).delete(path, True)


def cleanup(spark: SparkSession) -> None:
    """Delete the tables that this run wrote to the shared folder; results that read them end with it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(shared_dir(spark), f"deponent-{_RUN}"))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back: lineage is cut, the
    rows survive the loss of any executor, and later branches don't compute them again."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
