"""Append-only ledger of Parquet tables with atomic batches.

A batch writes its tables under a directory of its own; one manifest file, renamed into place, makes
all of it visible at once. Readers list the batches that have a manifest. There is no update and no
overwrite. A batch id that is already committed is skipped, so a retried batch adds nothing.

Tables grow by migrations, which add columns, one version after another; older batches have nulls
there. Each applied one is kept with its checksum, so a changed, missing or newer one is noticed.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Version of a ledger without migrations.
SCHEMA_VERSION = 1


def schema_checksum(schema: T.StructType) -> str:
    return hashlib.sha256(schema.simpleString().encode()).hexdigest()


class Migration(NamedTuple):
    """Columns that a version adds to a table."""

    version: int
    name: str
    table: str
    added: tuple[tuple[str, str], ...]  # name and type

    @property
    def checksum(self) -> str:
        return hashlib.sha256(json.dumps(self).encode()).hexdigest()


class Ledger:
    def __init__(self, spark: SparkSession, root: str, migrations: tuple[Migration, ...] = ()):
        self.spark, self.root, self.migrations = spark, root.rstrip("/"), migrations
        self._schemas: dict[str, str] = {}
        if [m.version for m in migrations] != list(range(SCHEMA_VERSION + 1, SCHEMA_VERSION + 1 + len(migrations))):
            raise ValueError("migrations have consecutive versions, in order")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _files(self, folder: str) -> list[dict]:
        """The JSON files of a folder, by name."""
        place = self._path(f"{self.root}/{folder}")
        if not self._fs.exists(place):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(place) if s.getPath().getName().endswith(".json"))
        rows = self.spark.read.text([f"{self.root}/{folder}/{n}" for n in names], wholetext=True).collect() if names else []
        return [json.loads(r[0]) for r in rows]

    def _put(self, folder: str, name: str, content: dict) -> bool:
        """Write a JSON file whole or not at all; False if it is there already. Some file systems let a
        rename replace a file, so its place is looked at first."""
        place, draft = (self._path(f"{self.root}/{folder}/{n}") for n in (f"{name}.json", f".{name}-{uuid.uuid4().hex[:8]}"))
        if self._fs.exists(place):
            return False
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if self._fs.rename(draft, place):
            return True
        self._fs.delete(draft, False)
        return False

    def schema_version(self) -> int:
        """The version that the ledger has. Refuses one with migrations that this engine doesn't know, or
        knows otherwise."""
        applied = sorted(self._files("_migrations"), key=lambda a: a["version"])
        known = {m.version: m.checksum for m in self.migrations}
        for n, a in enumerate(applied, SCHEMA_VERSION + 1):
            if a["version"] != n or known.get(n) != a["checksum"]:
                raise ValueError(f"ledger has migration {a['version']} ({a['name']}), which this engine doesn't know or knows otherwise")
        return SCHEMA_VERSION + len(applied)

    def migrate(self) -> list[int]:
        """Apply the migrations that are due, in order; the versions that were."""
        due = self.migrations[self.schema_version() - SCHEMA_VERSION :]
        return [m.version for m in due if self._put("_migrations", f"{m.version:06d}", {"version": m.version, "name": m.name, "checksum": m.checksum})]

    def _manifests(self) -> list[dict]:
        found = sorted(self._files("_manifests"), key=lambda m: m["batch"])
        newest = max((m["schema_version"] for m in found), default=0)
        if newest > self.schema_version():
            raise ValueError(f"ledger of schema version {newest}, this engine knows {self.schema_version()}")
        return found

    def _schema(self, checksum: str) -> T.StructType:
        """A schema by its checksum: each is kept once, however many batches have it."""
        if checksum not in self._schemas:
            self._schemas.update((f["checksum"], f["schema"]) for f in self._files("_schemas"))
        return T.StructType.fromJson(json.loads(self._schemas[checksum]))

    def _grown(self, manifest: dict, name: str) -> T.StructType | None:
        """The columns that a batch's table has by now."""
        if name not in manifest["tables"]:
            return None
        schema = self._schema(manifest["tables"][name]["checksum"])
        for m in self.migrations[manifest["schema_version"] - SCHEMA_VERSION :]:
            for column, kind in m.added if m.table == name else ():
                schema = schema.add(T.StructType.fromDDL(f"`{column}` {kind}")[0])
        return schema

    def batches(self) -> list[str]:
        return [m["batch"] for m in self._manifests()]

    def append(self, batch: str, tables: dict[str, DataFrame]) -> bool:
        """Commit ``tables`` as ``batch``; False if it is committed already. Refuses a table whose
        columns differ from those it has in the ledger, and a ledger with migrations due."""
        version = self.schema_version()
        if version != SCHEMA_VERSION + len(self.migrations):
            raise ValueError("migrations are due")
        manifests = self._manifests()
        if batch in (m["batch"] for m in manifests):
            return False
        checksums = {n: schema_checksum(df.schema) for n, df in tables.items()}
        grown: dict[tuple, str] = {}
        for m in manifests:
            for name in tables.keys() & m["tables"].keys():
                key = (name, m["tables"][name]["checksum"], m["schema_version"])
                if key not in grown:
                    grown[key] = schema_checksum(self._grown(m, name))
                if grown[key] != checksums[name]:
                    raise ValueError(f"columns of {name} differ from batch {m['batch']}")
        folder = f"{self.root}/batches/{batch}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{folder}/{name}")
            if checksums[name] not in self._schemas:
                self._put("_schemas", checksums[name], {"checksum": checksums[name], "schema": df.schema.json()})
        written = {n: {"path": f"{folder}/{n}", "checksum": checksums[n]} for n in tables}
        return self._put("_manifests", batch, {"batch": batch, "schema_version": version, "tables": written})

    def read(self, name: str) -> DataFrame | None:
        """All committed rows of a table, None if no batch has it."""
        holding = [m for m in self._manifests() if name in m["tables"]]
        if not holding:
            return None
        return self.spark.read.schema(self._grown(holding[0], name)).parquet(*(m["tables"][name]["path"] for m in holding))

    def append_new(self, batch: str, name: str, rows: DataFrame, key: list[str]) -> bool:
        """Append the rows whose key isn't in the table yet, one for each key."""
        once = rows.dropDuplicates(key)
        old = self.read(name)
        return self.append(batch, {name: once if old is None else once.join(old.select(*key), key, "left_anti").select(*rows.columns)})
