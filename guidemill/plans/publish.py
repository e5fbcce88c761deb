"""Versions of several tables that appear together or not at all.

Each table of a version is written to a folder of its own.  A manifest that names the folders of all tables is written last, under
a name that only one writer can take; readers start from a manifest, so they see a whole version, old or new.  What a writer leaves
behind when it stops half-way is in no manifest.  Tables that do not change are carried over by name, and a table may grow by a
folder instead of being rewritten.  The folders lie in the store Spark reads, and all access goes through it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer has published the version that was to follow."""


class Publication:
    """Tables under ``root``; version 0 is empty."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._jvm = spark, root.rstrip("/"), spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _store(self):
        return self._path("manifests").getFileSystem(self._conf)

    def latest(self) -> int:
        """Number of the last version."""
        if not self._store().exists(self._path("manifests")):
            return 0
        names = [s.getPath().getName() for s in self._store().listStatus(self._path("manifests"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def folders(self, version: int | None = None) -> dict[str, list[str]]:
        """Folders of each table, relative to the root."""
        number = self.latest() if version is None else version
        if not number:
            return {}
        stream = self._store().open(self._path(f"manifests/{number:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["tables"]
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None, schema=None) -> DataFrame:
        """A table of a version with the columns ``version`` and ``attempt`` of the folder a row lies in.

        A table that the version does not hold is empty if a ``schema`` is given, else an error.
        """
        parts = self.folders(version).get(table)
        if parts is None:
            if schema is None:
                raise KeyError(f"no table {table} in this version")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{p}" for p in parts])

    def publish(self, tables: Mapping[str, DataFrame], base: int, append: Mapping[str, DataFrame] | None = None, drop: tuple[str, ...] = ()) -> int:
        """Write version ``base + 1``: ``tables`` replaced, ``append`` grown by their rows, ``drop`` left out, all others carried over.

        Raises :class:`Conflict` if that version exists, whether before or after the rows were written.
        """
        number = base + 1
        if self.latest() >= number:
            raise Conflict(f"version {number} exists")
        kept = {t: parts for t, parts in self.folders(base).items() if t not in drop}
        attempt = uuid.uuid4().hex
        for table, rows in {**tables, **(append or {})}.items():
            folder = f"{table}/version={number}/attempt={attempt}"
            rows.drop("version", "attempt").write.parquet(f"{self.root}/{folder}")
            kept[table] = [*(kept.get(table, []) if table not in tables else []), folder]
        self._commit(number, kept)
        return number

    def _commit(self, number: int, tables: Mapping[str, list[str]]) -> None:
        """The manifest is written aside and renamed; renaming onto an existing file fails."""
        hadoop = self._jvm.org.apache.hadoop.fs
        store, aside, final = self._store(), self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{number:012d}.json")
        store.mkdirs(self._path("manifests"))
        out = store.create(aside, False)
        try:
            out.write(bytearray(json.dumps({"version": number, "tables": tables}).encode()))
        finally:
            out.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            hadoop.FileContext.getFileContext(final.toUri(), self._conf).rename(store.makeQualified(aside), store.makeQualified(final), none)
        except Exception as e:  # noqa: BLE001  the store's own exception class depends on the store
            if store.exists(final):
                store.delete(aside, False)
                raise Conflict(f"version {number} exists") from e
            raise


def delete_everywhere(store: Publication, keys: DataFrame, key: str, base: int | None = None) -> int:
    """One version in which no table that has the column ``key`` holds any of the keys; tables without it stay."""
    base = store.latest() if base is None else base
    wanted = keys.select(key).where(F.col(key).isNotNull()).distinct()
    left = {}
    for table in store.folders(base):
        rows = store.read(table, base)
        if key in rows.columns:
            left[table] = rows.join(wanted, key, "left_anti").select(*rows.columns)
    return store.publish(left, base)
