"""Tables in versions: a batch is applied once, and readers see a whole version or the one before.

A version is a manifest ``versions/<number>.json`` in the table's folder, which names the
folders of data that make it up and, for each source of batches, the last batch applied.
Data is written first; then the manifest is renamed to its number, which fails if another
writer took it. A crash before that leaves the old version, and folders that
:meth:`Published.clean` deletes. Renaming has to be atomic, as on HDFS and local disks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from sieveworks.operators import changes

#: Folders of data that a version of counters has at most before they are merged.
MOST_PARTS = 16


@dataclass(frozen=True)
class Version:
    number: int = 0
    parts: tuple[str, ...] = ()
    applied: dict[str, int] = field(default_factory=dict)


class Published:
    """A table of one schema in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, schema: str) -> None:
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _files(self, name: str) -> list[str]:
        at = self._path(f"{self.folder}/{name}")
        return [s.getPath().getName() for s in self._store.listStatus(at)] if self._store.exists(at) else []

    def latest(self) -> Version:
        """The newest version; number 0 has no rows."""
        numbers = [int(f.removesuffix(".json")) for f in self._files("versions") if f.endswith(".json") and f[0].isdigit()]
        if not numbers:
            return Version()
        text = self.spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils
        stream = self._store.open(self._path(f"{self.folder}/versions/{max(numbers):012d}.json"))
        try:
            told = json.loads(bytes(text.readFullyToByteArray(stream)).decode())
        finally:
            stream.close()
        return Version(told["version"], tuple(told["parts"]), told["applied"])

    def read(self, version: Version | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        parts = (version or self.latest()).parts
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/data/{p}" for p in parts))

    def write(self, rows: DataFrame) -> str:
        """Rows as a folder of data that no version has yet."""
        part = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/data/{part}")
        return part

    def publish(self, before: Version, parts: Sequence[str], source: str, batch: int) -> Version:
        """The version after ``before`` with these parts; an error if another writer made one meanwhile."""
        after = Version(before.number + 1, tuple(parts), before.applied | {source: batch})
        folder = f"{self.folder}/versions"
        self._store.mkdirs(self._path(folder))
        draft = self._path(f"{folder}/_{uuid.uuid4().hex}")
        stream = self._store.create(draft, False)
        stream.write(bytearray(json.dumps({"version": after.number, "parts": after.parts, "applied": after.applied}).encode()))
        stream.close()
        if not self._renamed(draft, self._path(f"{folder}/{after.number:012d}.json")):
            self._store.delete(draft, False)
            raise RuntimeError(f"version {after.number} of {self.folder} was made by another writer")
        return after

    def _renamed(self, draft, target) -> bool:
        return not self._store.exists(target) and self._store.rename(draft, target)

    def apply(self, source: str, batch: int, make: Callable[[Version], Sequence[str]]) -> bool:
        """Publish the parts that ``make`` gives, unless the source's batch, or a later one, was applied before."""
        before = self.latest()
        if before.applied.get(source, -1) >= batch:
            return False
        self.publish(before, make(before), source, batch)
        return True

    def clean(self, keep: int = 1) -> None:
        """Delete data that none of the newest ``keep`` versions names, and older manifests. Not while a batch is being applied or an older version is read."""
        now = self.latest().number
        named: set[str] = set()
        for f in self._files("versions"):
            at = self._path(f"{self.folder}/versions/{f}")
            if f[0].isdigit() and int(f.removesuffix(".json")) > now - keep:
                stream = self._store.open(at)
                named |= set(json.loads(bytes(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode())["parts"])
                stream.close()
            else:
                self._store.delete(at, False)
        for part in set(self._files("data")) - named:
            self._store.delete(self._path(f"{self.folder}/data/{part}"), True)


def counters(table: Published, on: Sequence[str], merged: dict[str, str]) -> DataFrame:
    """The counters that a table keeps as parts, one row a key."""
    rows = table.read()
    return changes.upsert(rows, rows.limit(0), on, merged)


def counter_sink(table: Published, on: Sequence[str], merged: dict[str, str], source: str, most_parts: int = MOST_PARTS) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that adds a batch's rows to counters, once.

    A batch becomes one part, folded by key; parts are folded when the table is read, and
    merged into one when there are ``most_parts`` of them. Null keys are keys.
    """

    def sink(rows: DataFrame, batch: int) -> None:
        def make(before: Version) -> list[str]:
            part = table.write(changes.upsert(rows, rows.limit(0), on, merged))
            if len(before.parts) < most_parts:
                return [*before.parts, part]
            whole = table.read(Version(parts=(*before.parts, part)))
            return [table.write(changes.upsert(whole, whole.limit(0), on, merged))]

        table.apply(source, batch, make)

    return sink


#: What a table of a compacted change log holds.
CHANGE_MAP = "old string, new string"


def change_map_sink(table: Published, source: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that brings a compacted change log (:data:`CHANGE_MAP`) up to date with a batch of later records (seq, old, new), once."""

    def sink(rows: DataFrame, batch: int) -> None:
        table.apply(source, batch, lambda before: [table.write(changes.compact_further(table.read(before), rows))])

    return sink
