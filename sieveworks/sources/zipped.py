"""JSON members of a zip as rows, one partition a member."""

from __future__ import annotations

import fnmatch
import json
import zipfile
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from sieveworks.sources import readers

#: What a value must be to stand in a column; others are null there, as when JSON is read.
_KINDS = {StringType: str, LongType: int, DoubleType: (int, float)}


class Member(InputPartition):
    def __init__(self, name: str) -> None:
        super().__init__(name)


class ZippedJson(DataSource):
    """Options: ``path`` of the zip, ``members`` (a pattern of their file names). Columns are those of the reader's schema, ``member`` and ``error`` besides."""

    @classmethod
    def name(cls) -> str:
        return "zipped_json"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZippedReader(schema, self.options["path"], self.options.get("members", "*.json"))


class ZippedReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, members: str) -> None:
        self.schema, self.path, self.members = schema, path, members

    def partitions(self) -> Sequence[InputPartition]:
        with zipfile.ZipFile(self.path) as file:
            names = sorted(i.filename for i in file.infolist() if not i.is_dir() and fnmatch.fnmatchcase(i.filename.rsplit("/", 1)[-1], self.members))
        return [Member(n) for n in names] or [Member("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        name = partition.value
        if not name:
            return
        columns = [(f.name, _KINDS.get(type(f.dataType))) for f in self.schema.fields if f.name not in ("member", "error")]
        try:
            with zipfile.ZipFile(self.path) as file:
                entries = json.loads(file.read(name))
            if not isinstance(entries, list):
                raise ValueError("no list of entries")
        except Exception as problem:  # a broken member never hides the others
            yield (*(None for _ in columns), name, f"{type(problem).__name__}: {problem}")
            return
        for entry in entries:
            row = [entry.get(c) if isinstance(entry, dict) else None for c, _ in columns]
            yield (*(v if kind is None or isinstance(v, kind) and not isinstance(v, bool) else None for v, (_, kind) in zip(row, columns)), name, None)


def zipped_history(spark: SparkSession, path: str, names: str = "*Audio*.json") -> tuple[DataFrame, DataFrame]:
    """(history rows, (member, error)): as :func:`sieveworks.sources.readers.history` reads the unpacked folder, and the members that can't be read.

    The zip lies where the driver and all executors open it under one path; each member is read by one task.
    """
    spark.dataSource.register(ZippedJson)
    schema = StructType([*readers.HISTORY.fields, StructField("member", StringType()), StructField("error", StringType())])
    rows = spark.read.format("zipped_json").schema(schema).option("members", names).load(path)
    good = rows.where("error is null and coalesce(spotify_track_uri, '') <> '' and coalesce(master_metadata_track_name, '') <> ''")
    return good.drop("member", "error"), rows.where("error is not null").select("member", "error")
