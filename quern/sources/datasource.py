"""A reader as a Spark data source: spark.read.format("quern_archive").load(folder).

One partition a file; ZIP archives are expanded where they are read."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.errors import ArchiveRefused, NotFound
from quern.sources.archive import expand
from quern.sources.files import SKIPPED_FOLDERS, SKIPPED_SUFFIXES


class _File(InputPartition):
    def __init__(self, path: str, name: str):
        self.path, self.name = path, name


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file://").rstrip("/")

    def partitions(self) -> Sequence[InputPartition]:
        if not os.path.isdir(self.folder):
            raise NotFound(f"no folder {self.folder}")
        out = []
        for at, folders, names in os.walk(self.folder):
            folders[:] = sorted(f for f in folders if f not in SKIPPED_FOLDERS)
            out += [_File(p, os.path.relpath(p, self.folder)) for n in sorted(names) if not n.lower().endswith(SKIPPED_SUFFIXES) for p in [os.path.join(at, n)]]
        return out

    def read(self, part: _File) -> Iterator[tuple]:
        with open(part.path, "rb") as f:
            data = f.read()
        if not part.name.lower().endswith(".zip"):
            yield part.name, f"file://{part.path}", data, None
            return
        try:
            members = list(expand(data, part.name))
        except ArchiveRefused as e:
            yield part.name, f"file://{part.path}", None, str(e)
            return
        for name, body in members:
            yield name, f"file://{part.path}!{name.split('!', 1)[1]}", body, None


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quern_archive"

    def schema(self) -> str:
        return "external_id string, uri string, content binary, error string"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)
