"""Empty files below a folder, which Spark's file sources leave out.

A Python data source: the driver lists the root alone, each folder in it is
listed to its depth by a task of its own.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wardlog.sources.growing import open_root

ARROW = pa.schema([("file", pa.string())])


@dataclass(frozen=True)
class Subtree(InputPartition):
    folder: str
    recursive: bool


class EmptyFileReader(DataSourceReader):
    def __init__(self, root: str, pattern: str):
        self.root, self.pattern = root, pattern

    def partitions(self) -> list[Subtree]:
        system, base = open_root(self.root)
        top = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
        folders = sorted(posixpath.basename(i.path) for i in top if i.type == fs.FileType.Directory)
        return [Subtree("", False), *[Subtree(name, True) for name in folders]]

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        system, base = open_root(self.root)
        start = posixpath.join(base, partition.folder).rstrip("/")
        found = system.get_file_info(fs.FileSelector(start, recursive=partition.recursive, allow_not_found=True))
        names = [
            info.path[len(base) + 1 :]
            for info in found
            if info.type == fs.FileType.File and info.size == 0 and fnmatch(info.base_name, self.pattern)
        ]
        # The same names as Spark leaves out in the other half of the scan.
        shown = [n for n in names if not any(part.startswith((".", "_")) for part in n.split("/"))]
        if shown:
            yield pa.record_batch([pa.array(shown, pa.string())], schema=ARROW)


class EmptyFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "empty_files"

    def schema(self) -> str:
        return "file string"

    def reader(self, schema) -> EmptyFileReader:
        return EmptyFileReader(self.options["path"], self.options.get("pattern", "*"))


def empty_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """The relative path of every empty file."""
    spark.dataSource.register(EmptyFiles)
    return spark.read.format("empty_files").option("pattern", pattern).load(root)
