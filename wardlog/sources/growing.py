"""Growing log files as a data source whose offsets are bytes.

An offset holds, for each file below the root, its size, the digest of its
first line and of the bytes before its end. The first line names the file, so
a file that was renamed is followed under its new name, and one that was cut or
replaced starts again; the bytes before the end tell files apart whose first
lines are equal, as header lines are. All of this follows from two offsets, so
a restart needs nothing but Spark's checkpoint.

A line belongs to the range of bytes in which its newline lies. Ranges may
therefore be cut anywhere: planning reads no lines, a large range becomes many
tasks, and a line that is still being written waits for its newline.

Defined cases: a file without one whole line is not seen yet; a deleted file
leaves the offset, and bytes that were not read before that are lost with a
failure of the query, not silently; ``\\r\\n`` ends a line like ``\\n``; of a line
longer than the limit the last ``limit + 1`` bytes are kept, which the parsers
refuse for their size; names that begin with a dot or an underscore are left out.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
from collections import defaultdict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from wardlog.config import LIMITS

TAIL_BYTES = 256
READ_BYTES = 1 << 20
ROWS = 8_192
SCHEMA = "value binary, cursor string, file string"
ARROW = pa.schema([("value", pa.binary()), ("cursor", pa.string()), ("file", pa.string())])


@dataclass(frozen=True)
class ByteRange(InputPartition):
    """Bytes ``begin`` to ``end`` of a file; ``size`` and ``tail`` tell it from
    others with this first line."""

    path: str
    identity: str
    size: int
    tail: str
    begin: int
    end: int


def open_root(root: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a folder given as path or address."""
    system, path = fs.FileSystem.from_uri(re.sub(r"\Afile:/+", "/", root))
    return system, path.rstrip("/")


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()[:32]


class Folder:
    """The followed files: where they are, what names them, what they hold."""

    def __init__(self, root: str, pattern: str = "*", limit: int = LIMITS.log_line_bytes):
        self.root, self.pattern, self.limit = root, pattern, limit

    def files(self, below: str = "", recursive: bool = True) -> dict[str, int]:
        system, base = open_root(self.root)
        selector = fs.FileSelector(posixpath.join(base, below), recursive=recursive, allow_not_found=True)
        found = {}
        for info in system.get_file_info(selector):
            path = info.path[len(base) + 1 :]
            hidden = any(part.startswith((".", "_")) for part in path.split("/"))
            if info.type == fs.FileType.File and not hidden and fnmatch(posixpath.basename(path), self.pattern):
                found[path] = info.size
        return found

    def open(self, path: str) -> pa.NativeFile:
        system, base = open_root(self.root)
        return system.open_input_file(f"{base}/{path}")

    def identity(self, stream: pa.NativeFile) -> str | None:
        """Digest of the first line, or of as much of it as a line may have."""
        head = stream.read_at(self.limit + 1, 0)
        line, newline, _ = head.partition(b"\n")
        return digest(line) if newline or len(head) > self.limit else None

    def tail(self, stream: pa.NativeFile, size: int) -> str:
        return digest(stream.read_at(min(size, TAIL_BYTES), max(0, size - TAIL_BYTES)))

    def entry(self, path: str, size: int) -> dict | None:
        try:
            with self.open(path) as stream:
                identity = self.identity(stream)
                return {"id": identity, "size": size, "tail": self.tail(stream, size)} if identity else None
        except FileNotFoundError:
            return None  # renamed or deleted since the listing

    def offset(self) -> dict[str, dict]:
        files = self.files()
        with ThreadPoolExecutor(32) as pool:
            entries = pool.map(self.entry, files, files.values())
        return {path: entry for path, entry in sorted(zip(files, entries)) if entry}

    def holds(self, path: str, entry: dict) -> bool:
        """Whether the file at ``path`` is still the one of ``entry``, grown or not."""
        try:
            with self.open(path) as stream:
                return (
                    stream.size() >= entry["size"]
                    and self.identity(stream) == entry["id"]
                    and self.tail(stream, entry["size"]) == entry["tail"]
                )
        except FileNotFoundError:
            return False

    def unread(self, start: dict[str, dict], end: dict[str, dict]) -> dict[str, int]:
        """Where reading begins in each file of ``end`` that has something new.
        A file goes on from its entry in ``start``; else from one of the same
        folder and first line that its own path no longer holds; else from 0."""
        left, begins = dict(start), {}
        for path, new in end.items():
            old = start.get(path)
            if old == new or (old and old["id"] == new["id"] and self.holds(path, old)):
                begins[path] = left.pop(path)["size"]
        moved = defaultdict(list)
        for path, old in left.items():
            moved[posixpath.dirname(path), old["id"]].append(old)
        for path, new in end.items():
            if path not in begins:
                candidates = moved[posixpath.dirname(path), new["id"]]
                old = next((o for o in candidates if o["size"] <= new["size"] and self.holds(path, o)), None)
                if old:
                    candidates.remove(old)
                begins[path] = old["size"] if old else 0
        return {path: begin for path, begin in begins.items() if begin < end[path]["size"]}

    def ranges(self, start: dict[str, dict], end: dict[str, dict], split_bytes: int) -> list[ByteRange]:
        found = []
        for path, begin in self.unread(start, end).items():
            entry = end[path]
            for at in range(begin, entry["size"], split_bytes):
                stop = min(at + split_bytes, entry["size"])
                found.append(ByteRange(path, entry["id"], entry["size"], entry["tail"], at, stop))
        return found

    def present_path(self, part: ByteRange) -> str:
        """The file's path now: it may have been renamed since the planning."""
        entry = {"id": part.identity, "size": part.size, "tail": part.tail}
        folder = posixpath.dirname(part.path)
        for path in (part.path, *self.files(folder, recursive=False)):
            if self.holds(path, entry):
                return path
        raise FileNotFoundError(f"{part.path} was deleted or cut before bytes {part.begin} to {part.end} were read")

    def line_before(self, stream: pa.NativeFile, position: int) -> bytes:
        """What precedes ``position`` in its line, at most what is kept of one."""
        wanted = min(position, self.limit + 2)
        return stream.read_at(wanted, position - wanted).rpartition(b"\n")[2]

    def lines(self, stream: pa.NativeFile, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
        """(position after the newline, line) of newlines from ``begin`` to ``end``."""
        kept, open_line, position = self.limit + 2, self.line_before(stream, begin), begin
        while position < end:
            block = stream.read_at(min(READ_BYTES, end - position), position)
            if not block:
                raise EOFError("the file became shorter while it was read")
            at = 0
            while (newline := block.find(b"\n", at)) >= 0:
                line = open_line + block[at:newline]
                yield position + newline + 1, line[-kept:].removesuffix(b"\r")
                open_line, at = b"", newline + 1
            open_line = (open_line + block[at:])[-kept:]
            position += len(block)

    def batches(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        """Lines with a cursor that outlives renames and reading again: folder,
        first line's digest, position and the line's own digest."""
        folder = posixpath.dirname(part.path)
        rows: list[tuple[bytes, str, str]] = []
        with self.open(self.present_path(part)) as stream:
            for position, line in self.lines(stream, part.begin, part.end):
                rows.append((line, f"{folder}/{part.identity}:{position}:{digest(line)}", part.path))
                if len(rows) == ROWS:
                    yield as_batch(rows)
                    rows = []
        if rows:
            yield as_batch(rows)


def as_batch(rows: list[tuple[bytes, str, str]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(column, field.type) for column, field in zip(zip(*rows), ARROW)], schema=ARROW)


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, folder: Folder, split_bytes: int):
        self.folder, self.split_bytes = folder, split_bytes

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.folder.offset()

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        return self.folder.ranges(start, end, self.split_bytes)

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return self.folder.batches(partition)


class LogReader(DataSourceReader):
    """The whole lines of all files as they are now."""

    def __init__(self, folder: Folder, split_bytes: int):
        self.folder, self.split_bytes = folder, split_bytes

    def partitions(self) -> list[ByteRange]:
        return self.folder.ranges({}, self.folder.offset(), self.split_bytes)

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition is None else self.folder.batches(partition)  # none when there are no ranges


class GrowingLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return SCHEMA

    def _parts(self) -> tuple[Folder, int]:
        options = self.options
        limit = int(options.get("lineBytes", LIMITS.log_line_bytes))
        folder = Folder(options["path"], options.get("pattern", "*"), limit)
        return folder, int(options.get("splitBytes", 64 << 20))

    def reader(self, schema) -> LogReader:
        return LogReader(*self._parts())

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(*self._parts())


def as_lines(rows: DataFrame) -> DataFrame:
    """Bytes to text as they are: the parsers refuse what is no UTF-8."""
    return rows.select(F.col("value").cast("string").alias("value"), "cursor", "file")


def follow_logs(spark: SparkSession, path: str, pattern: str = "*", **options) -> DataFrame:
    """Lines as files grow: value, cursor, file."""
    spark.dataSource.register(GrowingLogs)
    return as_lines(spark.readStream.format("growing_logs").options(pattern=pattern, **options).load(path))


def read_logs(spark: SparkSession, path: str, pattern: str = "*", **options) -> DataFrame:
    """The same lines with the same cursors, once."""
    spark.dataSource.register(GrowingLogs)
    return as_lines(spark.read.format("growing_logs").options(pattern=pattern, **options).load(path))
