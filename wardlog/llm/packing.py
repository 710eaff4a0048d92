"""Operator 10: online packing with a bounded number of open windows.

Each partition keeps ``windows`` open sequences. A document's full-length pieces
become sequences at once; its last, shorter piece goes to the open window it
fills best. When it fits none, the fullest window is emitted and a new one
opened. What is still open when a partition ends is bounded by the number of
windows; those leftovers are merged, ``MERGE`` partitions at a time, into a
stream that is cut at the sequence length, so that only the last sequence of a
merge is padded. No state grows with the data, and only leftovers are shuffled.

Rows: a piece each. ``ids`` are the piece's own ids, little-endian unsigned
32-bit. Defined cases: a null or empty text is the end id alone; repeated rows
are packed each; an empty table gives no sequence; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlog.llm.common import CACHE_WORDS, small_batches, texts, word_encoder
from wardlog.session import stage_table

LENGTH = 4096
WINDOWS = 64
#: Partitions whose leftovers are merged in one task: 8 x 64 windows at most.
MERGE = 8
#: Sequence ids: partition and counter for those emitted, above this bit for merged leftovers.
MERGED = 1 << 62
FIELDS = [
    ("doc_id", pa.int64()),
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()),
    ("offset", pa.int64()),
    ("ids", pa.binary()),
    ("part", pa.int32()),
]
ARROW = pa.schema(FIELDS)
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, ids binary, part int"
)
Piece = tuple[int | None, int, int, bytes]  # doc_id, start, ids of the document, ids


class Windows:
    """Open windows of one partition, by free room."""

    def __init__(self, length: int, limit: int):
        self.length, self.limit = length, limit
        self.free: list[tuple[int, int]] = []  # (room, number), ascending
        self.held: dict[int, list[Piece]] = {}
        self.count = 0

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Place a piece; yields the sequences this completes."""
        size = len(piece[3]) // 4
        if size >= self.length:
            yield [piece]
            return
        at = bisect_left(self.free, (size, -1))
        if at < len(self.free):
            room, number = self.free.pop(at)
        else:
            if len(self.free) >= self.limit:
                yield self.held.pop(self.free.pop(0)[1])
            room, number = self.length, self.count
            self.held[number] = []
            self.count += 1
        self.held[number].append(piece)
        if room == size:
            yield self.held.pop(number)
        else:
            insort(self.free, (room - size, number))

    def leftovers(self) -> list[list[Piece]]:
        return [self.held[number] for _, number in self.free]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in FIELDS]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), kind) for c, (_, kind) in zip(columns, FIELDS, strict=True)], schema=ARROW
    )


def _rows(pieces: list[Piece], sequence: int | None, part: int, keep: bool) -> Iterator[tuple]:
    at = 0
    for doc, start, total, ids in pieces:
        n = len(ids) // 4
        yield (doc, start, n, zlib.crc32(ids), total, sequence, at, ids if keep or sequence is None else None, part)
        at += n


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    length: int = LENGTH,
    windows: int = WINDOWS,
    keep_ids: bool = True,
    cache: int = CACHE_WORDS,
    batch_bytes: int = 12 << 20,
) -> DataFrame:
    """Sequences of at most ``length`` ids; without ``keep_ids`` the ids are not
    carried along. The first pass is staged, so that texts are tokenised once.
    ``cache`` words and ``batch_bytes`` of text bound a worker's memory; they
    change the time it takes, never the result."""
    end = np.array([end_id], "<u4").tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_encoder(tokenizer, cache), TaskContext.get().partitionId()
        open_, sequence, step = Windows(length, windows), part << 36, 4 * length
        for batch in small_batches(batches, 4096, batch_bytes):
            out = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode_bytes(batch.column(1)), strict=True):
                ids += end
                total = len(ids) // 4
                for at in range(0, len(ids), step):
                    for full in open_.add((doc, at // 4, total, ids[at : at + step])):
                        out += _rows(full, sequence, part, keep_ids)
                        sequence += 1
            yield _batch(out)
        yield _batch([row for left in open_.leftovers() for row in _rows(left, None, part, True)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sequence, room, held = None, 0, length, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["group"] != group:
                    if held:
                        out += _rows(held, sequence, -1, keep_ids)
                    group, sequence, room, held = row["group"], MERGED | row["group"] << 32, length, []
                start, ids = row["start"], row["ids"]
                while ids:
                    piece, ids = ids[: 4 * room], ids[4 * room :]
                    held.append((row["doc_id"], start, row["doc_tokens"], piece))
                    start += len(piece) // 4
                    room -= len(piece) // 4
                    if not room:
                        out += _rows(held, sequence, -1, keep_ids)
                        sequence, room, held = sequence + 1, length, []
            yield _batch(out)
        if held:
            yield _batch(list(_rows(held, sequence, -1, keep_ids)))

    once = stage_table(texts(docs).mapInArrow(first, SCHEMA), "packing")
    open_ = once.where("sequence_id IS NULL").withColumn("group", F.floor(F.col("part") / MERGE))
    order = ["group", "doc_id", "start", "part", "ids_crc32"]
    dealt = open_.select("doc_id", "start", "doc_tokens", "ids", "part", "ids_crc32", "group").repartition("group")
    merged = dealt.sortWithinPartitions(*order).mapInArrow(merge, SCHEMA)
    out = once.where("sequence_id IS NOT NULL").unionByName(merged).drop("part")
    return out if keep_ids else out.drop("ids")
