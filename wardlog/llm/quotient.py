"""Operator 7: exact duplicates through counting quotient filters.

Every partition builds counting quotient filters of its texts' 64-bit
fingerprints, one per slice of the fingerprint range. Filters of a slice merge
by their sorted remainders without loss, in the task that owns the slice, those
of like size first. The fingerprints counted more than once are marked in a
bitmap sized by their number, up to 32 MB; only texts whose mark is set travel, and those are grouped by their bytes, which is
the verification: a false mark or a shared fingerprint costs a row of traffic
and changes nothing. Grouping collapses copies before the shuffle, so a hot
text is sent once per task.

Defined cases: a null text equals an empty one; a text occurring once keeps
itself; the largest doc_id of a group stays (nulls last); rows that repeat both
doc_id and text are reported alike, while ``deduplicate`` keeps one row per
text; an empty table gives an empty result; other columns are ignored by the
report and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.llm.common import free_name, texts
from wardlog.session import stage_table, staged_table

#: Marks of repeated fingerprints: 2**MARK_BITS bits a fingerprint, 2**MOST_BITS (32 MB) in all.
MARK_BITS = 5
MOST_BITS = 28
BUCKET_BITS = 15  # Spark's bitmap functions hold 2**15 bits a row


class CountingQuotientFilter:
    """A static filter over fingerprints of ``bits`` bits.

    A fingerprint is a quotient (its high ``q`` bits) and a remainder. Slots
    hold the remainders of each quotient in ascending order, runs in order of
    quotient; ``occupied`` marks quotients that have a run, ``ends`` the last
    slot of each run. A remainder seen more than once is followed by a slot
    with its count, marked in ``counters``.
    """

    def __init__(self, bits: int, q: int, occupied, ends, counters, slots):
        self.bits, self.q = bits, q
        self.occupied, self.ends, self.counters, self.slots = occupied, ends, counters, slots

    @classmethod
    def build(cls, fps: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """From ascending distinct fingerprints and their counts."""
        q = min(bits, max(1, (max(len(fps), 1) - 1).bit_length()))
        r = np.uint64(bits - q)
        quotient = (fps >> r).astype(np.int64)
        remainder = fps & ((np.uint64(1) << r) - np.uint64(1))
        width = 1 + (counts > 1)
        last = np.cumsum(width) - 1
        size = int(last[-1]) + 1 if len(last) else 0
        slots, counters, ends = np.zeros(size, np.uint64), np.zeros(size, bool), np.zeros(size, bool)
        slots[last - width + 1] = remainder
        many = counts > 1
        slots[last[many]] = counts[many]
        counters[last[many]] = True
        if size:
            ends[last[np.append(quotient[1:] != quotient[:-1], True)]] = True
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        return cls(bits, q, occupied, ends, counters, slots)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Ascending fingerprints and their counts."""
        run = np.cumsum(np.append(False, self.ends[:-1])) if len(self.ends) else np.zeros(0, np.int64)
        quotient = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        own = ~self.counters
        fps = (quotient << np.uint64(self.bits - self.q) | self.slots)[own]
        counts = np.ones(len(self.slots), np.uint64)
        counted = np.flatnonzero(self.counters)
        counts[counted - 1] = self.slots[counted]
        return fps, counts[own]

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Counts add up; nothing is lost, whatever the two sizes."""
        fps, counts = (np.concatenate(x) for x in zip(self.items(), other.items(), strict=True))
        order = np.argsort(fps, kind="stable")  # merges the two ascending runs
        return type(self).build(*summed(fps[order], counts[order]), self.bits)

    def dump(self) -> bytes:
        head = np.array([self.bits, self.q, len(self.slots)], "<u8").tobytes()
        maps = [np.packbits(m).tobytes() for m in (self.occupied, self.ends, self.counters)]
        return b"".join([head, *maps, self.slots.astype("<u8").tobytes()])

    @classmethod
    def load(cls, data: bytes) -> CountingQuotientFilter:
        bits, q, n = (int(x) for x in np.frombuffer(data, "<u8", 3))
        at, maps = 24, []
        for size in (1 << q, n, n):
            octets = (size + 7) // 8
            maps.append(np.unpackbits(np.frombuffer(data, np.uint8, octets, at), count=size).astype(bool))
            at += octets
        return cls(bits, q, *maps, np.frombuffer(data, "<u8", n, at).astype(np.uint64))


def summed(fps: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal neighbours folded into one, counts added."""
    if not len(fps):
        return fps, counts
    first = np.flatnonzero(np.append(True, fps[1:] != fps[:-1]))
    return fps[first], np.add.reduceat(counts, first)


def fingerprint(text: str | Column = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def _slice_bits(df: DataFrame) -> int:
    """As many slices as shuffle partitions, a setting that follows the data."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()


def filters(fps: DataFrame) -> DataFrame:
    """(slice, filter) of a table of fingerprints (column fp), merged over all partitions."""
    top = _slice_bits(fps)
    low = 64 - top

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
        values, counts = np.unique(np.concatenate(parts or [np.zeros(0, np.uint64)]), return_counts=True)
        where = values >> np.uint64(low)
        edges = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(values) else np.zeros(0, np.int64)
        for a, b in zip(edges, np.append(edges[1:], len(values))[: len(edges)], strict=True):
            own = values[a:b] & np.uint64((1 << low) - 1)
            cqf = CountingQuotientFilter.build(own, counts[a:b].astype(np.uint64), low)
            yield pa.RecordBatch.from_pydict(
                {"slice": pa.array([int(where[a])], pa.int32()), "filter": pa.array([cqf.dump()], pa.binary())}
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, levels = None, []

        def out() -> pa.RecordBatch:
            cqf = levels.pop()[1]
            while levels:
                cqf = levels.pop()[1].merge(cqf)
            return pa.RecordBatch.from_pydict(
                {"slice": pa.array([at], pa.int32()), "filter": pa.array([cqf.dump()], pa.binary())}
            )

        for batch in batches:
            for number, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                other = CountingQuotientFilter.load(data)
                if number != at and levels:
                    yield out()
                at, level = number, 0
                # like sizes merge, as digits carry: each filter is merged log2(partitions) times
                while levels and levels[-1][0] == level:
                    other, level = levels.pop()[1].merge(other), level + 1
                levels.append((level, other))
        if levels:
            yield out()

    own = fps.select("fp").mapInArrow(build, "slice int, filter binary")
    return own.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, filter binary")


def repeated(filter_table: DataFrame) -> DataFrame:
    """(fp, count) of the fingerprints counted more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cqf = CountingQuotientFilter.load(data)
                fps, counts = cqf.items()
                full = (fps | np.uint64(number << cqf.bits))[counts > 1].view(np.int64)
                yield pa.RecordBatch.from_pydict({"fp": full, "count": counts[counts > 1].astype(np.int64)})

    return filter_table.select("slice", "filter").mapInArrow(run, "fp long, count long")


def marks(fps: DataFrame) -> bytes:
    """A bitmap of the fingerprints' high bits, so large that one in 32 is set, and 32 MB at most."""
    bits = min(MOST_BITS, max(BUCKET_BITS, fps.count().bit_length() + MARK_BITS))
    bit = F.shiftrightunsigned("fp", 64 - bits) + 1
    rows = (
        fps.groupBy(F.bitmap_bucket_number(bit).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
        .collect()
    )
    out = np.zeros((1 << bits - BUCKET_BITS, 1 << BUCKET_BITS - 3), np.uint8)
    for row in rows:
        out[row.bucket - 1] = np.frombuffer(bytes(row.bits), np.uint8)
    return out.tobytes()


def is_marked(bitmap: bytes, fps: pa.Array) -> np.ndarray:
    bits = np.frombuffer(bitmap, np.uint8)
    top = fps.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - len(bits).bit_length() - 2)
    return ((bits[(top >> np.uint64(3)).astype(np.int64)] >> (top & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def marked(rows: DataFrame, bitmap: bytes, keep: bool = True, fp: str = "fp") -> DataFrame:
    """Rows (with their fingerprint in column ``fp``) whose mark is set, or is not set."""
    held = rows.sparkSession.sparkContext.broadcast(bitmap)
    at = rows.columns.index(fp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(is_marked(held.value, batch.column(at)) == keep))

    return rows.mapInArrow(run, rows.schema)


def _marks_of(docs: DataFrame) -> bytes:
    with staged_table(filters(docs.select(fingerprint().alias("fp"))), "quotient") as found, staged_table(repeated(found), "repeated") as fps:
        return marks(fps)


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    rows = texts(docs)
    sent = marked(rows.withColumn("fp", F.xxhash64("text")), _marks_of(docs))
    groups = (
        sent.groupBy("fp", "text")
        .agg(F.max("doc_id").alias("largest"), F.count("*").alias("size"))
        .where("size > 1")
        .select(F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "largest", "size")
    )
    own = rows.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    out = own.join(stage_table(groups, "copies"), "text_sha256", "left")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("largest"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """One whole row per text, that of the largest doc_id (of equal ids the row
    whose JSON hashes largest); texts that occur once do not move. Columns may
    have any type and name, and a null text stays null."""
    own = free_name(docs, "fingerprint_of_text")
    rows, bitmap = docs.withColumn(own, fingerprint()), _marks_of(docs)
    rest = [c for c in docs.columns if c != "text"]
    whole = F.struct(F.col("text").isNull().alias("no_text"), F.struct(*rest).alias("row"))
    order = F.struct("doc_id", F.xxhash64(F.to_json(F.struct(*rest, F.col("text").isNull().alias(own)))))
    some = marked(rows, bitmap, fp=own).groupBy(own, F.coalesce("text", F.lit("")).alias("text")).agg(F.max_by(whole, order).alias("best"))
    text = F.when(~F.col("best.no_text"), F.col("text")).alias("text")
    chosen = some.select(text, *(F.col(f"best.row.{c}").alias(c) for c in rest)).select(*docs.columns)
    return marked(rows, bitmap, keep=False, fp=own).select(*docs.columns).unionByName(chosen)
