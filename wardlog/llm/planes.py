"""Operator 1: token ids as compressed planes, with a chunk index.

Documents are put in ascending ``doc_id`` order, tokenised, and their id stream
is cut into chunks of whole documents. A chunk's ids are laid out in blocks of a
fixed number of ids; every block is transposed into byte planes (all lowest
bytes, then all second bytes, ...) or bit planes, and each plane is compressed
with zstandard on its own. Planes that never change shrink to a few bytes.

The files are Parquet row groups that Spark commits, so a lost task leaves no
half-written shard. A row is a chunk; its index columns are

==========  ==========================================================
shard       number of the range of doc_ids, ascending
chunk       number within the shard
first       ids of the shard before this chunk
n_ids       ids in the chunk
doc_ids     documents of the chunk, in order
lengths     their ids, end id included
blocks      the planes, one list per block
==========  ==========================================================

Defined cases: a null text is empty and yields the end id alone; repeated ids
stay separate documents, ordered by text; an empty table gives an empty folder
that reads back empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlog.llm.common import small_batches, texts, word_encoder

BLOCK_IDS = 1 << 16
CHUNK_IDS = 1 << 17
LEVEL = 1
SCHEMA = (
    "shard int, chunk int, first long, n_ids long, plane string, "
    "doc_ids array<long>, lengths array<long>, blocks array<struct<n:int,planes:array<binary>>>"
)
ARROW = pa.schema(
    [
        ("shard", pa.int32()),
        ("chunk", pa.int32()),
        ("first", pa.int64()),
        ("n_ids", pa.int64()),
        ("plane", pa.string()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("blocks", pa.list_(pa.struct([("n", pa.int32()), ("planes", pa.list_(pa.binary()))]))),
    ]
)


def to_planes(ids: np.ndarray, plane: str) -> list[bytes]:
    """The planes of one block, lowest first, uncompressed."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if plane == "byte":
        return [octets[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, plane: str) -> np.ndarray:
    if plane == "byte":
        octets = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        octets = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").ravel()


def pack_blocks(data: bytes, plane: str, block_ids: int, press: zstandard.ZstdCompressor) -> list[dict]:
    ids = np.frombuffer(data, "<u4")
    return [
        {"n": len(part), "planes": [press.compress(p) for p in to_planes(part, plane)]}
        for part in (ids[at : at + block_ids] for at in range(0, len(ids), block_ids))
    ]


def unpack_blocks(blocks: list[dict], plane: str, open_: zstandard.ZstdDecompressor) -> bytes:
    return b"".join(
        from_planes([open_.decompress(p) for p in b["planes"]], b["n"], plane).astype("<u4").tobytes() for b in blocks
    )


def write_planes(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 2,
    plane: str = "byte",
    block_ids: int = BLOCK_IDS,
    chunk_ids: int = CHUNK_IDS,
) -> None:
    """Tokenise ``docs`` and write their ids below ``folder``.

    One range shuffle by doc_id, of texts rather than of ids: tokenising
    happens behind it, in the task that writes the shard.
    """
    if plane not in ("byte", "bit"):
        raise ValueError(f"unknown plane: {plane}")
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, press = word_encoder(tokenizer), zstandard.ZstdCompressor(level=LEVEL)
        shard, chunk, first = TaskContext.get().partitionId(), 0, 0
        names, lengths, held, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            row = dict(shard=shard, chunk=chunk, first=first, n_ids=size, plane=plane)
            row |= dict(doc_ids=names, lengths=lengths, blocks=pack_blocks(b"".join(held), plane, block_ids, press))
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for batch in small_batches(batches, 4096, 12 << 20):
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode_bytes(batch.column(1)), strict=True):
                n = len(ids) // 4 + 1
                names.append(doc)
                lengths.append(n)
                held += (ids, end)
                size += n
                if size >= chunk_ids:
                    yield close()
                    chunk, first = chunk + 1, first + size
                    names, lengths, held, size = [], [], [], 0
        if names:
            yield close()

    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, SCHEMA).write.mode("errorifexists").option("compression", "uncompressed").parquet(folder)


def read_planes(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, shard, within, ids): ids little-endian unsigned 32-bit, within the
    ids of the shard before the document. Any chunk is decoded alone."""
    chunks = spark.read.parquet(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in small_batches(batches, 1):
            row = batch.to_pylist()[0]
            data, at = unpack_blocks(row["blocks"], row["plane"], open_), 0
            out = {"doc_id": [], "shard": [], "within": [], "ids": []}
            for doc, n in zip(row["doc_ids"], row["lengths"], strict=True):
                out["doc_id"].append(doc)
                out["shard"].append(row["shard"])
                out["within"].append(row["first"] + at)
                out["ids"].append(data[at * 4 : (at + n) * 4])
                at += n
            if at * 4 != len(data):
                raise ValueError(f"chunk {row['chunk']} of shard {row['shard']} is damaged")
            kinds = {"doc_id": pa.int64(), "shard": pa.int32(), "within": pa.int64(), "ids": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in out.items()], names=list(out))

    return chunks.mapInArrow(read, "doc_id long, shard int, within long, ids binary")


def with_starts(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """Turn ``within`` (a shard's own offset) into ``start`` (over all shards).
    Only the shard totals, a row per shard, meet in one task for their running sum."""
    total = spark.read.parquet(folder).groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = total.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "shard").withColumn("start", F.col("base") + F.col("within")).drop("base", "within", "shard")


def digests(rows: DataFrame) -> DataFrame:
    """What the contract asks of the ids read back; keeps the other columns."""
    return rows.withColumns({"n_tokens": (F.octet_length("ids") / 4).cast("long"), "ids_crc32": F.crc32("ids")}).drop("ids")
