"""Operator 5: SimHash near-duplicates by pigeonhole blocks.

A fingerprint is the bitwise majority of the XXH64 (seed 42) of all word
shingles. It is cut into ``BLOCKS`` blocks; two fingerprints that differ in at
most ``DISTANCE`` bits agree in at least ``BLOCKS - DISTANCE`` of them, so the
join runs on every choice of that many blocks and misses nothing. Candidates of
a bucket are verified by Hamming distance in vectors.

Equal fingerprints are folded to one row before the join, so copies cost
nothing. Inside a bucket a search from a seed outwards emits a spanning forest,
never all pairs. A bucket of more than ``BUCKET`` fingerprints is split into
blocks and each pair of blocks is a task of its own: exact, and no task holds
more than two blocks. Components come from alternating star contraction over
those links.

Defined cases: text without a word has fingerprint zero and links like any
other; null text is empty; fewer words than a shingle make one shingle of all;
a bit set in exactly half the hashes is 0; repeated doc_ids stay separate rows;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlog.llm.common import column_bytes, small_batches, texts
from wardlog.session import cut_lineage, stage_table

SHINGLE = 4
SEED = 42
DISTANCE = 4
BLOCKS = 6
#: Fingerprints of a bucket searched together; two blocks of it at most meet in a task.
BUCKET = 20_000
#: Groups up to this size are compared at all lags at once.
SMALL = 16


def shingle_hashes(text: bytes, n: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of each shingle; A-Z lowered, words set apart by white space of ASCII."""
    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if not words:
        return []
    if len(words) <= n:
        return [digest(b" ".join(words), seed)]
    return [digest(s, seed) for s in map(b" ".join, zip(*(words[k:] for k in range(n))))]


def majority(rows: list[list[int]]) -> np.ndarray:
    """Fingerprints of many texts at once."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    out = np.zeros(len(rows), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    flat = np.fromiter((h for row in rows for h in row), np.uint64, int(sizes.sum()))
    starts = (np.cumsum(sizes) - sizes)[some]
    octets = flat.view(np.uint8).reshape(-1, 8)
    half = sizes[some]
    for k in range(8):
        bits = np.unpackbits(octets[:, k]).reshape(-1, 8)
        counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        chosen = np.packbits(2 * counts > half[:, None], axis=1)[:, 0]
        out[some] |= chosen.astype(np.uint64) << np.uint64(8 * k)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp long) of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 256):
            fps = majority([shingle_hashes(t, shingle, seed) for t in column_bytes(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def _cuts(blocks: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each block."""
    ends = [64 * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _keys(blocks: int, distance: int):
    """One bucket key per choice of blocks that must agree, as an array column."""
    keys = []
    for number, chosen in enumerate(combinations(_cuts(blocks), blocks - distance)):
        key = F.lit(number).cast("long")
        for low, bits in chosen:
            part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1))
            key = F.shiftleft(key, bits).bitwiseOR(part)
        keys.append(key)
    return F.array(*keys)


def forest(fps: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is within ``distance``, n - 1 at most: search outwards from a seed."""
    left = fps
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = np.bitwise_count(left ^ front[0]) <= distance
            found = left[near]
            if len(found):
                yield np.full(len(found), front[0]), found
                left = left[~near]
            front = np.append(front[1:], found)


def bucket_links(key: np.ndarray, fp: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links inside each run of equal keys (rows sorted by key)."""
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(edge, len(key)))
    for lag in range(1, min(SMALL, len(key))):
        same = (key[lag:] == key[:-lag]) & (np.bitwise_count(fp[lag:] ^ fp[:-lag]) <= distance)
        same &= np.repeat(size, size)[lag:] <= SMALL
        at = np.flatnonzero(same)
        if len(at):
            yield fp[at], fp[at + lag]
    for start, n in zip(edge[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        yield from forest(fp[start : start + n], distance)


def links(distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """(u, v) links, u > v, among distinct fingerprints (column fp, each once)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last bucket may go on in the next batch

        def search(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            cell = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            same = np.ones(batch.num_rows, bool)
            for c in cell[:3]:
                same[1:] &= c[1:] == c[:-1]
            same[:1] = False
            run_of = np.cumsum(~same)
            for u, v in bucket_links(run_of, cell[3].view(np.uint64), distance):
                u, v = u.view(np.int64), v.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

        def joined() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            first, last = (tuple(batch.column(k)[at].as_py() for k in range(3)) for at in (0, batch.num_rows - 1))
            if first == last:
                continue
            whole = joined()
            cell = [whole.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            open_ = np.logical_and.reduce([c == c[-1] for c in cell])
            start = int(np.flatnonzero(~open_)[-1]) + 1
            yield from search(whole.slice(0, start))
            held[:] = [whole.slice(start)]
        if held:
            yield from search(joined())

    keyed = distinct.select("fp", F.explode(_keys(blocks, distance)).alias("key"))
    heavy = keyed.groupBy("key").count().where(F.col("count") > bucket)
    heavy = heavy.select("key", F.ceil(F.col("count") / bucket).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    with_own = keyed.join(heavy, "key", "left").withColumn("own", F.coalesce(own, F.lit(0)))
    others = F.expr("filter(sequence(0, parts - 1), x -> x != own)")
    partners = F.when(F.coalesce("parts", F.lit(1)) > 1, others).otherwise(F.array(F.lit(0)))
    cells = with_own.select("key", "fp", "own", F.explode(partners).alias("other"))
    cells = cells.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    sorted_ = cells.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "fp")
    return sorted_.mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of an edge (u, v) reaches.

    Alternating large and small stars; every round is pre-aggregated joins on
    narrow rows and is checkpointed. Ends when a round changes nothing.
    """
    now = cut_lineage(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        count = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(count) == mark or not count[0]:
            break
        mark = tuple(count)
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut_lineage(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    blocks: int = BLOCKS,
    bucket: int = BUCKET,
) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest doc_id reachable over links."""
    fps = stage_table(fingerprints(docs, shingle), "simhash")
    distinct = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), distance, blocks, bucket))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(smallest, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")
