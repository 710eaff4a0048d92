"""Operator 2: byte-level BPE by a segment tree.

A text is cut by the vocabulary's pattern; each match is encoded on its own. For
a match of n bytes the tree has a leaf for every byte position but the last,
holding (rank of the pair that starts there, position), and every inner node the
smaller of its children, so the root is the leftmost minimum. A merge takes the
root, joins two live neighbours and rewrites at most three leaves, each in
log2(n) steps: n log n for a match of any length, hostile ones included.

A match that is itself in the vocabulary is one id, as the public library has it.
Matches recur, so each worker keeps a bounded table of those already encoded.

Defined cases: null text is empty and has no ids; repeated rows stay; an empty
table gives an empty result; other columns are ignored. Decoding any ids of the
vocabulary gives their bytes in a row; an unknown id raises.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from wardlog.llm.common import per_worker, small_batches, texts

CACHE_PIECES = 1_000_000
CACHE_PIECE_CHARS = 48
NONE = 1 << 62
SHIFT = 40


class ByteBpe:
    """Ranks and pattern; ``encode`` and ``decode`` work on one text."""

    def __init__(self, path: str, pattern: str, limit: int = CACHE_PIECES):
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.decimals = {rank: str(rank).encode() for rank in self.tokens}
        self.find = regex.compile(pattern).findall
        self.limit = limit
        self.cache: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one match."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        parts = [piece[i : i + 1] for i in range(n)]
        size = 1 << max(0, (n - 2).bit_length())
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                tree[size + i] = rank << SHIFT | i
        for i in range(size - 1, 0, -1):
            left, right = tree[2 * i], tree[2 * i + 1]
            tree[i] = left if left < right else right
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        low = (1 << SHIFT) - 1
        while (top := tree[1]) != NONE:
            i = top & low
            j = after[i]
            k = after[j]
            parts[i] = joined = parts[i] + parts[j]
            after[i] = k
            if k < n:
                before[k] = i
                rank = ranks.get(joined + parts[k])
                changes = [(i, NONE if rank is None else rank << SHIFT | i), (j, NONE)]
            else:  # the last position has no leaf
                changes = [(i, NONE)] if j == n - 1 else [(i, NONE), (j, NONE)]
            h = before[i]
            if h >= 0:
                rank = ranks.get(parts[h] + joined)
                changes.append((h, NONE if rank is None else rank << SHIFT | h))
            for leaf, value in changes:
                at = size + leaf
                if tree[at] == value:
                    continue
                tree[at] = value
                at >>= 1
                while at:
                    least = tree[2 * at]
                    right = tree[2 * at + 1]
                    if right < least:
                        least = right
                    if tree[at] == least:
                        break
                    tree[at] = least
                    at >>= 1
        ids, i = [], 0
        while i < n:
            ids.append(ranks[parts[i]])
            i = after[i]
        return ids

    def encode_batch(self, batch: list[str]) -> Iterator[bytes]:
        """Little-endian signed 32-bit ids of each text."""
        cache = self.cache
        if len(cache) > self.limit:
            cache.clear()
        long = set()
        for text in batch:
            pieces = self.find(text)
            for piece in set(filterfalse(cache.__contains__, pieces)):
                cache[piece] = np.array(self.merge(piece.encode()), "<i4").tobytes()
                if len(piece) > CACHE_PIECE_CHARS:
                    long.add(piece)
            yield b"".join(map(cache.__getitem__, pieces))
        for piece in long:
            cache.pop(piece, None)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decimal(self, ids: list[int]) -> bytes:
        """The ids in decimal, joined by one space."""
        return b" ".join(map(self.decimals.__getitem__, ids))


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return per_worker(("pieces", path, pattern), lambda: ByteBpe(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in small_batches(batches):
            rows = list(bpe.encode_batch(batch.column(1).to_pylist()))
            ends = np.cumsum([0, *(len(r) // 4 for r in rows)], dtype=np.int32)
            values = pa.array(np.frombuffer(b"".join(rows), "<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["doc_id", "ids"]
            )

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def _lists(column: pa.ListArray) -> Iterator[list[int]]:
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return (values[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True))


def decode(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded binary) from (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in small_batches(batches):
            out = pa.array([bpe.decode(row) for row in _lists(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["doc_id", "decoded"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digests(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """Of (doc_id, ids): n_tokens, ids_sha256 and, decoded again, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in small_batches(batches):
            n, by_ids, by_bytes = [], [], []
            for row in _lists(batch.column(1)):
                n.append(len(row))
                by_ids.append(hashlib.sha256(bpe.decimal(row)).hexdigest())
                by_bytes.append(hashlib.sha256(bpe.decode(row)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(by_ids, pa.string()), pa.array(by_bytes, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return ids.select("doc_id", "ids").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
