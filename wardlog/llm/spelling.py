"""Operator 12: spelling variants by blocked Gram matrices of letter counts.

Words that differ by one inserted, deleted or replaced letter have letter counts
at a squared distance of 1 or 2. Blocks of words of one length and of the next
are multiplied as NumPy matrices of letter counts; what the products leave at a
squared distance of at most two is verified letter by letter.

So that the vocabulary need not meet itself, blocks of a length are cut further:
an edit leaves the first half of a word or the rest of it alone, so two near
words share one of them. Each word lies under both halves, for its own length
and for the one below; halves are hashed to blocks of about ``BLOCK`` words. A
block of more than ``TILE`` words is split, and each pair of its parts is a task
of its own. A pair is emitted once, under its first half if that is shared.

Defined cases: null text has no words; null doc_id hashes as an empty one; words
of any length and alphabet; of equally frequent near words the smallest in
code-point order is the form; repeated rows count each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlog.llm.common import small_batches, texts, whole_runs
from wardlog.session import stage_table

LETTERS = "a-zÀ-ÿ"
MIN_LENGTH = 6
MIN_COUNT = 5
#: A form is at least so many times as frequent as the word.
TIMES = 5
BLOCK = 256
TILE = 2048
#: Of so many runs one loses a letter.
DAMAGE = 199
#: Distinct words a task counts before it passes them on, and letters compared at once.
FLUSH = 200_000
CHUNK = 4_000_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def damaged_run(doc: int, run: str) -> str:
    """A run without the letter at h % length if ``DAMAGE`` divides its hash h; ``doc``
    is the crc32 of ``<doc_id>:``."""
    h = crc32(run.encode(), doc)
    at = h % len(run)
    return run if h % DAMAGE else run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough."""
    find = re.compile(f"[{LETTERS}]+").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in small_batches(batches, 256):
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                mark = crc32(b":" if doc is None else b"%d:" % doc)
                for word, n in Counter(find(body.translate(LOWER).decode("utf-8", "replace"))).items():
                    if len(word) >= min_length and len(word := damaged_run(mark, word)) >= min_length:
                        total[word] += n
            if len(total) > FLUSH:
                yield out()
                total.clear()
        if total:
            yield out()

    counted = texts(docs).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _letters(words: np.ndarray, size: int) -> np.ndarray:
    """Code points of words, one row each, padded with zeros to ``size``."""
    return np.frombuffer("".join([w.ljust(size, "\0") for w in words]).encode("utf-32-le"), "<u4").reshape(len(words), size)


def _gram_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two letter-count matrices at a squared distance of at most two."""
    away = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.nonzero(away < 2.5)


def _verified(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, length: int, first_half: bool) -> np.ndarray:
    """Which of the pairs of words (a of ``length``, b of that or one more) are one
    edit apart and belong to this half."""
    out = np.zeros(len(i), bool)
    half, step = length // 2, max(1, CHUNK // (length + 1))
    same_length = b.shape[1] == length
    for at in range(0, len(i), step):
        x, y = a[i[at : at + step], :length], b[j[at : at + step]]
        equal = x == y[:, :length]
        shared = equal[:, :half].all(1) == first_half
        if same_length:
            near = (~equal).sum(1) == 1
        else:
            head = np.logical_and.accumulate(equal, axis=1).sum(1)
            tail = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(1)
            near = head + tail >= length
        out[at : at + step] = near & shared
    return out


def block_pairs(length: int, first_half: bool, words: np.ndarray, part: np.ndarray, split: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs (places) within a block: words of ``length`` with each other and
    with those one longer. Of a split block only pairs across its two parts."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = _letters(words, length + 1)
    letters, column = np.unique(codes, return_inverse=True)
    flat = np.arange(len(words))[:, None] * len(letters) + column.reshape(codes.shape)
    counts = np.bincount(flat.ravel(), minlength=len(words) * len(letters)).reshape(len(words), -1)
    counts = counts[:, letters != 0].astype(np.float32 if length < 2_000 else np.float64)
    for own in np.unique(part):
        short = np.flatnonzero((sizes == length) & (part == own))
        others = part != own if split else part == own
        for equal in (True, False):
            other = np.flatnonzero((sizes == (length if equal else length + 1)) & others)
            if not len(short) or not len(other) or (equal and split and own != part.min()):
                continue
            i, j = _gram_pairs(counts[short], counts[other])
            if equal and not split:
                i, j = i[i < j], j[i < j]
            ok = _verified(codes[short], codes[other][:, : length + (not equal)], i, j, length, first_half)
            if ok.any():
                yield short[i[ok]], other[j[ok]]


def near_words(vocabulary: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(word, near, near_n), both ways: the pairs of words (word, n) one edit apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_runs(batches, 5):
            new = np.logical_or.reduce([c[1:] != c[:-1] for c in whole[:5]])
            edges = np.append(np.flatnonzero(np.append(True, new)), len(whole[0])).tolist()
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if end - start < 2:
                    continue
                length, half, _, a, b, part, word, n = (c[start:end] for c in whole)
                for i, j in block_pairs(int(length[0]), not half[0], word, part, a[0] != b[0]):
                    left, right = np.append(i, j), np.append(j, i)
                    arrays = [pa.array(word[left], pa.string()), pa.array(word[right], pa.string()), pa.array(n[right])]
                    yield pa.RecordBatch.from_arrays(arrays, names=["word", "near", "near_n"])

    size = F.char_length("word")
    halves = F.expr(
        """flatten(transform(array(size, size - 1), l -> array(
             struct(l AS length, 0 AS half, left(word, int(l / 2)) AS shared),
             struct(l AS length, 1 AS half, right(word, l - int(l / 2)) AS shared))))"""
    )
    keyed = vocabulary.withColumn("size", size).withColumn("k", F.explode(halves)).select("k.*", "word", "n")
    blocks = keyed.groupBy("length", "half").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    blocks = stage_table(blocks, "spelling")  # two rows a length: its size is known, so the words stay where they are
    keyed = keyed.join(blocks, ["length", "half"]).withColumn("block", F.pmod(F.xxhash64("shared"), F.col("blocks")).cast("int"))
    keyed = keyed.select("length", "half", "block", "word", "n")
    heavy = keyed.groupBy("length", "half", "block").count().where(F.col("count") > tile)
    heavy = heavy.select("length", "half", "block", F.ceil(F.col("count") / tile).cast("int").alias("parts"))
    split = keyed.join(heavy, ["length", "half", "block"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    split = split.withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    tiles = split.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    cell = ["length", "half", "block", "a", "b"]
    tiles = tiles.select("length", "half", "block", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "word", "n")
    return tiles.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, "word string, near string, near_n long")


def variants(vocabulary: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word (word, n)."""
    vocabulary = stage_table(vocabulary.select("word", "n"), "spelling")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    often = -F.col("best.less") >= TIMES * F.col("n")
    found = vocabulary.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(often, F.col("best.near")).alias("form"),
        F.when(often, -F.col("best.less")).alias("form_n"),
    )
    found = stage_table(found, "spelling")
    # Each step to a form multiplies the count, which bounds the steps; pointers double.
    most = vocabulary.agg(F.max("n")).first()[0] or 1
    steps = max(0, int(math.log(most, TIMES)))
    up = found.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(steps.bit_length()):
        onward = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = stage_table(up.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling")
    return found.join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))
