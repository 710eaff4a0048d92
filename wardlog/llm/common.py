"""What several operators share: row selection, staged tables, word-cached tokenising."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words kept per worker, and the longest that is kept: about 300 MB at most.
CACHE_WORDS = 1_400_000
CACHE_WORD_BYTES = 16
#: ASCII white space, the separators of ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"


def texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text) only, so that other columns are neither read nor clash; null text is empty."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def remainder(key: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: what splits learning rows from held-out ones."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(column.cast("string").cast("binary")) % n


def column_bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


class WordEncoder:
    """The tokenizers library behind a bounded cache of words.

    The tokenizer drops white space and never looks across it, so the ids of a
    text are those of its words in a row. Unseen words of a batch go to the
    library together, set apart by a control character.
    """

    SEPARATOR = "\x01"

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.cache: dict[bytes, bytes] = {}
        self.mark = self._encode(self.SEPARATOR)
        if len(self.mark) != 1:
            raise ValueError("the tokenizer has no single id for the separator")

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, words: list[bytes]) -> None:
        """Encode unseen words: together, set apart by the separator."""
        apart = self.SEPARATOR.encode()
        for w in words:
            if apart in w:
                self.cache[w] = self._encode(w.decode("utf-8", "replace")).tobytes()
        plain = [w for w in words if apart not in w]
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            joined = f" {self.SEPARATOR} ".join([w.decode("utf-8", "replace") for w in some])
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.append(np.flatnonzero(ids == self.mark[0]), len(ids)).tolist()
            data, start = ids.tobytes(), 0
            for word, end in zip(some, ends, strict=True):
                self.cache[word] = data[start * 4 : end * 4]
                start = end + 1

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column in a row, and where each text's ids end:
        (ids, offsets). Words are looked up once per batch, not per occurrence."""
        words = pc.ascii_split_whitespace(column)
        distinct = words.flatten().dictionary_encode()
        known = distinct.dictionary.cast(pa.binary()).to_pylist()
        if len(self.cache) > self.limit:
            self.cache.clear()
        new = list(filterfalse(self.cache.__contains__, known))
        self._learn(new)
        held = [self.cache[w] for w in known]
        for word in new:
            if len(word) > CACHE_WORD_BYTES:
                del self.cache[word]
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        starts = np.cumsum(sizes) - sizes
        order = distinct.indices.to_numpy(zero_copy_only=False)
        each = sizes[order]
        ends = np.cumsum(each)
        take = np.ones(int(ends[-1]) if len(ends) else 0, np.int32)  # steps of one within a word, then summed
        some = np.flatnonzero(each)
        firsts = starts[order[some]]
        take[ends[some] - each[some]] = firsts - np.append(0, (firsts + each[some] - 1)[:-1]) if len(some) else 0
        ids = np.frombuffer(b"".join(held), "<u4")[np.cumsum(take, dtype=np.int32)]
        return ids, np.append(0, ends)[words.offsets.to_numpy() - words.offsets[0].as_py()]

    def encode_bytes(self, column: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, ends = self.encode(column)
        data, ends = ids.tobytes(), (ends * 4).tolist()
        return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


_HELD: dict = {}


def per_worker(key, build: Callable[[], object]):
    """The one model a worker process keeps: the last that was asked for, so
    that stages of a pipeline do not add up in a worker's memory."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


def word_encoder(path: str, limit: int = CACHE_WORDS) -> WordEncoder:
    return per_worker(("words", path, limit), lambda: WordEncoder(path, limit))


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = 1024, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and, where rows are alike, ``size`` bytes:
    bounds what a worker holds at once whatever the texts' lengths."""
    for batch in batches:
        step = max(1, min(rows, -(-batch.num_rows // max(1, -(-batch.nbytes // size)))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    pa.default_memory_pool().release_unused()


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows, cut only where the first ``keys`` columns change."""
    held: list[list[np.ndarray]] = []

    def joined() -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*held, strict=True)]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if all(held[0][k][0] == held[-1][k][-1] for k in range(keys)):
            continue
        whole = joined()
        open_ = np.logical_and.reduce([c == c[-1] for c in whole[:keys]])
        end = int(np.flatnonzero(~open_)[-1]) + 1
        yield [c[:end] for c in whole]
        held = [[c[end:] for c in whole]]
    if held:
        yield joined()


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table does not have, whatever the case of its names."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
