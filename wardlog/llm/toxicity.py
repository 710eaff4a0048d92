"""Operator 9: toxicity by a convolutional text classifier.

Words (lower case, split at ASCII white space and punctuation) are hashed to
``SLOTS`` values; those found in ``LEAST_TEXTS`` learning texts have an embedding,
all others the zero vector. Filters of several ``WIDTHS`` slide over the whole text
and each keeps its largest response. A logistic layer over these gives the
logit. Everything is trained in numpy with sparse gradients: through max
pooling only the winning windows learn. The logit is shifted by a threshold
calibrated for the language, so that 0.5 is the decision everywhere; at scoring
the language is itself told from the words, by a table learned with the model.

It learns from every labelled row that is not held out: word counts and
calibration are sums over all of them, and an epoch goes through all learning
rows in parts of about ``PART_ROWS``, whose changes are averaged. Texts stay with
Spark; the model, which is all that reaches the driver, has a fixed size. Only
the text enters a score. Scoring has no shuffle.

Defined cases: a null text is empty and scores like any text without words;
where labels of one class are missing nothing can be learned, and every score
is 0; a document labelled twice counts as toxic if any label says so; labels
without a value are ignored; rows that repeat stay; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import copy
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from wardlog.llm.common import remainder, small_batches
from wardlog.session import staged_table

SIZE = 16
FILTERS = 8
WIDTHS = (1, 2, 3)
#: Values that words are hashed to; 0 is no word. Counts of one chunk are a row.
SLOTS = 1 << 18
CHUNK = 1 << 12
#: Learning rows meant for a part; parts of one epoch learn beside each other.
PART_ROWS = 16_384
#: Batches of a part that are mixed anew in every epoch.
STRETCH = 32
#: Bins of calibration per unit of the logit, and its bounds.
BINS = 256
LIMIT = 1_000
EPOCHS = 5
BATCH = 64
RATE = 0.05
#: Learning texts a word must occur in to have an embedding; rarer ones would
#: only be learned by heart and stay zero.
LEAST_TEXTS = 2
#: Texts' worth of prior in a word's starting log odds.
SMOOTH = 2.0
#: Share of the learning rows kept for calibration.
CALIBRATION = 0.25
#: Cost of a clean text called toxic, where a missed toxic text costs 1.
FALSE_ALARM = 2.0
#: Rows of each class that a language needs for a threshold of its own.
LANGUAGE_ROWS = 15
LANGUAGES = 32
PAD = max(WIDTHS) - 1
#: The largest number at half precision.
HALF_MOST = 65_504
_SPACES = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def word_rows(texts: pa.Array, hashes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The embedding row of every word of a column, each text followed by ``PAD``
    empty places, and where each text starts. Row 0 is no embedding; row k + 1
    belongs to ``hashes[k]``. Without ``hashes``: the words' hashes themselves."""
    plain = [t.translate(_SPACES) for t in pc.utf8_lower(texts).cast(pa.binary()).to_pylist()]
    words = pc.ascii_split_whitespace(pa.array(plain, pa.binary()).cast(pa.string()))
    distinct = words.flatten().dictionary_encode()
    known = distinct.dictionary.cast(pa.binary()).to_pylist()
    table = np.fromiter((1 + zlib.crc32(w) % (SLOTS - 1) if w else 0 for w in known), np.int64, len(known))
    if hashes is not None:
        at = np.minimum(np.searchsorted(hashes, table), max(0, len(hashes) - 1))
        table = np.where(hashes[at] == table, at + 1, 0) if len(hashes) else np.zeros(len(table), np.int64)
    flat = table[distinct.indices.to_numpy(zero_copy_only=False)]
    sizes = np.diff(words.offsets.to_numpy())
    starts = np.cumsum(sizes + PAD) - (sizes + PAD)
    out = np.zeros(int(sizes.sum()) + PAD * len(sizes), np.int64)
    out[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))] = flat
    return out, starts


@dataclass
class Model:
    """Parameters; ``filters[w]`` is (w, SIZE, FILTERS)."""

    hashes: np.ndarray  # ascending
    words: np.ndarray  # (1 + hashes) x SIZE, row 0 zero
    filters: dict[int, np.ndarray]
    shifts: dict[int, np.ndarray]
    weights: np.ndarray
    bias: float
    languages: list[str]
    language_table: np.ndarray  # (1 + hashes) x languages
    thresholds: np.ndarray  # one per language, then the common one

    @classmethod
    def start(cls, hashes: np.ndarray, seed: int = 7) -> Model:
        draw = np.random.default_rng(seed)
        words = draw.normal(0, 0.1, (len(hashes) + 1, SIZE)).astype(np.float32)
        words[0] = 0
        filters = {w: draw.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS}
        shifts = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        weights = draw.normal(0, 0.3, (len(WIDTHS), FILTERS)).astype(np.float32)
        return cls(hashes, words, filters, shifts, weights, 0.0, [], np.zeros((len(words), 0), np.float32), np.zeros(1))

    def dense(self) -> np.ndarray:
        """All parameters but the words in a row, in the order of :func:`dense_keys`."""
        return np.concatenate([self._at(key).ravel() for key in dense_keys()]).astype(np.float64)

    def _at(self, key: tuple) -> np.ndarray:
        return {
            "bias": lambda: np.array([self.bias]),
            "weights": lambda: self.weights[key[1]],
            "shifts": lambda: self.shifts[key[1]],
            "filters": lambda: self.filters[key[1]][key[2]],
        }[key[0]]()

    def responses(self, w: int, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Responses of the filters of width w at every place; no window sees the next text."""
        padded = np.append(ids, np.zeros(w - 1, ids.dtype))
        used, place = np.unique(padded, return_inverse=True)
        rows = self.words[used]
        out = np.zeros((len(ids), FILTERS), np.float32)
        for j in range(w):
            out += (rows @ self.filters[w][j])[place[j : j + len(ids)]]
        ends = np.append(starts[1:], len(ids))
        for k in range(1, w):
            out[ends - k] = 0
        return out + self.shifts[w]

    def logits(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.full(len(starts), self.bias, np.float64)
        for k, w in enumerate(WIDTHS):
            out += np.maximum(np.maximum.reduceat(self.responses(w, ids, starts), starts, axis=0), 0) @ self.weights[k]
        return out

    def language(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The likeliest language of each text, the number of languages where none is known."""
        if not self.languages:
            return np.zeros(len(starts), np.int64)
        sums = np.add.reduceat(self.language_table[ids], starts, axis=0)
        return np.where(np.abs(sums).sum(axis=1) > 0, sums.argmax(axis=1), len(self.languages))

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        ids, starts = word_rows(texts, self.hashes)
        shifted = self.logits(ids, starts) - self.thresholds[self.language(ids, starts)]
        return 1 / (1 + np.exp(-np.clip(shifted, -30, 30)))

    def train_batch(self, ids: np.ndarray, starts: np.ndarray, labels: np.ndarray, weight: np.ndarray, memory: dict) -> None:
        """One Adagrad step on a batch of texts."""
        ends = np.append(starts[1:], len(ids))
        tops, places = [], []
        for w in WIDTHS:
            own = self.responses(w, ids, starts)
            at = np.array([a + own[a:b].argmax(axis=0) for a, b in zip(starts, ends, strict=True)])
            places.append(at)
            tops.append(np.maximum(own[at, np.arange(FILTERS)], 0))
        logit = self.bias + sum(t @ self.weights[k] for k, t in enumerate(tops))
        slope = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) * weight / len(labels)
        steps = {("bias", 0): np.array([slope.sum()])}
        padded = np.append(ids, np.zeros(PAD, ids.dtype))
        rows, changes = [], []
        for k, w in enumerate(WIDTHS):
            steps["weights", k] = slope @ tops[k]
            back = slope[:, None] * self.weights[k] * (tops[k] > 0)
            steps["shifts", w] = back.sum(axis=0)
            for j in range(w):
                word = np.where(places[k] + j < ends[:, None], padded[places[k] + j], 0)
                steps["filters", w, j] = np.einsum("bf,bfd->df", back, self.words[word])
                rows.append(word.ravel())
                changes.append((back[:, :, None] * self.filters[w][j].T).reshape(-1, SIZE))
        used, inverse = np.unique(np.concatenate(rows), return_inverse=True)
        total = np.zeros((len(used), SIZE), np.float32)
        np.add.at(total, inverse, np.concatenate(changes))
        total[used == 0] = 0

        def scaled(key, step, rows=None):
            held = memory.setdefault(key, np.zeros(self.words.shape if rows is not None else step.shape, np.float32))
            if rows is None:
                held += step**2
                return RATE * step / np.sqrt(held + 1e-8)
            held[rows] += step**2
            return RATE * step / np.sqrt(held[rows] + 1e-8)

        self.words[used] -= scaled("words", total, used)
        for key, step in steps.items():
            move = scaled(key, step)
            if key[0] == "bias":
                self.bias -= float(move[0])
            elif key[0] == "weights":
                self.weights[key[1]] -= move
            elif key[0] == "shifts":
                self.shifts[key[1]] -= move
            else:
                self.filters[key[1]][key[2]] -= move


def dense_keys() -> list[tuple]:
    """Keys of ``Model.train_batch``'s steps besides the words."""
    keys: list[tuple] = [("bias", 0)]
    for k, w in enumerate(WIDTHS):
        keys += [("weights", k), ("shifts", w), *(("filters", w, j) for j in range(w))]
    return keys


def dense_sums(memory: dict) -> np.ndarray:
    """Adagrad's sums of these, zero before the first step."""
    sizes = {"bias": 1, "weights": FILTERS, "shifts": FILTERS, "filters": SIZE * FILTERS}
    return np.concatenate([np.ravel(memory.get(key, np.zeros(sizes[key[0]]))) for key in dense_keys()]).astype(np.float64)


def move_dense(model: Model, memory: dict, change: np.ndarray, sums: np.ndarray) -> None:
    at = 0
    for key in dense_keys():
        own = model._at(key)
        step, more = (x[at : at + own.size].reshape(own.shape).astype(np.float32) for x in (change, sums))
        at += own.size
        memory[key] = memory.get(key, np.zeros(own.shape, np.float32)) + more
        if key[0] == "bias":
            model.bias += float(step[0])
        else:
            own += step


def start_words(texts: np.ndarray, share: float, seed: int) -> Model:
    """A model over the words (places in ``texts``, the learning texts of each
    class that have one) that occur in enough of them. The first coordinate of
    each starts at its smoothed log odds between the classes."""
    hashes = np.flatnonzero(texts.sum(axis=0) >= LEAST_TEXTS)
    model = Model.start(hashes, seed)
    odds = (texts[1] + SMOOTH * share) / (texts[0] + SMOOTH * (1 - share))
    model.words[1:, 0] = np.log(odds[hashes] * (1 - share) / share)
    for w in WIDTHS:
        model.filters[w][:, 0, : FILTERS // 2] = np.abs(model.filters[w][:, 0, : FILTERS // 2]) + 0.3
    model.weights[:, : FILTERS // 2] = np.abs(model.weights[:, : FILTERS // 2])
    return model


def best_threshold(logits: np.ndarray, labels: np.ndarray, rows: np.ndarray | None = None) -> float:
    """The logit that parts the classes at the least cost, in the middle of the
    gap; each pair of logit and label stands for so many ``rows``."""
    order = np.argsort(logits, kind="stable")
    n = np.ones(len(order), np.int64) if rows is None else rows[order]
    x, y = logits[order], labels[order]
    # cost when everything from place k on is called toxic
    errors = np.append(0, np.cumsum(n * (y == 1))) + FALSE_ALARM * np.append(np.cumsum((n * (y == 0))[::-1])[::-1], 0)
    # one logit is not parted
    errors[1:-1][x[1:] == x[:-1]] = np.inf
    best = np.flatnonzero(errors == errors.min())
    k = int(best[len(best) // 2])
    low, high = x[k - 1] if k else x[0] - 2, x[k] if k < len(x) else x[-1] + 2
    return float((low + high) / 2)


def packed(ids: np.ndarray) -> bytes:
    """Hashes of a text as compressed planes of their bytes."""
    return zlib.compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def encoded(docs: DataFrame) -> DataFrame:
    """(doc_id, ids, lang): the words' hashes of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 256):
            flat, starts = word_rows(batch.column(1), None)
            ends = np.append(starts[1:], len(flat)) - PAD
            ids = [packed(flat[i:j]) for i, j in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), batch.column(2)], names=["doc_id", "ids", "lang"])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(run, "doc_id long, ids binary, lang string")


def joined_ids(ids: list[bytes], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of encoded texts, as :func:`word_rows` gives them."""
    parts = [np.append(unpacked(i), np.zeros(PAD, np.int64)) for i in ids]
    flat = np.concatenate(parts)
    at = np.minimum(np.searchsorted(hashes, flat), max(0, len(hashes) - 1))
    known = np.where(hashes[at] == flat, at + 1, 0) if len(hashes) else np.zeros(len(flat), np.int64)
    return known, np.cumsum([0, *map(len, parts[:-1])])


def packed_changes(moves: np.ndarray, sums: np.ndarray) -> bytes:
    """Changes of words' rows and of their Adagrad sums at half precision, the sums
    as roots so that small ones keep theirs, as compressed planes of their bytes."""
    both = np.hstack([moves, np.sqrt(np.maximum(sums, 0))])
    halves = np.clip(both, -HALF_MOST, HALF_MOST).astype("<f2")
    return zlib.compress(halves.view(np.uint8).reshape(-1, 2).T.tobytes(), 1)


def unpacked_changes(data: bytes, rows: int) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(2, -1)
    both = np.ascontiguousarray(planes.T).view("<f2").astype(np.float64).reshape(rows, -1)
    both[:, SIZE:] **= 2
    return both


def in_pieces(rows: DataFrame, name: str) -> Iterator[Row]:
    """Rows that wait in the shared folder and come a partition at a time: of what
    is collected at once, the driver's JVM holds several copies."""
    with staged_table(rows, name) as staged:
        yield from staged.toLocalIterator()


def counted(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """For every hash: learning texts of class 0 and of class 1 that have the
    word, then its places in the texts of each language. Tasks pass on what
    they have as compressed chunks, summed by Spark."""
    names, width = {lang: k + 2 for k, lang in enumerate(languages)}, 2 + len(languages)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((width, SLOTS), np.int32)
        for batch in batches:
            for ids, label, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, n = np.unique(unpacked(ids), return_counts=True)
                own[label, words] += 1
                if lang in names:
                    own[names[lang], words] += n
        own[:, 0] = 0
        for k in range(SLOTS // CHUNK):
            part = own[:, k * CHUNK : (k + 1) * CHUNK]
            if part.any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "counts": pa.array([zlib.compress(part.astype(np.int64).tobytes(), 1)])})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(packed), np.int64)
        for k, total in sums.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)])})

    schema, out = "chunk int, counts binary", np.zeros((width, SLOTS), np.int64)
    found = rows.select("ids", "label", "lang").mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema)
    for row in in_pieces(found, "toxicity-counts"):
        out[:, row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(zlib.decompress(row.counts), np.int64).reshape(width, CHUNK)
    return out


def language_odds(counts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For every embedding row, the log of each language's share of the word over
    the mean of these; 0 where no text of a known language has it. A chunk at a
    time, so that no further table of this size is made."""
    odds = np.zeros((len(hashes) + 1, len(counts)), np.float32)
    totals = counts[:, hashes].sum(axis=1) + 0.1 * (len(hashes) + 1)
    for at in range(0, len(hashes) if len(counts) else 0, CHUNK):
        own = counts[:, hashes[at : at + CHUNK]].T
        share = (own + 0.1) / totals
        known = own.sum(axis=1, keepdims=True) > 0
        odds[at + 1 : at + 1 + len(own)] = np.where(known, np.log(share / share.mean(axis=1, keepdims=True)), 0)
    return odds


def epoch(rows: DataFrame, model: Model, memory: dict, weights: tuple[float, float], number: int) -> None:
    """One pass over all learning rows as they are stored, part by part (a part
    that was read in two pieces counts as two). Each part learns from its rows, a
    stretch of them in an order of this epoch's, from the same model; what the parts changed is
    averaged, a word's row over the parts that changed it, and so are Adagrad's
    sums. Words' changes travel at half precision. Only changed rows move; the model sent about has a fixed size."""
    held = rows.sparkSession.sparkContext.broadcast((model, memory))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, past = held.value

        def step(own: Model, some: list[tuple[bytes, int]], sums: dict) -> None:
            ids, starts = joined_ids([t for t, _ in some], own.hashes)
            y = np.array([k for _, k in some], np.float32)
            own.train_batch(ids, starts, y, np.where(y == 1, weights[1], weights[0]), sums)

        def learned(part: int, texts: Iterator[tuple[bytes, int]]) -> Iterator[pa.RecordBatch]:
            own, sums = copy.deepcopy(start), copy.deepcopy(past)
            draw = np.random.default_rng([number, part])
            while stretch := list(islice(texts, STRETCH * BATCH)):
                order = [stretch[i] for i in draw.permutation(len(stretch))]
                for some in (order[at : at + BATCH] for at in range(0, len(order), BATCH)):
                    step(own, some, sums)
            before = past.get("words", np.zeros_like(start.words))
            changed = np.flatnonzero((sums["words"] != before).any(axis=1))
            dense = np.concatenate([own.dense() - start.dense(), dense_sums(sums) - dense_sums(past)])
            found = [(-1, np.zeros(1, np.int64), dense.astype("<f4").tobytes())]
            for k in np.unique(changed // CHUNK).tolist():
                at = changed[changed // CHUNK == k]
                found.append((k, at % CHUNK, packed_changes(own.words[at] - start.words[at], sums["words"][at] - before[at])))
            for k, at, change in found:
                columns = {"chunk": pa.array([k], pa.int32()), "part": pa.array([part], pa.int32())}
                columns |= {"at": pa.array([at.astype("<u2").tobytes()]), "change": pa.array([change])}
                yield pa.RecordBatch.from_pydict(columns)

        each = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for part, some in groupby(each, key=lambda row: row[0]):
            yield from learned(part, ((ids, label) for _, ids, label in some))

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for k, some in groupby(each, key=lambda row: row[0]):
            sums, n = 0, np.zeros(CHUNK, np.int64)
            for _, _, at, change in some:
                places = np.frombuffer(at, "<u2")
                own = unpacked_changes(change, len(places)) if k >= 0 else np.frombuffer(change, "<f4")[None]
                sums = np.zeros((CHUNK if k >= 0 else 1, own.shape[1])) if n.sum() == 0 else sums
                sums[places] += own
                n[places] += 1
            at = np.flatnonzero(n)
            mean = (sums[at] / n[at, None]).astype("<f4")
            columns = {"chunk": pa.array([k], pa.int32()), "at": pa.array([(at + max(k, 0) * CHUNK).astype("<i8").tobytes()])}
            yield pa.RecordBatch.from_pydict(columns | {"change": pa.array([mean.tobytes()])})

    changes = rows.select("part", "ids", "label").mapInArrow(learn, "chunk int, part int, at binary, change binary")
    means = changes.repartition("chunk").sortWithinPartitions("chunk", "part").mapInArrow(average, "chunk int, at binary, change binary")
    for row in in_pieces(means, "toxicity-changes"):
        at, change = np.frombuffer(row.at, "<i8"), np.frombuffer(row.change, "<f4").reshape(len(row.at) // 8, -1)
        if row.chunk < 0:
            half = change.shape[1] // 2
            move_dense(model, memory, change[0, :half], change[0, half:])
        else:
            model.words[at] += change[:, :SIZE]
            memory.setdefault("words", np.zeros_like(model.words))[at] += change[:, SIZE:]
    # unpersisted only, every epoch's copy would stay with the driver
    held.destroy()


def calibrate(rows: DataFrame, model: Model) -> None:
    """Thresholds from all rows set aside: their logits are counted in bins of
    1 / ``BINS`` by told language and label."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 256):
            ids, starts = joined_ids(batch.column(0).to_pylist(), held.value.hashes)
            bins = np.floor(np.clip(held.value.logits(ids, starts), -LIMIT, LIMIT) * BINS).astype(np.int64)
            told = held.value.language(ids, starts).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(told), pa.array(bins), batch.column(1)], names=["told", "bin", "label"])

    counts = rows.select("ids", "label").mapInArrow(run, "told long, bin long, label int").groupBy("told", "bin", "label").count().collect()
    held.destroy()
    counts.sort(key=lambda r: (r.told, r.bin, r.label))
    told, bins, y, n = (np.array([r[k] for r in counts], np.int64) for k in range(4))
    logits = (bins + 0.5) / BINS
    model.thresholds = np.full(len(model.languages) + 1, best_threshold(logits, y, n))
    for k in range(len(model.languages)):
        own = told == k
        if min(n[own & (y == 1)].sum(), n[own & (y == 0)].sum()) >= LANGUAGE_ROWS:
            model.thresholds[k] = best_threshold(logits[own], y[own], n[own])


def fit(rows: DataFrame, seed: int = 7) -> Model | None:
    """Train and calibrate on all rows (doc_id, ids, lang, label): those not
    ``aside`` teach, in their ``part``, the others then calibrate, and a last epoch
    goes through both. None unless both classes occur."""
    total = {(r.aside, r.label): r["count"] for r in rows.groupBy("aside", "label").count().collect()}
    if {label for _, label in total} != {0, 1}:
        return None
    both = lambda aside: all((aside, label) in total for label in (0, 1))
    learn = rows.where(~F.col("aside")) if both(False) else rows
    held = rows.where("aside") if both(True) else rows
    n = [total[False, k] if both(False) else total.get((False, k), 0) + total.get((True, k), 0) for k in (0, 1)]
    langs = rows.where("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r.lang for r in langs)
    counts = counted(learn, languages)
    model, memory = start_words(counts[:2], n[1] / sum(n), seed), {}
    model.languages = languages
    model.language_table = language_odds(counts[2:], model.hashes)
    del counts
    for number in range(EPOCHS):
        epoch(learn, model, memory, (0.5 * sum(n) / n[0], 0.5 * sum(n) / n[1]), number)
    calibrate(held, model)
    if both(True):
        epoch(rows, model, memory, (0.5 * sum(n) / n[0], 0.5 * sum(n) / n[1]), EPOCHS)
    return model


def train(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None = (5, 0)) -> Model | None:
    """A model from all labelled rows that are not held out. Texts are read once,
    as words' hashes, which wait in the shared folder; none reaches the driver."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    if held_out:
        marks = marks.where(remainder("doc_id", held_out[0]) != held_out[1])
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("label"))
    known = docs.where(remainder("doc_id", held_out[0]) != held_out[1]) if held_out else docs
    with staged_table(marks, "toxicity-labels") as marks:
        parts = max(1, -(-marks.count() // PART_ROWS))
        draw = F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(1_000)) < int(1_000 * CALIBRATION)
        part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(parts)).cast("int")
        # one plan at every size; no labels go through the driver
        dealt = encoded(known).join(marks.hint("merge"), "doc_id").withColumn("part", part).repartition(4 * parts, "part")
        # one row of a repeated id
        rows = dealt.groupBy("part", "doc_id", "label").agg(F.min(F.struct("ids", "lang")).alias("row"))
        rows = rows.select("doc_id", "label", "row.ids", "row.lang", draw.alias("aside"), "part", F.xxhash64("doc_id").alias("place"))
        with staged_table(rows.sortWithinPartitions("part", "place", "doc_id"), "toxicity") as staged:
            return fit(staged)


def score(docs: DataFrame, model: Model | None, keep: bool = False) -> DataFrame:
    """(doc_id, score, predicted) of every row; with ``keep`` all columns of docs besides."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs if keep else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("text", F.col("text").cast("string"))
    at = rows.columns.index("text")
    names = rows.columns if keep else ["doc_id"]
    fields, places = [rows.schema[n] for n in names], [rows.columns.index(n) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1024):
            texts = pc.fill_null(batch.column(at), "")
            found = held.value.scores(texts) if held.value else np.zeros(batch.num_rows)
            own = [batch.column(k) for k in places]
            extra = [pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*own, *extra], names=[*names, "score", "predicted"])

    schema = rows.schema.__class__(fields).add("score", "double").add("predicted", "integer")
    return rows.mapInArrow(run, schema)
