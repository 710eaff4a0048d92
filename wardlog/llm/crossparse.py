"""Operator 4: language by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled
text. A document is parsed into phrases, each the longest match in the sample,
by walking the automaton and starting again where no transition is left. Phrases
times log2 of the sample's length over the symbols read estimates the
cross-entropy; the language that needs the fewest normalised phrases wins.

The walk is vectorised: a text is read whole, in blocks of ``BLOCK`` symbols, and
all blocks of a batch step through the automaton together. A block is first
read as if a phrase began with it; where the block before ends inside a phrase
it is read again from there, until no entry changes, so phrases cross block ends
and are the longest matches. The commonest letters step through a table, all
others of the samples through a sorted list of transitions; a letter of no
sample matches nothing.

The sample is ``SAMPLE_CHARS`` characters per language at most, from
``SAMPLE_DOCS`` labelled documents, those with the smallest hash of their id in
each of as many classes, and at most ``DOC_CHARS`` of each. Only this fits the classifier; every text is
predicted whole, from nothing but itself.

Defined cases: ``und`` with score 0 if the text is null or has no letter, or if
no language could be learned; ties go to the first language by name; a language
counts as learned once one of its labelled texts has a letter; a very long text
is parsed whole; of the rows of a repeated id one is learned from; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlog.llm.common import per_worker, remainder, small_batches

SAMPLE_CHARS = 40_000
SAMPLE_DOCS = 64
DOC_CHARS = 3_000
BLOCK = 512
#: Symbols of the table: 0 for anything but a letter, then the commonest letters,
#: then one for letters of no sample; the last marks the end of a text. Symbols
#: from ``SYMBOLS`` on are the samples' other letters.
SYMBOLS = 64
OTHER, END = SYMBOLS - 2, SYMBOLS - 1
UNKNOWN = "und"
#: Characters walked together.
BATCH_CHARS = 2_000_000


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the automaton of all substrings."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = state
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
    return moves


class CrossParser:
    """Automata of several languages over one alphabet."""

    def __init__(self, samples: dict[str, str]):
        points = {lang: code_points(text) for lang, text in sorted(samples.items())}
        points = {lang: p for lang, p in points.items() if letters()[p].any()}
        self.languages = list(points)
        seen = Counter()
        for p in points.values():
            values, counts = np.unique(p[letters()[p]], return_counts=True)
            seen.update(dict(zip(values.tolist(), counts.tolist(), strict=True)))
        self.symbol = np.where(letters(), OTHER, 0).astype(np.int32)
        for number, (point, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0])), 1):
            self.symbol[point] = number if number < OTHER else SYMBOLS + number - OTHER
        #: Letters beyond the table, and their transitions: keys (state x rare + letter), ascending.
        self.rare = max(1, len(seen) - OTHER + 1)
        tables, keys, targets, self.starts, self.bits = [], [], [], [], []
        base = 0
        for p in points.values():
            symbols = self.symbols(p)
            walk, rare = self._walk_table(suffix_automaton(symbols.tolist()), base)
            tables.append(walk)
            keys += [k for k, _ in rare]
            targets += [to for _, to in rare]
            self.starts.append((base + len(walk) - 1) * SYMBOLS)
            self.bits.append(np.log2(max(2, len(symbols))))
            base += len(walk)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.targets = np.array(keys, np.int64)[order], np.array(targets, np.int32)[order]

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """Symbols of a text, runs of non-letters folded into one."""
        s = self.symbol[points]
        return s[(s != 0) | (np.append(1, s[:-1]) != 0)] if len(s) else s

    def _walk_table(self, moves: list[dict[int, int]], base: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Next state times SYMBOLS, plus 1 where a new phrase starts; the last row
        is the state between phrases. Besides, transitions by rare letters."""
        between = base + len(moves)
        again = np.full(SYMBOLS, between * SYMBOLS + 1)
        for c, to in moves[0].items():
            if c < SYMBOLS:
                again[c] = (to + base) * SYMBOLS + 1
        walk = np.tile(again, (len(moves) + 1, 1))
        rare = []
        for state, out in enumerate(moves):
            for c, to in out.items():
                if c < SYMBOLS:
                    walk[state, c] = (to + base) * SYMBOLS
                else:
                    rare.append(((state + base) * self.rare + c - SYMBOLS, (to + base) * SYMBOLS))
        rare += [(between * self.rare + c - SYMBOLS, (to + base) * SYMBOLS + 1) for c, to in moves[0].items() if c >= SYMBOLS]
        walk[:, END] = between * SYMBOLS
        return walk.astype(np.int32), rare

    def _rare_steps(self, states: np.ndarray, letters: np.ndarray, start: int) -> np.ndarray:
        """Steps by rare letters: on from the state, else anew from between phrases."""
        out = np.full(len(states), start + 1, np.int32)
        for where in (np.full(len(states), start // SYMBOLS), states // SYMBOLS):
            key = where.astype(np.int64) * self.rare + letters
            at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
            out[hit] = self.targets[at[hit]]
        return out

    def _walk(self, columns: np.ndarray, rare: list[np.ndarray], entry: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrases begun in each block, state at its end) of blocks entered in these states."""
        state, count = entry.copy(), np.zeros(len(entry), np.int32)
        for column, places in zip(columns, rare, strict=True):
            state &= -SYMBOLS
            if len(places):
                to = self._rare_steps(state[places], column[places] - SYMBOLS, start)
                state += np.where(column >= SYMBOLS, OTHER, column)
                state = self.table[state]
                state[places] = to
            else:
                state += column
                state = self.table[state]
            count += state & 1
        return count, state & -SYMBOLS

    def phrases(self, rows: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (symbols) for each language."""
        blocks = [max(1, -(-len(r) // BLOCK)) for r in rows]
        grid = np.full((sum(blocks), BLOCK), END, np.int32)
        at = 0
        for r, n in zip(rows, blocks, strict=True):
            grid[at : at + n].reshape(-1)[: len(r)] = r
            at += n
        first = np.cumsum([0, *blocks[:-1]])
        follows = np.ones(len(grid), bool)
        follows[first] = False
        counts = np.zeros((len(self.languages), len(grid)), np.int32)
        any_rare = bool((grid >= SYMBOLS).any())
        for k, start in enumerate(self.starts):
            entry, leave = np.full(len(grid), start, np.int32), np.zeros(len(grid), np.int32)
            again = np.arange(len(grid))
            while len(again):
                columns = np.ascontiguousarray(grid[again].T)
                rare = [np.flatnonzero(c >= SYMBOLS) for c in columns] if any_rare else [again[:0]] * len(columns)
                counts[k, again], leave[again] = self._walk(columns, rare, entry[again], start)
                wanted = np.where(follows, np.append(start, leave[:-1]), start).astype(np.int32)
                again = np.flatnonzero(wanted != entry)
                entry = wanted
        return np.add.reduceat(counts, first, axis=1).T

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """(language, score) of each text; the score is the share by which the
        best entropy lies below the second best."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars < BATCH_CHARS):
                chars += len(texts[end] or "")
                end += 1
            points = [code_points(t or "") for t in texts[at:end]]
            known = [bool(self.languages) and letters()[p].any() for p in points]
            rows = [self.symbols(p) for p, ok in zip(points, known, strict=True) if ok]
            if rows:
                sizes = np.array([len(r) for r in rows], float)
                costs = self.phrases(rows) * np.array(self.bits) / sizes[:, None]
                best = costs.argmin(axis=1)
                ranked = np.sort(costs, axis=1)
                second = ranked[:, 1] if costs.shape[1] > 1 else 2 * ranked[:, 0]
                scores = 1 - ranked[:, 0] / np.maximum(second, 1e-12)
            each = iter(zip(best.tolist(), scores.tolist(), strict=True)) if rows else iter(())
            for ok in known:
                if ok:
                    k, score = next(each)
                    yield self.languages[k], min(1.0, max(0.0, score))
                else:
                    yield UNKNOWN, 0.0
            at = end


def training_samples(docs: DataFrame, held_out: tuple[int, int] | None = (4, 2)) -> dict[str, str]:
    """A bounded sample of labelled text per language. Rows whose crc32(doc_id)
    modulo held_out[0] is held_out[1] are never read. Ids are chosen from narrow
    rows first, by a grouped minimum that every task reduces for itself."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if held_out:
        rows = rows.where(remainder("doc_id", held_out[0]) != held_out[1])
    h = F.xxhash64("doc_id").alias("h")
    chosen = rows.groupBy("lang", F.pmod(h, F.lit(SAMPLE_DOCS))).agg(F.min(F.struct(h, "doc_id")).alias("least"))
    ids = [r.doc_id for r in chosen.select("least.doc_id").distinct().collect()]
    parts: dict[str, list[str]] = {}
    some = rows.where(F.col("doc_id").isin(ids)) if ids else rows.limit(0)
    cut = some.select("lang", "doc_id", F.substring("text", 1, DOC_CHARS).alias("text"))
    cut = cut.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))  # an id may repeat
    for row in sorted(cut.collect(), key=lambda r: (r.lang, r.doc_id, r.text)):
        parts.setdefault(row.lang, []).append(row.text)
    return {lang: "\n".join(texts)[:SAMPLE_CHARS] for lang, texts in parts.items()}


def _parser(samples: dict[str, str]) -> CrossParser:
    return per_worker(("languages", hash(tuple(sorted(samples.items())))), lambda: CrossParser(samples))


def identify(docs: DataFrame, samples: dict[str, str], keep: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; with ``keep`` all columns of docs besides."""
    held = docs.sparkSession.sparkContext.broadcast(samples)
    rows = docs if keep else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("text", F.col("text").cast("string"))
    at = rows.columns.index("text")
    names = rows.columns if keep else ["doc_id"]
    fields, places = [rows.schema[n] for n in names], [rows.columns.index(n) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(held.value)
        for batch in small_batches(batches, 2048):
            found = list(parser.predict(batch.column(at).to_pylist()))
            extra = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            own = [batch.column(k) for k in places]
            yield pa.RecordBatch.from_arrays([*own, *extra], names=[*names, "lang_pred", "score"])

    schema = rows.schema.__class__(fields).add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema)
