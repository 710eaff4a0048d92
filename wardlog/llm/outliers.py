"""Operator 3: quality rules and robust multivariate outliers.

Base rules count words, symbols, repeated lines and repeated 8-word windows.
Documents that pass them are judged by the minimum-covariance-determinant
estimate of their group: of a (language, source), of the language where the
group has fewer than ``MIN_ROWS`` documents, or of all documents.

Vector: log of the mean word length, and the square roots of symbols per word,
repeated lines per line and words in repeated windows per word. The estimate
covers all documents: it starts from medians and median absolute deviations and
takes ``STEPS`` concentration steps, each keeping the ``SHARE`` of a group with
the smallest Mahalanobis distance. A step is one aggregation by group and
distance bin, so no group meets in one task and the same rows are kept however
the data are dealt. Directions in which a group hardly varies get the variance
``FLOOR``. Where the median of the distances is above that of the chi-squared law
the covariance is widened by as much, the floors are not, and a document beyond
``CUT`` is rejected. Each coordinate alone can reject.

Defined cases: a null text has no word and fails the base rules; null language
or source are values of their own; where no document passes the base rules none
is kept; ties fall in one bin and are kept together; rows that repeat stay;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlog.llm.common import column_bytes, small_batches
from wardlog.session import stage_table

SYMBOLS = b"#*$%&|<>"
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Ten rows for each coordinate of a covariance.
MIN_ROWS = 40
SHARE = 0.75
STEPS = 3
#: Standard deviations below which a direction counts as constant: of the log
#: of word length, and of the square roots of the three rates. The rates of
#: repeats move in steps: a text of three lines with one repeat, or of 91 words
#: (a tenth of sf0.1 is shorter) with a window found twice, stays within ``CUT``;
#: half of the lines, or a quarter of the words, is beyond it.
FLOOR = (0.05, 0.05, 0.1, 0.07)
#: Squared distance of rejection: the upper 1e-9 of chi-squared with 4 degrees.
CUT = 47.9
CHI_MEDIAN = 3.3567
BINS = 8
D = 4
VECTOR = [f"x{k}" for k in range(D)]
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
_ODD = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64) | 1 for k in range(WINDOW)], np.uint64)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashes = np.array(list(map(hash, words)), np.int64).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed += hashes[k : k + n] * _ODD[k]
    if len(np.unique(mixed)) == n:  # equal windows have equal hashes
        return 0
    windows = list(zip(*(words[k:] for k in range(window))))
    counts = Counter(windows)
    many = np.fromiter((counts[w] > 1 for w in windows), bool, n)
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(many)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def text_statistics(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    words = text.split()
    solid = text.translate(None, SPACE)
    chars = len(solid) if solid.isascii() else len(solid.decode("utf-8", "replace"))
    lines = [line for line in text.split(b"\n") if line.strip()]
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), repeated_words(words)


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, counts, base_failed) of every row; no shuffle."""
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = np.array([text_statistics(t) for t in column_bytes(batch.column(3))], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array(rows[:, k]) for k in range(len(names)))],
                names=["doc_id", "lang", "source", *names],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", F.coalesce("text", F.lit("")).alias("text")
    )
    counted = rows.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in names))
    repeats = F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | repeats)


def vectors(stats: DataFrame) -> DataFrame:
    words = F.greatest("n_words", F.lit(1)).cast("double")
    lines = F.greatest("n_lines", F.lit(1)).cast("double")
    values = (
        F.log(F.greatest("word_chars", F.lit(1)) / words),
        F.sqrt(F.col("n_symbols") / words),
        F.sqrt(F.col("n_dup_lines") / lines),
        F.sqrt(F.col("n_repeat_words") / words),
    )
    return stats.withColumns(dict(zip(VECTOR, values, strict=True)))


def _upto(counts: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """Per group, the rows of ``counts`` (with columns n and ``value``) up to the
    bin in which the running count reaches ``share`` of the group."""
    whole = Window.partitionBy(*keys)
    running = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(running), F.lit(0))
    rows = counts.withColumns({"before": before, "all": F.sum("n").over(whole)})
    return rows.where(F.col("before") < F.ceil(F.col("all") * share))


def _medians(rows: DataFrame, columns: list[Column], width: float) -> DataFrame:
    """(group, k, median) of each column, to the bin."""
    cells = F.posexplode(F.array(*(F.floor(c / width).cast("long") for c in columns))).alias("k", "bin")
    counts = rows.select("group", cells).groupBy("group", "k", "bin").agg(F.count("*").alias("n"))
    median = (F.max("bin") + 0.5) * width
    return _upto(counts, ["group", "k"], "bin", 0.5).groupBy("group", "k").agg(median.alias("median"))


def _wide(rows: DataFrame, value: str, name: str) -> DataFrame:
    cells = [F.max(F.when(F.col("k") == k, F.col(value))).alias(f"{name}{k}") for k in range(D)]
    return rows.groupBy("group").agg(*cells)


def distance(center: str = "c", precision: str = "p") -> Column:
    """Squared Mahalanobis distance of x0.. from c0.., with the precision matrix p_ij."""
    total = F.lit(0.0)
    for i, j in PAIRS:
        product = (F.col(f"x{i}") - F.col(f"{center}{i}")) * (F.col(f"x{j}") - F.col(f"{center}{j}"))
        total = total + F.col(f"{precision}{i}{j}") * product * (1 if i == j else 2)
    return total


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(F.greatest(d2, F.lit(1e-6))) * BINS).cast("int")


def _invert(moments: DataFrame) -> DataFrame:
    """(group, c0.., p00..) from count, sums s_i, products q_ij and, if there, the
    factor ``wider`` of the covariance; a row per group."""
    schema = "group string, " + ", ".join([f"c{k} double" for k in range(D)] + [f"p{i}{j} double" for i, j in PAIRS])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                mean = np.array([row[f"s{k}"] for k in range(D)]) / row["m"]
                cov = np.zeros((D, D))
                for i, j in PAIRS:
                    cov[i, j] = cov[j, i] = row[f"q{i}{j}"] / row["m"] - mean[i] * mean[j]
                inverse = np.linalg.inv(cov * row.get("wider", 1.0) + np.diag(np.square(FLOOR)))
                out.append([row["group"], *mean, *(inverse[i, j] for i, j in PAIRS)])
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return moments.mapInPandas(run, schema)


def estimates(rows: DataFrame) -> DataFrame:
    """(group, rows, c0.., p00..): robust estimates of every group of ``rows`` (group, x0..)."""
    x = [F.col(v) for v in VECTOR]
    centers = stage_table(_wide(_medians(rows, x, 0.01), "median", "c"), "outliers")
    away = rows.join(centers, "group")
    spread = _wide(_medians(away, [F.abs(F.col(f"x{k}") - F.col(f"c{k}")) for k in range(D)], 0.005), "median", "d")
    scale = {f"p{i}{j}": F.lit(0.0) if i != j else 1 / (F.pow(F.col(f"d{i}") * 1.4826, 2.0) + FLOOR[i] ** 2) for i, j in PAIRS}
    model = stage_table(centers.join(spread, "group").withColumns(scale).drop(*(f"d{k}" for k in range(D))), "outliers")
    products = {f"q{i}{j}": x[i] * x[j] for i, j in PAIRS}
    sums = {f"s{k}": x[k] for k in range(D)} | products
    for _ in range(STEPS):
        near = rows.join(model, "group").withColumn("bin", _bin(distance()))
        cells = near.groupBy("group", "bin").agg(F.count("*").alias("n"), *(F.sum(v).alias(k) for k, v in sums.items()))
        kept = _upto(cells, ["group"], "bin", SHARE)
        moments = kept.groupBy("group").agg(F.sum("n").alias("m"), *(F.sum(k).alias(k) for k in sums))
        moments = stage_table(moments, "outliers")
        model = stage_table(_invert(moments), "outliers")
    counts = rows.join(model, "group").groupBy("group", _bin(distance()).alias("bin")).agg(F.count("*").alias("n"))
    middle = F.pow(F.lit(2.0), (F.max("bin") + 1) / BINS)
    wider = F.greatest(middle / CHI_MEDIAN, F.lit(1.0)).alias("wider")
    sizes = _upto(counts, ["group"], "bin", 0.5).groupBy("group").agg(F.max("all").alias("rows"), wider)
    sizes = stage_table(sizes, "outliers")
    return stage_table(_invert(moments.join(sizes, "group")).join(sizes.drop("wider"), "group"), "outliers")


def _group(level: int) -> Column:
    """The name of a row's group: 0 language and source, 1 language, 2 all."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in ("lang", "source")[: 2 - level]]
    return F.to_json(F.array(*parts)) if parts else F.lit("[]")


def judge(docs: DataFrame) -> DataFrame:
    """The statistics of every row with ``distance`` (squared) and ``kept``."""
    stats = stage_table(vectors(statistics(docs)), "quality")
    good = stats.where(~F.col("base_failed"))
    levels = F.explode(F.array(*(_group(k) for k in range(3)))).alias("group")
    models = estimates(good.select(levels, *VECTOR))
    fields = [*(f"c{k}" for k in range(D)), *(f"p{i}{j}" for i, j in PAIRS)]
    out = stats
    for level in range(3):
        some = models if level == 2 else models.where(F.col("rows") >= MIN_ROWS)
        own = some.select(F.col("group").alias(f"g{level}"), F.struct(*fields).alias(f"m{level}"))
        out = out.withColumn(f"g{level}", _group(level)).join(own, f"g{level}", "left")
    best = F.coalesce("m0", "m1", "m2")
    out = out.withColumns({f: best[f] for f in fields})
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kept = ~F.col("base_failed") & (F.col("distance") <= CUT)
    return out.withColumn("distance", distance()).select(
        "doc_id", *counts, "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"), "distance"
    )
