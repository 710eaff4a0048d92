"""Operators 3, 4 and 9: brute-force counts, held-out accuracy, edge cases."""

import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardlog.llm import crossparse, outliers, toxicity

FOLDER = "/root/testdata/sf0.01"


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    repeats = sum(lines[i] in lines[:i] for i in range(len(lines)))
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), repeats, len(inside)


@given(st.text(st.sampled_from("abé中#|<  \t\n\x0b\x1c\xa0"), max_size=80))
@settings(max_examples=300, deadline=None)
def test_statistics(text):
    assert outliers.text_statistics(text.encode()) == plain_statistics(text)


@given(st.lists(st.sampled_from(["a", "b"]), max_size=60))
@settings(max_examples=200, deadline=None)
def test_repeated_windows(words):
    assert outliers.text_statistics(" ".join(words).encode())[-1] == plain_statistics(" ".join(words))[-1]


def test_quality_of_edge_cases(docs, no_docs):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    texts = {(r.doc_id, r.text or "") for r in docs.collect()}
    by_id = dict(texts)
    rows = outliers.judge(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        words, chars, symbols, _, dup, repeat = plain_statistics(by_id[r.doc_id])
        assert tuple(r[n] for n in names) == (words, chars, symbols, dup, repeat)
        assert r.base_failed == (words < 20 or 100 * repeat > 30 * words)
        assert not (r.base_failed and r.kept)
    assert outliers.judge(no_docs).count() == 0


def test_planted_outliers_are_rejected_and_clean_texts_kept(spark):
    draw = np.random.default_rng(3)
    clean = [(i, " ".join(draw.choice(["some", "plain", "words", "of", "it"], 60)), "en", f"s{i % 2}", 0) for i in range(700)]
    clean = [(i, " ".join(f"{w}{draw.integers(9)}" for w in t.split()), *rest) for i, t, *rest in clean]
    junk = [(1000 + i, " ".join(f"{w}###$$$" for w in t.split()), "en", f"s{i % 2}", 0) for i, (_, t, *_) in enumerate(clean[:40])]
    frame = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string, n_chars long")
    verdict = {r.doc_id: r.kept for r in outliers.judge(frame).collect()}
    assert not any(verdict[1000 + i] for i in range(40))
    assert sum(verdict[i] for i in range(700)) >= 695
    again = {r.doc_id: r.kept for r in outliers.judge(frame.repartition(7)).collect()}
    assert verdict == again


def longest_match_phrases(text, sample):
    at = phrases = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        phrases, at = phrases + 1, at + n
    return phrases


@given(st.text(st.sampled_from("abcdx "), min_size=1, max_size=60), st.text(st.sampled_from("abcd "), min_size=5, max_size=80))
@settings(max_examples=150, deadline=None)
def test_phrases_are_longest_matches(text, sample):
    sample += "abcd"
    parser = crossparse.CrossParser({"l": sample})
    symbols = lambda t: parser.symbols(crossparse.code_points(t))
    plain = lambda s: "".join(chr(97 + int(x)) for x in s)
    found = parser.phrases([symbols(text)])[0, 0]
    assert found == longest_match_phrases(plain(symbols(text)), plain(symbols(sample)))


def plain_phrases(text, sample):
    """Greedy longest matches by str.find over folded letters, without automata or blocks."""
    def fold(t):
        return re.sub(r"[\W\d_]+", " ", t.lower())

    text, sample = fold(text), fold(sample)
    count, at = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        at, count = max(at + 1, end - 1), count + 1
    return count


def test_long_texts_of_six_scripts():
    """Over 2,000 symbols, over block ends, in alphabets beyond the table of 64 symbols."""
    draw = np.random.default_rng(4)
    spans = {"latin": (0x61, 26), "greek": (0x3B1, 17), "cyrillic": (0x430, 32), "han": (0x4E00, 900), "kana": (0x3042, 70), "hangul": (0xAC00, 700)}
    words = {k: ["".join(chr(a + int(c)) for c in draw.integers(0, n, draw.integers(1, 6))) for _ in range(300)] for k, (a, n) in spans.items()}
    # a second language of the same Han letters
    words["han2"] = ["".join(draw.permutation(list(w))) + chr(0x4E00 + int(draw.integers(900))) for w in words["han"]]
    text = lambda k, n: " ".join(draw.choice(words[k], n))
    samples = {k: text(k, 1_500) for k in words}
    parser = crossparse.CrossParser(samples)
    texts = [text(k, 800) for k in words] + [samples["latin"][100:3_100], text("han", 400) + " " + text("latin", 900) + " \U0001f600 ŵŷ " + text("kana", 300)]
    found = parser.phrases([parser.symbols(crossparse.code_points(t)) for t in texts])
    assert found.tolist() == [[plain_phrases(t, samples[k]) for k in parser.languages] for t in texts]
    assert found[len(words)][parser.languages.index("latin")] == 1  # an excerpt is one phrase
    short = [(k, text(k, 8)) for k in words for _ in range(20)]
    assert [lang for lang, _ in parser.predict([t for _, t in short])] == [k for k, _ in short]


def test_repeated_ids_teach_once(spark):
    rows = [(1, f"text number {k} of one id", "en") for k in range(50)] + [(2, "ein anderer Text", "de")]
    samples = crossparse.training_samples(spark.createDataFrame(rows, "doc_id long, text string, lang string"), None)
    assert samples == {"en": "text number 0 of one id", "de": "ein anderer Text"}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = crossparse.identify(docs, crossparse.training_samples(docs)).withColumn(
        "held_out", crossparse.remainder("doc_id", 4) == 2
    )
    rows = found.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_edge_cases(docs, no_docs):
    samples = crossparse.training_samples(docs, held_out=None)
    rows = crossparse.identify(docs, samples).collect()
    texts = dict((r.doc_id, r.text) for r in docs.collect())
    assert len(rows) == docs.count()
    for r in rows:
        none = not any(c.isalpha() for c in texts[r.doc_id] or "")
        assert (r.lang_pred == "und") == none and 0 <= r.score <= 1
    assert crossparse.identify(no_docs, samples).count() == 0
    assert {r.lang_pred for r in crossparse.identify(docs, crossparse.training_samples(no_docs)).collect()} == {"und"}


def test_held_out_rows_teach_nothing(docs):
    some = docs.where(crossparse.remainder("doc_id", 4) == 2)
    assert crossparse.training_samples(some) == {}


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return toxicity.train(docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))


def test_toxicity_held_out(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(toxicity.remainder("doc_id", 5) == 0)
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.score(docs, model).join(labels, "doc_id").collect()
    truth = np.array([r.toxic for r in rows])
    told = np.array([r.predicted for r in rows])
    assert (truth == told).mean() > 0.96
    assert told[truth == 1].mean() > 0.8 and told[truth == 0].mean() < 0.02


def test_toxicity_of_edge_cases(docs, no_docs, model):
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert toxicity.score(no_docs, model).count() == 0
    one_class = docs.select("doc_id").distinct().withColumn("toxic", F.lit(0))
    assert toxicity.train(docs, one_class) is None
    assert {(r.score, r.predicted) for r in toxicity.score(docs, None).collect()} == {(0.0, 0)}


def test_score_depends_on_the_text_alone(model):
    texts = ["an idiot wrote this", "", "plain words", "x" * 70_000]
    alone = [float(model.scores(pa.array([t]))[0]) for t in texts]
    assert np.allclose(model.scores(pa.array(texts)), alone)


def test_threshold_parts_the_classes():
    assert 2 < toxicity.best_threshold(np.array([0.0, 1, 2, 3, 4]), np.array([0, 0, 0, 1, 1])) < 3


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PART_ROWS", 2_000)
    word = F.concat(F.lit("word"), (F.col("id") % 800).cast("string"))
    rows = spark.range(7_000).withColumn("toxic", (F.col("id") % 10 == 0).cast("int"))
    docs = rows.select(F.col("id").alias("doc_id"), F.concat_ws(" ", word, F.when(F.col("toxic") == 1, "vile"), F.lit("end")).alias("text"), F.lit("en").alias("lang"))
    model = toxicity.train(docs, rows.select(F.col("id").alias("doc_id"), "toxic"))
    ids, _ = toxicity.word_rows(pa.array([f"word{k}" for k in range(800)]), model.hashes)
    assert (ids[:: 1 + toxicity.PAD] > 0).mean() > 0.97
    assert (model.scores(pa.array(["word1 vile end", "word1 end"])) >= 0.5).tolist() == [True, False]


def test_training_leaves_the_driver_small(spark, monkeypatch):
    """No epoch's model stays with the driver, and no changes of words are collected at once."""
    sent, collected = [], []
    broadcast, collect = type(spark.sparkContext).broadcast, type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(broadcast(self, value)) or sent[-1])
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: collected.append(collect(self)) or collected[-1])
    rows = spark.range(400).withColumn("toxic", (F.col("id") % 10 == 0).cast("int"))
    words = F.concat_ws(" ", F.concat(F.lit("word"), (F.col("id") % 40).cast("string")), F.when(F.col("toxic") == 1, "vile"))
    docs = rows.select(F.col("id").alias("doc_id"), words.alias("text"), F.lit("en").alias("lang"))
    model = toxicity.train(docs, rows.select(F.col("id").alias("doc_id"), "toxic"))
    assert len(model.hashes) >= 40 and len(sent) == toxicity.EPOCHS + 2
    assert not any(os.path.exists(held._path) for held in sent)
    assert not any(isinstance(v, (bytes, bytearray)) for found in collected for row in found for v in row)


def test_changes_travel_small_and_close():
    draw = np.random.default_rng(5)
    moves = (0.05 * draw.normal(size=(4_096, toxicity.SIZE))).astype(np.float32)
    sums = (10.0 ** draw.uniform(-7, 3, moves.shape)).astype(np.float32)
    data = toxicity.packed_changes(moves, sums)
    found = toxicity.unpacked_changes(data, len(moves))
    assert len(data) < 0.5 * (moves.nbytes + sums.nbytes)
    assert np.allclose(found[:, : toxicity.SIZE], moves, rtol=1e-3, atol=1e-7)
    assert np.allclose(found[:, toxicity.SIZE :], sums, rtol=3e-3)
    huge = toxicity.unpacked_changes(toxicity.packed_changes(moves[:1] + 1e9, sums[:1] + 1e30), 1)
    assert np.isfinite(huge).all()


def test_language_odds():
    draw = np.random.default_rng(3)
    counts = draw.integers(0, 4, (3, toxicity.SLOTS)) * (draw.random(toxicity.SLOTS) < 0.5)
    hashes = np.flatnonzero(draw.random(toxicity.SLOTS) < 0.05)
    table = np.vstack([np.zeros((1, 3)), counts[:, hashes].T])
    share = (table + 0.1) / (table + 0.1).sum(axis=0)
    plain = np.where(table.sum(axis=1, keepdims=True) > 0, np.log(share / share.mean(axis=1, keepdims=True)), 0)
    assert np.allclose(toxicity.language_odds(counts, hashes), plain, atol=1e-5)
    assert toxicity.language_odds(counts[:0], hashes).shape == (len(hashes) + 1, 0)
    assert toxicity.language_odds(counts, hashes[:0]).tolist() == [[0, 0, 0]]
