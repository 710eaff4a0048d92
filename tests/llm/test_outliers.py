"""Operator 3: each statistic alone rejects, and groups are judged by their own style."""

import numpy as np
import pytest

from wardlog.llm import outliers

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(draw, n, size=5):
    return ["".join(w) for w in draw.choice(list("abcdefghijkl"), (n, size))]


def lines(words, each=6):
    return "\n".join(" ".join(words[i : i + each]) for i in range(0, len(words), each))


def repeated_lines(draw):
    """Two short lines again and again between others: three of five lines repeat, no window does."""
    return "\n".join(f"homes\nabout\n{' '.join(words(draw, 3))}" for _ in range(15))


def repeated_words(draw):
    """A passage of eight words twice in sixty: no line repeats."""
    own = words(draw, 60)
    own[40:48] = own[3:11]
    return lines(own)


def long_words(draw):
    return lines(words(draw, 60, 8))


@pytest.fixture(scope="module")
def verdicts(spark):
    draw = np.random.default_rng(11)
    texts = [lines(words(draw, draw.integers(40, 90))) for _ in range(600)]
    texts += [make(draw) for make in (repeated_lines, repeated_words, long_words) for _ in range(5)]
    rows = [(i, t, "en", f"s{i % 2}", 0) for i, t in enumerate(texts)]
    return {r.doc_id: r for r in outliers.judge(spark.createDataFrame(rows, COLUMNS).repartition(3)).collect()}


@pytest.mark.parametrize("first", [600, 605, 610])
def test_one_statistic_alone_rejects(verdicts, first):
    rows = [verdicts[i] for i in range(first, first + 5)]
    assert not any(r.base_failed or r.kept for r in rows)


def test_clean_texts_stay(verdicts):
    assert all(verdicts[i].kept for i in range(600))


def test_sources_are_judged_by_their_own_style(spark):
    """Seventy texts full of symbols, all of one source, are no outliers in it but are in their language."""
    draw = np.random.default_rng(12)
    rows = [(i, lines(words(draw, draw.integers(40, 90))), "en", "prose", 0) for i in range(300)]
    style = lambda: lines([f"{w}#" if draw.random() < 0.6 else w for w in words(draw, 60)])
    rows += [(1000 + i, style(), "en", "tables", 0) for i in range(70)]
    rows += [(2000 + i, style(), "en", "prose", 0) for i in range(3)]
    kept = {r.doc_id: r.kept for r in outliers.judge(spark.createDataFrame(rows, COLUMNS).repartition(3)).collect()}
    assert all(kept[i] for i in range(300)) and all(kept[1000 + i] for i in range(70))
    assert not any(kept[2000 + i] for i in range(3))


def test_one_repeat_of_few_does_not_reject():
    """A repeated line of three, and a window found twice in 91 words, are within the floors' reach."""
    assert 1 / 3 / outliers.FLOOR[2] ** 2 < outliers.CUT and 16 / 91 / outliers.FLOOR[3] ** 2 < outliers.CUT
