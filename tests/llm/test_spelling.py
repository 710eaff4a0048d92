"""Operator 12 against all pairs of words and a plain count."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from wardlog.llm import spelling
from wardlog.llm.catalog import op12_spelling_variants

FOLDER = "/root/testdata/sf0.001"


def plain_counts(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def deletions(word):
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return abs(len(a) - len(b)) == 1 and min(a, b, key=len) in deletions(max(a, b, key=len))


def plain_variants(counts):
    near = {w: [] for w in counts}
    words = sorted(counts, key=len)
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if len(b) > len(a) + 1:
                break
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return out


def found(frame):
    rows = frame.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert found(op12_spelling_variants(spark, FOLDER)) == plain_variants(plain_counts(rows))


@pytest.mark.parametrize(("block", "tile"), [(spelling.BLOCK, spelling.TILE), (16, 2048), (10_000, 32), (10_000, 5)])
def test_blocks_and_tiles_lose_no_pair(spark, block, tile):
    draw = random.Random(12)
    words = {"".join(draw.choices("abç", k=draw.randint(6, 9))) for _ in range(700)} | {"z" * 3_000, "z" * 2_999 + "y", "z" * 3_001}
    words |= {"".join(draw.choices("abcdé漢字\U0001f600", k=6)) for _ in range(200)}
    counts = {w: draw.randint(5, 900) for w in sorted(words)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = sorted((r.word, r.near, r.near_n) for r in spelling.near_words(frame, block, tile).collect())
    assert got == sorted((a, b, counts[b]) for a in words for b in words if a != b and one_edit(a, b))


def test_chains_lead_to_the_last_form(spark):
    """Each form is five times as frequent as its word, over seven steps."""
    words = ["abcdef"[:6]]
    for k in range(7):
        words.append(words[-1] + "ghijklm"[k])
    counts = {w: 5 * 5**k for k, w in enumerate(words)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = found(spelling.variants(frame))
    assert got == plain_variants(counts) and got["abcdef"][1] == words[-1]


def test_edge_cases(spark, docs, no_docs):
    wanted = plain_counts([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert {r.word: r.n for r in spelling.word_counts(docs).collect()} == wanted
    odd = [(None, "Straße STRASSE Straße straße×÷ Ähnlich ähnlich " * 5), (None, None), (3, ""), (3, "naïvely naïvely " * 9)] * 3
    frame = spark.createDataFrame(odd, "doc_id long, text string")
    assert found(spelling.variants(spelling.word_counts(frame))) == plain_variants(plain_counts(odd))
    assert spelling.variants(spelling.word_counts(no_docs)).count() == 0
