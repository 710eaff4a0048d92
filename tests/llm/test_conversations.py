"""Operator 11 against a plain recursion over every audit, and on edge cases."""

import random
import re
import sys
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import pytest

from wardlog.llm import conversations
from wardlog.llm.catalog import op11_conversation_repair

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "conv_id long, turn long, role string, text string"


def plain_audit(rows):
    """(cost, audit, lines) of rows (role, text, fault), trying every letter everywhere."""
    sys.setrecursionlimit(100_000)
    after = {"": "user", "s": "user", "u": "assistant", "a": "user"}

    @lru_cache(None)
    def best(at, last, inserts):
        found = [(0, "")] if at == len(rows) and last in ("", "a") else []

        def more(letter, cost, to, role, used):
            rest = best(to, role, inserts - used)
            if rest is not None:
                found.append((cost + rest[0], letter + rest[1]))

        if inserts:
            more("I", 5, at, after[last][0], 1)
        if at < len(rows):
            role, _, fault = rows[at]
            more("D", 2, at + 1, last, 0)
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                more("R", 1 + extra, at + 1, after[last][0], 0)
                if re.fullmatch("s?(ua)*u?", {"": "", "s": "s", "u": "u", "a": "ua"}[last] + role[:1]) and role:
                    more("K", extra, at + 1, role[0], 0)
        return min(found, default=None)

    cost, audit = best(0, "", 2 * len(rows) // 5)
    lines, left, last = [], list(rows), ""
    for letter in audit:
        role, text = (after[last], "") if letter == "I" else left.pop(0)[:2]
        if letter == "D":
            continue
        role = after[last] if letter == "R" else role
        lines.append((role, text))
        last = role[0]
    return cost, audit, lines


def plain_report(rows):
    """The whole report of one conversation's rows (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        if not marks:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if marks[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, lines = plain_audit([(r, t, f) for (_, r, t), f in zip(rows, faults)])
    digest = sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        for _ in range(0 if kind == 0 else 2 if kind == 3 else 1):
            kept.append((turn, "user" if kind == 4 else role, text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], sha256(r[2].encode()).digest())
    return {c: sorted(r, key=order) for c, r in out.items()}


def reported(rows):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r.conv_id: tuple(r[n] for n in names) for r in rows.collect()}


def test_bidirectional_search_equals_recursion():
    draw = random.Random(11)
    for _ in range(400):
        rows = []
        for _ in range(draw.randint(0, 9)):
            fault = draw.choice(["", "", "", "truncated", "blank", "duplicate"])
            rows.append((draw.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), "t", fault))
        kinds = {"": 0, "truncated": 1, "blank": 2, "duplicate": 3}
        drawn = "".join(conversations.shape(kinds[f], r) for r, _, f in rows)
        cost, audit, lines = plain_audit(rows)
        assert conversations.cheapest(drawn) == (cost, audit)
        done = conversations.apply_audit([r[:2] for r in rows], audit)
        assert [(x["role"], x["text"]) for x in done] == lines


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    wanted = {c: plain_report(r) for c, r in plain_damage(rows).items()}
    got = op11_conversation_repair(spark, FOLDER)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert reported(got) == wanted and got.count() == len(wanted)


def edge_rows():
    long = [(9, t, draw, f"text {t % 40} {'x' * (t % 3)}{'.' if t % 5 else ''}") for t, draw in enumerate(random.Random(3).choices(["user", "assistant", "system"], k=400))]
    return [
        (1, 0, "system", "Only this."),
        (2, None, "user", "First, without a turn."),
        (2, 3, "assistant", "Then this."),
        (2, 9, "assistant", None),
        (3, 1, None, "Nobody."),
        (3, 2, "tool", "A tool."),
        (None, 1, "user", "No conversation id."),
        (None, 2, "assistant", "Nor here."),
        (4, 5, "user", "Same."),
        (4, 5, "user", "Same."),
        (4, 5, "user", "Same."),
        (4, 6, "", "x" * 200_000 + "!"),
        (5, None, None, None),
        (7, 0, "user", " \t\n"),
        (8, 0, "user", "\u2003."),
        (8, 1, "assistant", "Ends in an em space\u2003"),
        *long,
    ]


@pytest.mark.parametrize("size", [1, 7, conversations.PIECE])
def test_edge_cases_and_pieces(spark, size):
    """Nulls, ties, repeats, long texts and a conversation over many pieces and tasks."""
    from pyspark.sql import functions as F

    rows = edge_rows()
    frame = spark.createDataFrame(rows, COLUMNS).repartition(3).withColumns({c: F.lit("clash") for c in ("digest", "body", "piece", "n")})
    found = conversations.repair(frame, size)
    digests = {r.conv_id: r.repaired_sha256 for r in conversations.repaired_digests(found.lines).collect()}
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests[r.conv_id]) for r in found.report.collect()}
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], sha256(r[2].encode()).digest())
    wanted = {}
    for conv, turn, role, text in rows:
        wanted.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert got == {c: plain_report(sorted(r, key=order)) for c, r in wanted.items()}


def test_damaged_query_on_edge_rows(spark):
    frame = spark.createDataFrame(edge_rows(), COLUMNS)
    got = conversations.repaired_report(conversations.damaged(frame), frame)
    assert reported(got) == {c: plain_report(r) for c, r in plain_damage(edge_rows()).items()}


def test_empty_table(spark):
    frame = spark.createDataFrame([], COLUMNS)
    assert conversations.repaired_report(conversations.damaged(frame), frame).count() == 0
