"""Operator 11: conversation structure repair by bidirectional Dijkstra.

A conversation's rows become a lattice: a node is (rows used, role of the last
line kept). Edges keep, rerole or delete the next row, or insert an empty line;
a path from the first node to an end that reads ``(s?(ua)+)?`` is a repair, its
letters are the audit. Two heaps, one from each end, settle nodes by cost; once
their tops exceed the cheapest crossing, every node that lies on a path of that
cost carries a label from both sides, and the least concatenation is taken.

Rows are dealt by range of (conversation, turn, role, text digest), so a task
sees conversations in order and a long one is spread over tasks. Pieces of at
most ``PIECE`` rows are solved on their own: once where the piece is the whole
conversation, else from every entry role to every exit role; a scan over a
conversation's pieces then composes them. Rows alike in all columns are counted
before they are dealt, and texts seen before travel as digests.

Defined cases: null role or text is one space; null turns come first; rows of
one turn go by role, then by digest of the text; null conv_id is one
conversation; a role is known by its first character, an unknown or empty one is
never kept; an empty table gives empty results; other columns are ignored; a
very long conversation is several pieces with the same result as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlog.session import stage_table

#: Rows of a conversation that are solved together.
PIECE = 512
RULE_COST = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED_COST = 5
#: Roles of the last line kept: none yet, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE = ("", "system", "user", "assistant")
#: The role an inserted or reroled line takes after each of these.
NEXT = (USER, USER, ASSISTANT, USER)
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
PAIRS = [(a, b) for a in range(4) for b in range(4) if b == a or b >= USER or a == START]
LEGAL = {"su", "ua", "au"}
#: What the first fault of a row is.
FINE, CUT_OFF, BLANK, DUPLICATE = range(4)


class Repaired(NamedTuple):
    #: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit
    report: DataFrame
    #: conv_id, piece (ascending within a conversation), whole, lines array<struct<role, text>>
    lines: DataFrame


def shape(kind: int, role: str) -> str:
    """All that the lattice needs of a row, as one character: x must go, capitals are truncated."""
    if kind in (BLANK, DUPLICATE):
        return "x"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "-"
    return initial if kind == FINE else {"s": "S", "u": "U", "a": "A", "-": "_"}[initial]


def _onward(rows: str, at: int, state: int) -> Iterator[tuple[str, int, tuple[int, int]]]:
    yield "I", RULE_COST["I"], (at, NEXT[state])
    if at < len(rows):
        row = rows[at]
        yield "D", RULE_COST["D"], (at + 1, state)
        if row != "x":
            extra = TRUNCATED_COST if row in "SUA_" else 0
            yield "R", RULE_COST["R"] + extra, (at + 1, NEXT[state])
            kept = KEEP.get((state, row.lower()))
            if kept is not None:
                yield "K", RULE_COST["K"] + extra, (at + 1, kept)


def _back(rows: str, at: int, state: int) -> Iterator[tuple[str, int, tuple[int, int]]]:
    for before in range(4):
        if NEXT[before] == state:
            yield "I", RULE_COST["I"], (at, before)
    if at:
        row = rows[at - 1]
        yield "D", RULE_COST["D"], (at - 1, state)
        if row != "x":
            extra = TRUNCATED_COST if row in "SUA_" else 0
            for before in range(4):
                if NEXT[before] == state:
                    yield "R", RULE_COST["R"] + extra, (at - 1, before)
                if KEEP.get((before, row.lower())) == state:
                    yield "K", RULE_COST["K"] + extra, (at - 1, before)


def cheapest(rows: str, entry: int = START, exits: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest path, the least audit of equal ones.

    Edges that cost nothing use a row, so within a cost nodes settle in the
    order of rows (from the end: against it), and their labels are then final.
    Labels of a node and cost are never prefixes of each other, so the least
    label before a node and the least after it make the least path through it.
    """
    labels = [{(0, entry): (0, "")}, {(len(rows), x): (0, "") for x in exits}]
    heaps = [[(0, 0, entry)], [(0, -len(rows), x) for x in sorted(exits)]]
    settled: list[set] = [set(), set()]
    best = 0 if not rows and entry in exits else None
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, at, state = heappop(heaps[side])
        at = abs(at)
        if (at, state) in settled[side]:
            continue
        settled[side].add((at, state))
        audit = labels[side][at, state][1]
        for letter, price, node in (_back if side else _onward)(rows, at, state):
            new = (cost + price, letter + audit if side else audit + letter)
            old = labels[side].get(node)
            if old is not None and old <= new:
                continue
            labels[side][node] = new
            if old is None or new[0] < old[0]:
                heappush(heaps[side], (new[0], -node[0] if side else node[0], node[1]))
            other = labels[1 - side].get(node)
            if other is not None and (best is None or new[0] + other[0] < best):
                best = new[0] + other[0]
    if best is None:
        return None
    ahead, behind = labels
    crossings = (a[1] + behind[n][1] for n, a in ahead.items() if n in behind and a[0] + behind[n][0] == best)
    return best, min(crossings)


@lru_cache(maxsize=50_000)
def _cheapest_whole(rows: str) -> tuple[int, str]:
    return cheapest(rows)


def apply_audit(lines: list[tuple[str, str]], audit: str, entry: int = START) -> list[dict]:
    """The lines that an audit leaves of the rows (role, text)."""
    out, state, at = [], entry, 0
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            out.append({"role": ROLE[state], "text": ""})
            continue
        role, text = lines[at]
        at += 1
        if letter == "K":
            state = KEEP[state, role[:1]]
            out.append({"role": role, "text": text})
        elif letter == "R":
            state = NEXT[state]
            out.append({"role": ROLE[state], "text": text})
    return out


LINES = T.ArrayType(T.StructType().add("role", "string").add("text", "string"))
CHOICES = T.ArrayType(T.StructType().add("entry", "integer").add("exit", "integer").add("cost", "long").add("audit", "string"))
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _piece_schema(rows: DataFrame) -> T.StructType:
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType)])
    for name in ("piece", "turns", "low", "high", *COUNTS):
        schema.add(name, "long")
    return schema.add("whole", "boolean").add("first", "string").add("last", "string").add("choices", CHOICES).add("lines", LINES)


def _summary(rows: list[tuple]) -> dict:
    """Counts of a piece of rows (turn, role, text, kind) in order."""
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    kinds = [r[3] for r in rows]
    return {
        "turns": len(set(turns)),
        "low": turns[0] if turns else None,
        "high": turns[-1] if turns else None,
        "blank": kinds.count(BLANK),
        "duplicate": kinds.count(DUPLICATE),
        "truncated": kinds.count(CUT_OFF),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        "first": initials[0],
        "last": initials[-1],
    }


def pieces(rows: DataFrame, size: int = PIECE) -> DataFrame:
    """Pieces of conversations of at most ``size`` rows with their counts, choices and lines."""
    schema = _piece_schema(rows)
    arrow = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        nonlocal arrow
        arrow = arrow or to_arrow_schema(schema)
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        conv, seen_any, whole_so_far, out = None, False, False, []

        def solve(ends: bool) -> dict:
            nonlocal number
            drawn = "".join(shape(r[3], r[1]) for r in held)
            whole = whole_so_far and ends
            lines = [(r[1], r[2]) for r in held]
            if whole:
                cost, audit = _cheapest_whole(drawn)
                choices = [{"entry": START, "exit": START, "cost": cost, "audit": audit}]
                lines = apply_audit(lines, audit)
            else:
                found = [(a, b, cheapest(drawn, a, (b,))) for a, b in PAIRS]
                choices = [{"entry": a, "exit": b, "cost": f[0], "audit": f[1]} for a, b, f in found if f]
                lines = [{"role": a, "text": b} for a, b in lines]
            number += 1
            return {"conv_id": conv, "piece": number - 1, "whole": whole, "choices": choices, "lines": lines} | _summary(held)

        # A text row, if there is one, comes right before the counted row of the same key.
        text = None
        for batch in batches:
            for at, turn, role, digest, blank, body, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not seen_any or at != conv:
                    if held:
                        out.append(solve(seen_any and True))
                    # the first conversation of a task may have begun in the task before
                    conv, whole_so_far, held = at, seen_any, []
                    seen_any = True
                if body is not None:
                    text = (turn, role, digest, body)
                    continue
                own = text is not None and text[:3] == (turn, role, digest)
                for copy in range(n):
                    if len(held) == size:
                        out.append(solve(False))
                        held, whole_so_far = [], False
                    if blank:
                        held.append((turn, role, None, BLANK))
                    elif own and not copy:
                        held.append((turn, role, text[3], FINE if text[3].rstrip(SPACES)[-1] in ".!?" else CUT_OFF))
                    else:
                        held.append((turn, role, None, DUPLICATE))
                    if len(out) >= 256:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out = []
        if held:
            out.append(solve(False))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return ordered(rows).mapInArrow(run, schema)


SPACES = " \t\n\x0b\x0c\r"


def ordered(rows: DataFrame) -> DataFrame:
    """Rows in the order of conversations over the tasks: each text once, at its
    first turn, and counted rows (n) without text for what lies where."""
    base = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    counted = base.select("conv_id", "turn", "role", digest, blank.alias("blank")).groupBy("conv_id", "turn", "role", "digest", "blank")
    counted = counted.agg(F.count("*").alias("n")).withColumn("body", F.lit(None).cast("string"))
    # null turns sort first in a struct of (has turn, turn) as they do in the range
    first = F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("at")
    texts = base.where(~blank).groupBy("conv_id", "role", "text").agg(first)
    texts = texts.select("conv_id", "at.turn", "role", digest, F.lit(False).alias("blank"), F.col("text").alias("body"), F.lit(0).cast("long").alias("n"))
    both = counted.select("conv_id", "turn", "role", "digest", "blank", "body", "n").unionByName(texts)
    order = ["conv_id", "turn", "role", "digest"]
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartitionByRange(slices, *order).sortWithinPartitions(*order, "n")


def _compose(found: DataFrame) -> DataFrame:
    """For conversations in several pieces: (piece, entry, audit) chosen for each
    piece, and on the last piece the report of the whole conversation."""
    schema = T.StructType([found.schema["conv_id"]]).add("piece", "long").add("entry", "integer").add("chosen", "string")
    schema.add("ends", "boolean").add("gaps", "long")
    for name in (*COUNTS, "cost"):
        schema.add(name, "long")
    schema.add("audit", "string")
    names = ["conv_id", "piece", "turns", "low", "high", *COUNTS, "first", "last", "choices"]

    def conversation(rows: list[dict]) -> Iterator[dict]:
        best = {START: (0, "")}
        steps = []
        for r in rows:
            after, came = {}, {}
            for c in r["choices"]:
                if c["entry"] in best:
                    cost, audit = best[c["entry"]]
                    new = (cost + c["cost"], audit + c["audit"])
                    if c["exit"] not in after or new < after[c["exit"]]:
                        after[c["exit"]], came[c["exit"]] = new, (c["entry"], c["audit"])
            best = after
            steps.append(came)
        cost, audit, state = min((*best[s], s) for s in ENDS if s in best)
        chosen = []
        for came in reversed(steps):
            chosen.append(came[state])
            state = came[state][0]
        report = {k: sum(r[k] for r in rows) for k in COUNTS}
        turned = [r for r in rows if r["low"] is not None]
        for a, b in zip(rows, rows[1:]):
            report["illegal"] += a["last"] + b["first"] not in LEGAL
        distinct = sum(r["turns"] for r in turned) - sum(a["high"] == b["low"] for a, b in zip(turned, turned[1:]))
        report["gaps"] = turned[-1]["high"] - turned[0]["low"] + 1 - distinct if turned else 0
        for r, (entry, part) in zip(rows, reversed(chosen), strict=True):
            row = {"conv_id": r["conv_id"], "piece": r["piece"], "entry": entry, "chosen": part, "ends": False}
            yield row if r is not rows[-1] else row | report | {"ends": True, "cost": cost, "audit": audit}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, held = to_arrow_schema(schema), []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[-1]["conv_id"] != row["conv_id"]:
                    yield pa.RecordBatch.from_pylist(list(conversation(held)), schema=arrow)
                    held = []
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist(list(conversation(held)), schema=arrow)

    dealt = found.select(*names).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return dealt.mapInArrow(run, schema)


def repair(rows: DataFrame, size: int = PIECE) -> Repaired:
    """Repair the conversations of rows (conv_id, turn, role, text)."""
    found = stage_table(pieces(rows, size), "conversations")
    whole, parts = found.where("whole"), found.where("not whole")
    composed = stage_table(_compose(parts), "conversations")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long")).alias("gaps")
    report = whole.select("conv_id", gaps, *COUNTS, F.col("choices")[0]["cost"].alias("cost"), F.col("choices")[0]["audit"].alias("audit"))
    report = report.unionByName(composed.where("ends").select("conv_id", "gaps", *COUNTS, "cost", "audit"))
    schema = T.StructType([found.schema["conv_id"]]).add("piece", "long").add("whole", "boolean").add("lines", LINES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                lines = apply_audit([(x["role"], x["text"]) for x in r["lines"]], r["chosen"], r["entry"])
                out.append({"conv_id": r["conv_id"], "piece": r["piece"], "whole": False, "lines": lines})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    mended = parts.select("conv_id", "piece", "lines").join(composed.select("piece", "entry", "chosen"), "piece")
    mended = mended.select("conv_id", "piece", "lines", "entry", "chosen").mapInArrow(run, schema)
    return Repaired(report, whole.select("conv_id", "piece", "whole", "lines").unionByName(mended))


def repaired_digests(lines: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the lines ``role:text`` joined by newlines.
    A digest over several pieces is sequential by definition: they stream
    through one task in order, and only the digest is held."""
    joined = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    whole = lines.where("whole").select("conv_id", F.sha2(joined, 256).alias("repaired_sha256"))
    parts = lines.where("not whole").select("conv_id", "piece", (F.size("lines") > 0).alias("any"), joined.alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        now, state, begun, some = None, None, False, False
        for batch in batches:
            ids, digests = [], []
            for conv, any_, body in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if not some or conv != now:
                    if some:
                        ids.append(now)
                        digests.append(state.hexdigest())
                    now, state, begun, some = conv, sha256(), False, True
                if any_:
                    state.update((b"\n" if begun else b"") + body.encode())
                    begun = True
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema[0].type), pa.array(digests, pa.string())], names=["conv_id", "repaired_sha256"])
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([now], batch.schema[0].type), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"])

    schema = T.StructType([lines.schema["conv_id"]]).add("repaired_sha256", "string")
    return whole.unionByName(parts.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(run, schema))


def damaged(rows: DataFrame) -> DataFrame:
    """The damage that the query repairs: by crc32 of ``conv_id:turn`` modulo 20
    a row is dropped, emptied, stripped of sentence ends, repeated or given to user."""
    word = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(word("text"), ".!?", "")).otherwise(word("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(word("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    marked = rows.select("conv_id", "turn", "role", "text", kind.alias("kind")).where("kind != 0")
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repaired_report(rows: DataFrame, original: DataFrame) -> DataFrame:
    """Report and digest of every conv_id of ``original``; zeros and the digest of nothing where no row is left."""
    found = repair(rows)
    same = lambda other: F.col("all.conv_id").eqNullSafe(F.col(f"{other}.conv_id"))
    every = original.select("conv_id").distinct().alias("all")
    joined = every.join(found.report.alias("report"), same("report"), "left").join(repaired_digests(found.lines).alias("digest"), same("digest"), "left")
    zero = lambda name: F.coalesce(F.col(f"report.{name}"), F.lit(0).cast("long")).alias(name)
    return joined.select(
        F.col("all.conv_id").alias("conv_id"),
        *[zero(n) for n in ("gaps", *COUNTS, "cost")],
        F.coalesce("report.audit", F.lit("")).alias("audit"),
        F.coalesce("digest.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
