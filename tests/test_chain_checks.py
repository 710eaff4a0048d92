"""A run checks what the last run wrote, not the history; an audit checks all."""

import json
import random

import pytest
import signing
from pyspark.sql import functions as F
from test_ingest import chain, ingest, read_sources, write_files

from wardlog import schemas
from wardlog.operators import acceptance
from wardlog.plans.central import check_state
from wardlog.sinks.state import load_state


def rewrite(spark, folder, change):
    """Store a changed version of a run's accepted rows."""
    rows = spark.read.schema(schemas.ACCEPTED).parquet(str(folder)).collect()
    spark.createDataFrame([change(r.asDict()) for r in rows], schemas.ACCEPTED).write.mode("overwrite").parquet(str(folder))


def runs(spark, tmp_path, lengths, sensors=("sensor-one", "sensor-two")):
    """One run per entry, each from an own folder that holds news only."""
    registry = read_sources(spark, tmp_path, *[{"source_id": s} for s in sensors])
    chains, done = {s: chain(sum(lengths), source=s) for s in sensors}, 0
    for i, n in enumerate(lengths):
        folder = tmp_path / f"in-{i}"
        write_files(folder / "in", *[e for s in sensors for e in chains[s][done : done + n]])
        yield folder, registry, i
        done += n


def step(spark, tmp_path, folder, registry, i):
    from wardlog.plans.central import run_ingest
    from wardlog.sources.files import scan_envelopes

    files = scan_envelopes(spark, str(folder / "in"))
    return run_ingest(spark, files, registry, str(tmp_path / "state"), "2026-09-10T21:00:00Z", f"run-{i}")


def test_a_run_opens_no_older_batches(spark, tmp_path):
    accepted = tmp_path / "state" / "accepted"
    for folder, registry, i in runs(spark, tmp_path, (3, 2, 2)):
        if i == 2:
            kept = {f: f.read_bytes() for f in (accepted / "run=1").glob("*.parquet")}
            for f in (accepted / "run=1").glob("*"):
                f.write_bytes(b"not parquet")
            for f in (accepted / "run=1").glob(".*.crc"):
                f.unlink()
        result = step(spark, tmp_path, folder, registry, i)
        assert (result.replayed, result.quarantined) == (0, 0) and result.accepted == (6, 4, 4)[i]
    for f, data in kept.items():
        f.write_bytes(data)
    state = load_state(spark, str(tmp_path / "state"))
    assert {(r.source_id, r.next_sequence) for r in state.heads.collect()} == {("sensor-one", "7"), ("sensor-two", "7")}
    assert [(r.first_sequence, r.steps) for r in state.moved.collect()] == [("5", 2)] * 2
    check_state(state, audit=True)


@pytest.mark.parametrize(
    "change, reason",
    [
        (lambda r: {**r, "created_at": "2026-09-10T20:00:01Z"}, "rows_changed"),
        (lambda r: {**r, "sequence": str(int(r["sequence"]) + 1)}, "chain_not_contiguous"),
        (lambda r: {**r, "source_id": "sensor-six"}, "rows_changed"),
    ],
)
def test_damage_is_refused(spark, tmp_path, change, reason):
    for args in runs(spark, tmp_path, (2, 1), sensors=("sensor-one",)):
        step(spark, tmp_path, *args)
    root = str(tmp_path / "state")
    check_state(load_state(spark, root), audit=True)
    saved = [r.asDict() for r in spark.read.parquet(f"{root}/accepted/run=2").collect()]
    rewrite(spark, f"{root}/accepted/run=2", change)
    with pytest.raises(ValueError, match=reason):
        check_state(load_state(spark, root))
    rewrite(spark, f"{root}/accepted/run=2", lambda r: saved[0])
    check_state(load_state(spark, root), audit=True)
    # damage in older rows that breaks no rule of the chain is found by the digest
    rewrite(spark, f"{root}/accepted/run=1", lambda r: {**r, "created_at": "2026-09-10T20:00:01Z"})
    check_state(load_state(spark, root))
    with pytest.raises(ValueError, match="rows_changed"):
        check_state(load_state(spark, root), audit=True)


def test_a_lost_or_repeated_row_of_the_last_run_is_found(spark, tmp_path):
    for args in runs(spark, tmp_path, (2, 3), sensors=("sensor-one",)):
        step(spark, tmp_path, *args)
    root = str(tmp_path / "state")
    rows = spark.read.parquet(f"{root}/accepted/run=2").orderBy("sequence").collect()
    for kept, reason in (
        (rows[:2], "rows_changed|head_changed"),
        (rows[:1] + rows[2:], "chain_not_contiguous"),
        (rows[:2] + rows[1:], "repeated_sequence"),
        ([], "rows_changed"),
    ):
        spark.createDataFrame(kept, schemas.ACCEPTED).write.mode("overwrite").parquet(f"{root}/accepted/run=2")
        with pytest.raises(ValueError, match=reason):
            check_state(load_state(spark, root))


def test_replays_behind_the_heads_are_still_told_apart(spark, tmp_path):
    registry = read_sources(spark, tmp_path, {"source_id": "sensor-one"})
    good = chain(3)
    rival = signing.envelope(signing.payload("1", good[0][2], records=[signing.record(ip="1.1.1.1", username="other")]))
    write_files(tmp_path / "in", *good[:2])
    ingest(spark, tmp_path, registry)
    write_files(tmp_path / "in", good[2], rival)
    result = ingest(spark, tmp_path, registry, key="run-2")
    assert (result.accepted, result.replayed, result.quarantined) == (1, 2, 1)
    report = json.loads((tmp_path / "out/quarantine.json").read_text())
    assert [e["reason"] for e in report["entries"]] == ["replay_conflict"]


def test_digests_of_parts_add_up_in_any_order(spark):
    rnd = random.Random(5)
    rows = [("s", "e", rnd.choice(("host", None)), str(i), f"{i:064x}", f"n{i}", None) for i in range(200)]
    whole = spark.createDataFrame(rows, schemas.ACCEPTED).agg(*acceptance.digest_sums()).first()
    rnd.shuffle(rows)
    parts = [spark.createDataFrame(rows[a : a + 50], schemas.ACCEPTED).agg(*acceptance.digest_sums()).first() for a in range(0, 200, 50)]
    assert [sum(p[i] for p in parts) for i in (0, 1)] == list(whole)
    # copies do not cancel out, columns do not run into each other
    double = spark.createDataFrame(rows[:1] * 2, schemas.ACCEPTED).agg(*acceptance.digest_sums()).first()
    single = spark.createDataFrame(rows[:1], schemas.ACCEPTED).agg(*acceptance.digest_sums()).first()
    assert list(double) == [2 * v for v in single]


def test_a_state_without_digests_gets_them(spark, tmp_path):
    root, pointer = str(tmp_path / "state"), tmp_path / "state" / "CURRENT"
    for folder, registry, i in runs(spark, tmp_path, (2, 1, 1)):
        step(spark, tmp_path, folder, registry, i)
        if i == 1:  # as an older version left it
            heads = spark.read.parquet(f"{root}/versions/2/heads").drop(*acceptance.LANES)
            kept = spark.createDataFrame(heads.collect(), heads.schema)
            kept.write.mode("overwrite").parquet(f"{root}/versions/2/heads")
            told = json.loads(pointer.read_text())
            del told["chains"]
            pointer.write_text(json.dumps(told))
            (pointer.parent / ".CURRENT.crc").unlink(missing_ok=True)
    state = load_state(spark, root)
    check_state(state, audit=True)
    assert state.heads.where(F.col("digest_a").isNull()).isEmpty()
