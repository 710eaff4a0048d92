"""The state in parts: what a run writes follows the run, and a lost run leaves nothing."""

from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wardlog import schemas
from wardlog.operators.evidence import merge_evidence
from wardlog.operators.rollup import merge_state
from wardlog.sinks import state as store

NOW = datetime(2026, 9, 30, tzinfo=timezone.utc)


def at(text):
    return datetime.fromisoformat(text + "+00:00")


def counts(spark, hour, values):
    rows = [(g, start, "paths", f"/{v}", 1 + v % 3) for v in values for g, start in (("hourly", hour), ("yearly", at("2026-01-01T00:00:00")))]
    return spark.createDataFrame(rows, schemas.PERIOD_COUNTS)


def evidence(spark, day, keys):
    rows = [(f"11.0.0.{k}/32", "s", day.date(), day) for k in keys]
    return spark.createDataFrame(rows, schemas.EVIDENCE)


def run(spark, root, version, added, now=NOW):
    parts = store.fold_parts(store.load_state(spark, root), added, root, version, now)
    store.write_version(spark.createDataFrame([], store.HEADS), root, version, "heads")
    store.write_version(spark.createDataFrame([], store.PARKED), root, version, "parked")
    store.append_accepted(spark.createDataFrame([], schemas.ACCEPTED), root, version)
    store.commit_state(spark, root, version, f"run-{version}", None, parts)
    return parts


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def written(root, version):
    return sum(f.stat().st_size for f in Path(root).glob(f"tables/counts/v={version}*/part=*/*.parquet"))


def test_a_run_writes_what_it_adds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "DELTAS", 2)
    root = str(tmp_path / "state")
    first = counts(spark, at("2026-09-20T10:00:00"), range(3_000))
    second = counts(spark, at("2026-09-20T11:00:00"), [5])
    run(spark, root, 1, {"counts": first})
    parts = run(spark, root, 2, {"counts": second})
    assert written(root, 2) < written(root, 1) / 10
    assert sum(len(v) for v in parts["counts"].values()) == 16 + 2  # eight slices of an hour and a year, and one of each more
    wanted = merge_state(first, second)
    assert rows(store.load_state(spark, root).counts) == rows(wanted.select(*first.columns))
    # the third delta of the yearly slice folds that slice alone
    parts = run(spark, root, 3, {"counts": counts(spark, at("2026-09-20T11:00:00"), [5])})
    folded = [p for p, v in parts["counts"].items() if v == ["3-folded"]]
    assert len(folded) == 1 and folded[0].startswith("yearly-")
    assert written(root, 3) < written(root, 1) / 4
    assert rows(store.load_state(spark, root).counts) == rows(merge_state(first, second, second).select(*first.columns))


def test_parts_expire_by_the_map(spark, tmp_path):
    root = str(tmp_path / "state")
    old, new = at("2026-08-01T10:00:00"), at("2026-09-29T10:00:00")
    added = {"counts": counts(spark, old, [1]).unionByName(counts(spark, new, [2]))}
    added["evidence"] = evidence(spark, at("2026-08-31T12:00:00"), [1]).unionByName(evidence(spark, new, [2]))
    added["evidence"] = added["evidence"].unionByName(evidence(spark, at("2026-08-30T12:00:00"), [3]))
    parts = run(spark, root, 1, added)
    kinds = sorted({p.rsplit("-", 1)[0] for p in parts["counts"]})
    assert len([k for k in kinds if k.startswith("hourly")]) == 1 and len([k for k in kinds if k.startswith("yearly")]) == 1
    state = store.load_state(spark, root)
    assert {r.key for r in state.evidence.collect()} == {"11.0.0.1/32", "11.0.0.2/32"}
    later = run(spark, root, 2, {}, datetime(2027, 9, 30, tzinfo=timezone.utc))
    assert not later["evidence"] and all(p.startswith("yearly") for p in later["counts"])


def test_a_run_that_died_leaves_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "state")
    first, second = counts(spark, at("2026-09-20T10:00:00"), range(20)), counts(spark, at("2026-09-20T10:00:00"), range(5))
    days = evidence(spark, at("2026-09-20T12:00:00"), [1])
    run(spark, root, 1, {"counts": first, "evidence": days})
    before = rows(store.load_state(spark, root).counts)
    monkeypatch.setattr(store, "commit_state", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        run(spark, root, 2, {"counts": second.unionByName(counts(spark, at("2026-09-21T10:00:00"), range(9)))})
    monkeypatch.undo()
    assert rows(store.load_state(spark, root).counts) == before
    run(spark, root, 2, {"counts": second, "evidence": days})  # the retry has less and replaces all
    state = store.load_state(spark, root)
    assert rows(state.counts) == rows(merge_state(first, second).select(*first.columns))
    assert rows(state.evidence) == rows(merge_evidence(days))


def test_a_state_of_whole_tables_moves_over(spark, tmp_path):
    root = str(tmp_path / "state")
    first = counts(spark, at("2026-09-20T10:00:00"), range(4))
    for name, schema in store.TABLES.items():
        store.write_version(first if name == "counts" else spark.createDataFrame([], schema), root, 1, name)
    store.append_accepted(spark.createDataFrame([], schemas.ACCEPTED), root, 1)
    store._write_pointer(spark, root, {"version": 1, "run_key": "a", "updated_at": None})
    assert rows(store.load_state(spark, root).counts) == rows(first)
    run(spark, root, 2, {"counts": first})
    assert rows(store.load_state(spark, root).counts) == rows(merge_state(first, first).select(*first.columns))
    assert {c: t for c, t in store.load_state(spark, root).counts.where(F.lit(True)).dtypes} == dict(first.dtypes)
