"""The sensor's state: every event in one batch, every batch until its receipt."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_streaming import EPOCH, RULES, line, write

from wardlog import schemas
from wardlog.operators.validate import validate_payloads
from wardlog.plans import sensor
from wardlog.sinks import sensor_state
from wardlog.streaming.logs import read_events, start_collector, stream_logs


def at(hour, minute=5):
    return datetime(2026, 9, 10, hour, minute)


class Sensor:
    def __init__(self, spark, folder):
        self.spark, self.logs = spark, folder / "logs"
        self.store, self.root, self.ck = (str(folder / n) for n in ("store", "state", "ck"))

    def collect(self, name, *lines):
        write(self.logs / name, *lines)
        start_collector(
            stream_logs(self.spark, str(self.logs)), "cowrie", self.store, self.ck, "sensor-one", EPOCH, RULES
        ).awaitTermination()

    def cut(self, now, key):
        return sensor.cut_batches(self.spark, self.store, self.root, now, key, "rules-v1", max_observations=2)

    def state(self):
        return sensor_state.load_sensor(self.spark, self.root)

    def assigned(self):
        return self.spark.read.parquet(f"{self.root}/assigned")

    def receipts(self, batches, envelopes, **changes):
        rows = batches.join(envelopes, "blob_name").select(
            F.lit("wardlog.outbox-receipt/v1").alias("schema_version"), "source_id", "source_epoch", "sequence",
            "payload_hash", F.col("sha256").alias("envelope_sha256"), "blob_name", F.lit('"0x8D"').alias("etag"),
        ).withColumns({k: F.lit(v) for k, v in changes.items()})
        return self.spark.createDataFrame(rows.collect(), schemas.RECEIPT)


@pytest.fixture
def one(spark, tmp_path):
    return Sensor(spark, tmp_path)


def test_each_event_is_cut_once_over_runs(one):
    assert one.cut(at(8), "empty") == 0 and sensor.pending_batches(one.spark, one.root).isEmpty()
    one.collect("a.log", *[line(i) for i in range(3)], line(9, hour=11))
    assert one.cut(at(10), "r1") == 2  # two events and one
    assert one.cut(at(10), "r1") is None
    assert [r.username for r in one.state().waiting.collect()] == ["u9"]
    assert one.cut(at(10, 40), "r2") == 0
    one.collect("b.log", line(5, hour=8), line(6, hour=11))  # one late, one too young
    assert one.cut(at(11), "r3") == 1
    assert one.cut(at(12), "r4") == 1
    events = read_events(one.spark, one.store)
    assert sorted(r.event_id for r in one.assigned().collect()) == sorted(r.event_id for r in events.collect())
    assert one.state().waiting.isEmpty()

    batches = sensor.pending_batches(one.spark, one.root)
    assert validate_payloads(batches).where("reject_reason is not null").isEmpty()
    rows = {int(r.sequence): r for r in batches.collect()}
    assert sorted(rows) == [0, 1, 2, 3]
    assert [rows[i].payload.previous_batch_hash for i in range(4)] == [None, *[rows[i].payload_hash for i in range(3)]]
    assert [[x.username for x in rows[i].payload.records] for i in range(4)] == [["u0", "u1"], ["u2"], ["u5"], ["u6", "u9"]]
    (head,) = one.state().heads.collect()
    assert (head.next_sequence, head.previous_hash) == ("4", rows[3].payload_hash)
    assert [r.sequence for r in sensor.pending_batches(one.spark, one.root, oldest=True).collect()] == ["0"]


def test_a_run_reads_only_new_commits(one, tmp_path):
    one.collect("a.log", line(1), line(2))
    assert one.cut(at(10), "r1") == 1
    for f in (tmp_path / "store" / "events").rglob("*.parquet"):
        f.write_bytes(b"not parquet")
    for f in (tmp_path / "store" / "events").rglob(".*.crc"):
        f.unlink()
    taken = one.state().taken
    stream = next(iter(taken))
    rows = one.spark.read.parquet(f"{one.root}/assigned").count()
    one.collect("b.log", line(3))
    assert sensor_state.new_commits(one.spark, one.store, taken) == [f"{stream}-1"]
    assert one.cut(at(11), "r2") == 1 and one.assigned().count() == rows + 1
    assert one.state().taken == {stream: 1}


def test_an_unfinished_commit_is_left_for_later(one, tmp_path):
    one.collect("a.log", line(1))
    (marker,) = (tmp_path / "store" / "collisions").glob("commit=*/_SUCCESS")
    marker.rename(tmp_path / "kept")
    assert one.cut(at(10), "r1") == 0 and one.state().taken == {}
    (tmp_path / "kept").rename(marker)
    assert one.cut(at(10), "r2") == 1
    with pytest.raises(ValueError, match="no number"):
        sensor_state.split_commit("unnumbered")


def test_a_run_that_dies_is_made_again(one, monkeypatch):
    one.collect("a.log", line(1), line(2), line(3))

    def die(*_):
        raise OSError("lost")

    monkeypatch.setattr(sensor.store, "commit_sensor", die)
    with pytest.raises(OSError, match="lost"):
        one.cut(at(10), "r1")
    assert one.state().version == 0
    monkeypatch.undo()
    one.collect("b.log", line(4))
    assert one.cut(at(10), "r1") == 2
    assert one.assigned().count() == one.assigned().select("event_id").distinct().count() == 4


def test_batches_stay_until_their_receipt(one):
    one.collect("a.log", *[line(i) for i in range(6)])
    assert one.cut(at(10), "r1") == 3
    waiting = sensor.pending_batches(one.spark, one.root)
    envelopes = waiting.select("blob_name", F.sha2("blob_name", 256).alias("sha256"))
    envelopes = one.spark.createDataFrame(envelopes.collect(), envelopes.schema)
    first, second = (waiting.where(f"sequence = '{i}'") for i in (0, 1))
    good = one.receipts(first, envelopes)
    sent = good.unionByName(good).unionByName(one.receipts(second, envelopes, envelope_sha256="e" * 64))
    sent = sent.unionByName(one.receipts(second, envelopes, etag="bare"))
    tally = sensor.acknowledge(one.spark, one.root, sent, envelopes, "ack-1")
    assert tally == {"acked": 1, "mismatch": 1, "pending": 1, "refused": 1}
    assert sensor.acknowledge(one.spark, one.root, sent, envelopes, "ack-1") is None
    assert sorted(r.sequence for r in one.state().pending.collect()) == ["1", "2"]
    # a receipt that comes again has no batch; a batch without a signed file is not acknowledged
    tally = sensor.acknowledge(one.spark, one.root, good, envelopes.limit(0), "ack-2")
    assert tally == {"orphan": 1, "pending": 2}
    rest = one.receipts(sensor.pending_batches(one.spark, one.root), envelopes)
    assert sensor.acknowledge(one.spark, one.root, rest, envelopes, "ack-3") == {"acked": 2}
    assert one.state().pending.isEmpty() and sensor.pending_batches(one.spark, one.root).isEmpty()
    assert one.cut(at(11), "r2") == 0 and one.state().heads.first().next_sequence == "3"
