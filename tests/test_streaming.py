"""Streams against the batch result, with availableNow."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from wardlog.config import RuleConfig
from wardlog.operators.validate import validate_payloads
from wardlog.plans.collector import collect_events, pump
from wardlog.sources.lines import line_cursors, relative_path
from wardlog.streaming.logs import hourly_windows, read_events, start_collector, store_events, stream_logs

EPOCH = "0b8f6c1e-7a52-4c39-9d41-2e6f0a9b7c53"
RULES = RuleConfig(trusted_cidrs=("192.0.2.0/24",))


def line(i, ip="11.0.0.1", event="cowrie.login.failed", hour=9):
    return json.dumps(
        {"eventid": event, "timestamp": f"2026-09-10T{hour:02d}:00:{i:02d}.123456789Z", "src_ip": ip, "username": f"u{i}", "password": "p"}
    )


def write(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(rows) + "\n")


def test_collector_stores_every_event_once(spark, tmp_path):
    logs, store = tmp_path / "logs", str(tmp_path / "store")

    def drain():
        start_collector(
            stream_logs(spark, str(logs)), "cowrie", store, str(tmp_path / "ck"), "sensor-one", EPOCH, RULES
        ).awaitTermination()

    write(logs / "a.log", line(1), line(1), line(2), line(3, ip="192.0.2.7"), "{broken", line(4, event="cowrie.session.connect"))
    drain()
    first = read_events(spark, store)
    assert sorted(r.username for r in first.collect()) == ["u1", "u1", "u2"]
    # A later chunk, an hour late, and another folder's file of the same name with an equal line.
    write(logs / "b.log", line(5, hour=8))
    write(logs / "other" / "a.log", line(2))
    drain()
    drain()
    events = read_events(spark, store)
    assert sorted(r.username for r in events.collect()) == ["u1", "u1", "u2", "u2", "u5"]
    assert events.select("event_id").distinct().count() == 5
    assert spark.read.parquet(f"{store}/rejects").select("reject_reason").collect()[0].reject_reason == "line_json"
    assert spark.read.parquet(f"{store}/collisions").isEmpty()

    files = [str(logs / name) for name in ("a.log", "b.log", "other/a.log")]
    file = relative_path(F.col("_metadata.file_path"), str(logs)).alias("file")
    lines = spark.read.text(files).select("value", file)
    batch, _ = collect_events({"cowrie": line_cursors(lines)}, "sensor-one", EPOCH, RULES)
    columns = batch.columns
    assert sorted(map(str, batch.collect())) == sorted(map(str, events.select(*columns).collect()))

    # A repeated commit replaces itself; changed content under one id shows up.
    commit = events.where("username = 'u2'").first()["commit"]
    own = events.where(F.col("commit") == commit).select(*columns)
    store_events(spark.createDataFrame(own.collect(), own.schema), store, commit)
    events = read_events(spark, store)
    assert events.count() == 5
    changed = events.where("username = 'u5'").select(*columns).withColumn("event_hash", F.lit("0" * 64))
    store_events(spark.createDataFrame(changed.collect(), changed.schema), store, "other-1")
    assert read_events(spark, store).count() == 5
    assert spark.read.parquet(f"{store}/collisions").count() == 1

    heads = spark.createDataFrame([], "source_id string, source_epoch string, next_sequence string, previous_hash string")
    nothing = spark.createDataFrame([], "event_id string")
    early, assigned = pump(events, nothing, heads, datetime(2026, 9, 10, 9, 5), "rules-v1")
    assert [r.username for r in early.select(F.inline("payload.records")).collect()] == ["u5"]
    moved = early.select(
        "source_id", "source_epoch", F.lit("1").alias("next_sequence"), F.col("payload_hash").alias("previous_hash")
    )
    later, _ = pump(events, assigned, moved, datetime(2026, 9, 10, 10, 5), "rules-v1")
    row = validate_payloads(later).first()
    assert row.reject_reason is None and row.payload.sequence == "1"
    assert [(r.username, r["count"]) for r in row.payload.records] == [("u1", 2), ("u2", 2)]
    assert row.payload.records[0].first_observed_at == "2026-09-10T09:00:01.123456789Z"


def test_hourly_windows_stream_equals_batch(spark, tmp_path):
    rows = spark.range(500).select(
        F.timestamp_seconds(F.lit(1_780_000_000) + F.pmod(F.hash("id"), F.lit(200_000))).alias("observed_at"),
        F.when(F.col("id") % 3 == 0, "http_request").otherwise("ssh_auth_failure").alias("kind"),
    )
    path = str(tmp_path / "obs")
    rows.repartition(5).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = (
        hourly_windows(stream).writeStream.outputMode("complete").format("memory").queryName("hours")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(map(str, spark.table("hours").collect())) == sorted(map(str, hourly_windows(rows).collect()))
