"""Steps that use their input several times must compute it once."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlog.functions.addresses import cidr_columns, ip_number
from wardlog.operators import batching, networks
from wardlog.sinks import event_index


def counted(spark, rows):
    """The rows and a counter of how many were computed."""
    seen = spark.sparkContext.accumulator(0)

    def note(value):
        seen.add(1)
        return value

    return rows.withColumn("event_id", F.udf(note, "string")("event_id")), seen


def test_index_rows_are_computed_once(spark, tmp_path):
    rows = spark.range(50).select(F.col("id").cast("string").alias("event_id"), F.lit("h").alias("event_hash"))
    rows, seen = counted(spark, rows)
    event_index.append(rows, str(tmp_path), "one")
    assert seen.value == 50


def test_batch_cut_computes_events_once(spark):
    at = F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000)
    rows = spark.range(50).select(F.lit("s").alias("source_id"), F.lit("e").alias("source_epoch"), F.col("id").cast("string").alias("event_id"), at.alias("observed_at"))
    rows, seen = counted(spark, rows)
    assert batching.batch_cut(rows, F.lit("2030-01-01").cast("timestamp"), 20).count() == 50
    assert seen.value == 50


def test_addresses_meet_cidrs_by_their_texts(spark):
    rows = spark.createDataFrame([(1, "11.0.0.1"), (2, "11.0.1.1"), (3, None), (4, "x"), (5, "11.0.0.1")], "n int, source_ip string")
    cidrs = spark.createDataFrame([("11.0.0.0/24",)], "cidr string").select(cidr_columns(F.col("cidr")).alias("c")).select("c.*")
    kept = networks.cidr_anti_join(rows, ip_number(F.col("source_ip")), cidrs, texts=["source_ip"])
    assert kept.columns == rows.columns and sorted(r.n for r in kept.collect()) == [2, 3, 4]
