"""The sensor side with its state: stored events to batches, batches to receipts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.config import LIMITS, NAMES, WireNames
from wardlog.functions.text import validate_receipts
from wardlog.operators.acceptance import chain_heads
from wardlog.operators.batching import next_pending
from wardlog.operators.delivery import STEP, reconcile_receipts
from wardlog.plans.collector import cut_round, still_waiting
from wardlog.sinks import sensor_state as store

SENSOR = ["source_id", "source_epoch"]
IDENTITY = [*STEP, "payload_hash", "blob_name"]


def next_heads(heads: DataFrame, batches: DataFrame) -> DataFrame:
    """Heads after new batches; sensors without news keep theirs."""
    moved = chain_heads(batches)
    return heads.join(moved, SENSOR, "left_anti").unionByName(moved)


def cut_batches(
    spark: SparkSession,
    events: str,
    root: str,
    now: datetime,
    run_key: str,
    classifier_version: str,
    names: WireNames = NAMES,
    max_observations: int = LIMITS.batch_records,
) -> int | None:
    """Cut all events of the event store ``events`` that are ready at ``now`` into
    chained batches and keep them as pending; the number of batches. A run key
    that is committed already does nothing and gives None.

    An event is in one batch, whatever dies: events leave ``waiting``, batches
    appear and heads move with one pointer. Late events take the next cut.
    """
    state = store.load_sensor(spark, root)
    if state.run_key == run_key:
        return None
    version = state.version + 1
    folder = f"{root}/versions/{version}"
    commits = store.new_commits(spark, events, state.taken)
    fresh, pool = store.take(spark, events, commits), state.waiting
    if fresh is not None:
        pool = fresh if pool is None else pool.unionByName(fresh)
    heads, pending, made = state.heads, state.pending, 0
    if pool is not None:
        batches, assigned = cut_round(pool, state.heads, now, classifier_version, names, max_observations)
        rows = batches.select(*SENSOR, F.col("payload.sequence").alias("sequence"), "payload_hash", "blob_name", "payload")
        batches = store.write_table(rows, f"{root}/batches/run={version}")
        store.write_table(assigned, f"{root}/assigned/run={version}")
        store.write_table(still_waiting(pool, now), f"{folder}/waiting")
        heads = next_heads(heads, batches)
        pending = pending.unionByName(batches.select(*IDENTITY, F.lit(version).alias("run")))
        made = batches.count()
    store.write_table(heads, f"{folder}/heads")
    store.write_table(pending, f"{folder}/pending")
    store.commit_sensor(spark, root, version, run_key, store.taken_after(state.taken, commits), pool is not None)
    return made


def pending_batches(spark: SparkSession, root: str, oldest: bool = False) -> DataFrame:
    """Unpublished batches with their payloads; with ``oldest`` the next of each
    sensor alone, since receivers accept a chain in its order."""
    state = store.load_sensor(spark, root)
    keys = state.pending
    if state.waiting is None:  # nothing was ever cut
        return keys.withColumn("payload", F.lit(None))
    if oldest:
        keys = next_pending(keys.withColumn("published_receipt", F.lit(None).cast("string"))).drop("published_receipt")
    batches = spark.read.parquet(f"{root}/batches")
    return batches.join(keys, [*IDENTITY, "run"], "left_semi")


def settle(pending: DataFrame, envelopes: DataFrame, receipts: DataFrame, names: WireNames = NAMES) -> DataFrame:
    """Status of pending batches and of receipts: acked, mismatch, pending,
    orphan, or ``refused`` for a receipt that is malformed. ``envelopes``
    (blob_name, sha256) are the signed files of the outbox; a batch that was
    never signed matches no receipt. Repeated receipts count once."""
    checked = validate_receipts(receipts, names)
    good = checked.where(F.col("reject_reason").isNull()).drop("reject_reason").distinct()
    signed = envelopes.select("blob_name", F.col("sha256").alias("envelope_sha256"))
    told = pending.select(*IDENTITY).join(signed, "blob_name", "left")
    bad = checked.where(F.col("reject_reason").isNotNull()).select(*STEP, "payload_hash", "etag", F.lit("refused").alias("status"))
    return reconcile_receipts(told, good).unionByName(bad)


def acknowledge(
    spark: SparkSession, root: str, receipts: DataFrame, envelopes: DataFrame, run_key: str, names: WireNames = NAMES
) -> dict[str, int] | None:
    """Take upload receipts in: acknowledged batches are no longer pending, what
    was said of each receipt is kept. Rows by status, None for a committed run key."""
    state = store.load_sensor(spark, root)
    if state.run_key == run_key:
        return None
    version = state.version + 1
    folder = f"{root}/versions/{version}"
    statuses = settle(state.pending, envelopes, receipts, names)
    statuses = store.write_table(statuses, f"{root}/receipts/run={version}")
    acked = statuses.where("status = 'acked'").select(*STEP).distinct()
    store.write_table(state.pending.join(acked, STEP, "left_anti").select(*state.pending.columns), f"{folder}/pending")
    store.write_table(state.heads, f"{folder}/heads")
    if state.waiting is not None:
        store.write_table(state.waiting, f"{folder}/waiting")
    store.commit_sensor(spark, root, version, run_key, state.taken, state.waiting is not None)
    return {r.status: r["count"] for r in statuses.groupBy("status").count().collect()}
