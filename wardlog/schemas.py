"""Explicit schemas of every table and document."""

from __future__ import annotations

from pyspark.sql import types as T

BUCKET = T.StructType().add("hour", "string").add("count", "long")

RECORD = (
    T.StructType()
    .add("kind", "string")
    .add("source_ip", "string")
    .add("username", "string")
    .add("password", "string")
    .add("path", "string")
    .add("count", "long")
    .add("first_observed_at", "string")
    .add("last_observed_at", "string")
    .add("hourly_buckets", T.ArrayType(BUCKET))
    .add("rule_ids", T.ArrayType(T.StringType()))
)

WINDOW = T.StructType().add("start", "string").add("end", "string")

PAYLOAD = (
    T.StructType()
    .add("schema_version", "string")
    .add("source_id", "string")
    .add("source_epoch", "string")
    .add("sequence", "string")
    .add("previous_batch_hash", "string")
    .add("created_at", "string")
    .add("observation_window", WINDOW)
    .add("classifier_version", "string")
    .add("records", T.ArrayType(RECORD))
)

SIGNATURE = T.StructType().add("algorithm", "string").add("key_id", "string").add("value", "string")

ENVELOPE = T.StructType().add("payload", PAYLOAD).add("signature", SIGNATURE)

REGISTRATION = (
    T.StructType()
    .add("source_id", "string")
    .add("source_epoch", "string")
    .add("key_id", "string")
    .add("public_key", "string")
    .add("blob_prefix", "string")
    .add("kind", "string")
    .add("repository", "string")
    .add("enabled", "boolean")
)

ACCEPTED = (
    T.StructType()
    .add("source_id", "string")
    .add("source_epoch", "string")
    .add("kind", "string")
    .add("sequence", "string")
    .add("payload_hash", "string")
    .add("blob_name", "string")
    .add("created_at", "string")
)

PERIOD_TOTALS = (
    T.StructType().add("granularity", "string").add("period_start", "timestamp").add("total", "long")
)

PERIOD_COUNTS = (
    T.StructType()
    .add("granularity", "string")
    .add("period_start", "timestamp")
    .add("dimension", "string")
    .add("value", "string")
    .add("count", "long")
)

PERIOD_OVERFLOW = (
    T.StructType()
    .add("granularity", "string")
    .add("period_start", "timestamp")
    .add("dimension", "string")
    .add("overflow", "long")
)

# One row per list key, sensor and day. The nested record of the published
# model (days array, sources map) is derived, so that folding new facts into
# the state is one grouped aggregation on an evenly spread key.
EVIDENCE = (
    T.StructType()
    .add("key", "string")
    .add("source_id", "string")
    .add("day", "date")
    .add("last_seen", "timestamp")
)

RECEIPT = (
    T.StructType()
    .add("schema_version", "string")
    .add("source_id", "string")
    .add("source_epoch", "string")
    .add("sequence", "string")
    .add("payload_hash", "string")
    .add("envelope_sha256", "string")
    .add("blob_name", "string")
    .add("etag", "string")
)
