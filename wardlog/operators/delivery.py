"""Delivery of batches: receipts, and what to fetch next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.config import LIMITS, Limits
from wardlog.functions.text import holds, matches, sequence_number
from wardlog.operators.ranking import bounded_top

IDENTITY = ["source_id", "source_epoch", "sequence", "payload_hash", "envelope_sha256", "blob_name"]
STEP = ["source_id", "source_epoch", "sequence"]


def reconcile_receipts(pending: DataFrame, receipts: DataFrame) -> DataFrame:
    """Match pending batches and upload receipts: acked when all six fields
    agree, mismatch when only the batch position does, pending without a
    receipt, orphan without a batch."""
    left = pending.select(*STEP, F.struct(*IDENTITY).alias("_batch"))
    right = receipts.select(*STEP, F.struct(*IDENTITY).alias("_receipt"), "etag")
    return left.join(right, STEP, "full").select(
        *STEP,
        F.coalesce("_batch.payload_hash", "_receipt.payload_hash").alias("payload_hash"),
        "etag",
        F.when(F.col("_receipt").isNull(), "pending")
        .when(F.col("_batch").isNull(), "orphan")
        .when(F.col("_batch") == F.col("_receipt"), "acked")
        .otherwise("mismatch")
        .alias("status"),
    )


# Fixed value: the form of a batch's object name below its sensor's prefix.
OBJECT = r"\A(.+)/([^/]+)/([1-9][0-9]?)-(0|[1-9][0-9]*)/[0-9a-f]{64}\.json\z"


def select_new_batches(
    listing: DataFrame,
    targets: DataFrame,
    existing: DataFrame | None = None,
    budget: int | None = None,
    per_source: int | None = None,
    limits: Limits = LIMITS,
) -> DataFrame:
    """Files to fetch from repository listings (repository, path, mode, type,
    sha, size): regular, canonically named, in size, at or after the target's
    next sequence, not yet here. All of them, unless the caller names a
    ``budget`` of files or a share ``per_source``: then the lowest sequences
    come first, and the rest with the next run.
    """
    part = lambda i: F.regexp_extract("path", OBJECT, i)
    regular = (
        listing.where(
            (F.col("type") == "blob")
            & F.col("mode").isin("100644", "100755")
            & matches(F.col("sha"), r"\A[0-9a-f]{40}\z")
            & F.col("size").between(1, limits.envelope_bytes)
            & matches(F.col("path"), OBJECT)
        )
        .withColumn("source_id", part(1))
        .withColumn("source_epoch", part(2))
        .withColumn("sequence", part(4))
        .where(F.length("sequence").cast("string") == part(3))
        .where(F.length("sequence") <= limits.sequence_digits)
    )
    wanted = targets.select("source_id", "source_epoch", "repository", "next_sequence")
    ready = regular.join(wanted, ["source_id", "source_epoch", "repository"]).where(
        sequence_number(F.col("sequence")) >= sequence_number(F.col("next_sequence"))
    )
    if existing is not None:
        ready = ready.join(existing.select("path").distinct(), "path", "left_anti")
    order = [sequence_number(F.col("sequence")), F.col("path")]
    if per_source is not None:
        ready = bounded_top(ready, ["source_id", "source_epoch"], order, per_source, salt_on=["path"])
    chosen = ready.select("source_id", "source_epoch", "repository", "sequence", "path", "sha", "size")
    return chosen if budget is None else chosen.orderBy("source_id", "source_epoch", *order).limit(budget)


def git_blob_sha(content: Column) -> Column:
    """Object id of file bytes in a git tree."""
    header = F.concat(F.lit("blob "), F.octet_length(content).cast("string"))
    return F.sha1(F.concat(F.encode(header, "UTF-8"), F.lit(bytearray(b"\0")), content))


def verify_blob_sha(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Downloaded files (path, content) whose bytes match the listed tree."""
    listed = listing.select("path", "sha", "size")
    return (
        files.join(listed, "path")
        .where((F.octet_length("content") == F.col("size")) & holds(git_blob_sha(F.col("content")) == F.col("sha")))
        .drop("sha", "size")
    )

