"""The central step as a stream of envelope files."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardlog.config import LIMITS, NAMES, WireNames
from wardlog.plans.central import run_ingest
from wardlog.session import stream_id
from wardlog.sources.files import qualified

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_envelopes(spark: SparkSession, root: str, max_files: int = 10_000) -> DataFrame:
    """Envelope files below ``root`` as they arrive: file, bytes, content."""
    prefix = "/" + qualified(spark, root).split(":", 1)[-1].strip("/") + "/"
    plain = F.regexp_replace(F.regexp_replace("path", r"\A[a-z0-9]+:/+", "/"), r"/+", "/")
    return (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .option("maxFilesPerTrigger", max_files)
        .load(root)
        .select(
            F.substring(plain, len(prefix) + 1, 2**31 - 1).alias("file"),
            F.col("length").alias("bytes"),
            F.when(F.col("length").between(1, LIMITS.envelope_bytes), F.col("content")).alias("content"),
        )
    )


def start_ingest(
    files: DataFrame,
    registry: DataFrame,
    root: str,
    checkpoint: str,
    names: WireNames = NAMES,
    outputs: str | None = None,
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
    once: bool = True,
    manifest: str | None = None,
) -> StreamingQuery:
    """Fold each micro-batch into the state, once: the run key is the
    stream's id and the micro-batch's number, so a repeated micro-batch finds itself committed.
    Rejected files are parked and tried again with the next micro-batch."""
    spark = files.sparkSession

    def fold(batch: DataFrame, batch_id: int) -> None:
        now = clock().strftime("%Y-%m-%dT%H:%M:%SZ")
        run_key = f"{stream_id(spark, checkpoint)}-{batch_id}"
        run_ingest(spark, batch, registry, root, now, run_key, names, outputs, manifest, retry_parked=True, park=True)

    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(fold)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 hour")).start()
