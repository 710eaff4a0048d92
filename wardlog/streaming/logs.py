"""Log lines as a stream: follow shipped files, parse, promote, store once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardlog.config import RuleConfig
from wardlog.functions.times import utc_date
from wardlog.operators.events import dedup_events, event_collisions
from wardlog.plans.collector import promoted_events
from wardlog.session import staged_table, stream_id
from wardlog.sinks import event_index
from wardlog.sources.files import path_exists
from wardlog.sources.lines import line_cursors, parse_logs, relative_path


def stream_logs(spark: SparkSession, path: str, max_files: int = 1_000) -> DataFrame:
    """Lines of files as they arrive: value, file (below ``path``). The checkpoint remembers
    which files were read. A file must be complete when it appears (ship
    rotated chunks); :func:`wardlog.sources.growing.follow_logs` reads files
    that grow."""
    return (
        spark.readStream.option("maxFilesPerTrigger", max_files)
        .option("recursiveFileLookup", "true")
        .text(path)
        .select("value", relative_path(F.col("_metadata.file_path"), path).alias("file"))
    )


def read_events(spark: SparkSession, store: str, without_commit: str | None = None) -> DataFrame | None:
    """The event store, without the rows of one commit."""
    if not path_exists(spark, f"{store}/events"):
        return None
    events = spark.read.parquet(f"{store}/events")
    return events.where(F.col("commit") != without_commit) if without_commit else events


def store_events(events: DataFrame, store: str, commit: str) -> None:
    """Exactly-once append. Every row carries the commit it came with, and a
    retried commit replaces its own folders. Events already stored by others
    are left out; contents that differ under one id go to ``collisions``. What
    is stored is asked of the index, which opens only what the ids may be in."""
    spark, index = events.sparkSession, f"{store}/index"
    arrival = F.struct("cursor")
    if not path_exists(spark, f"{index}/CURRENT") and not path_exists(spark, f"{index}/gen=0"):
        stored = read_events(spark, store)
        if stored is not None:
            event_index.rebuild(stored.where(F.col("commit") != commit), index)
    known = event_index.known(events, index, commit)
    fresh = dedup_events(events, known, arrival)
    fresh.withColumn("commit", F.lit(commit)).withColumn("day", utc_date(F.col("observed_at"))).write.mode(
        "overwrite"
    ).option("partitionOverwriteMode", "dynamic").partitionBy("commit", "day").parquet(f"{store}/events")
    event_collisions(events, known, arrival).write.mode("overwrite").parquet(f"{store}/collisions/commit={commit}")
    if path_exists(spark, f"{store}/events/commit={commit}"):
        own = spark.read.parquet(f"{store}/events/commit={commit}").select("event_id", "event_hash")
        event_index.append(own, index, commit)


def start_collector(
    lines: DataFrame,
    log_format: str,
    store: str,
    checkpoint: str,
    source_id: str,
    source_epoch: str,
    rules: RuleConfig = RuleConfig(),
    once: bool = True,
    compact_every: int = 256,
) -> StreamingQuery:
    """Run the collector over a stream of lines. The index of ids is compacted
    before each micro-batch whose number ``compact_every`` divides.

    The commit name is the stream's id and the micro-batch number, so a
    micro-batch that is run again after a failure writes the same rows to the
    same place.
    """

    def commit_batch(batch: DataFrame, batch_id: int) -> None:
        numbered = batch if "cursor" in batch.columns else line_cursors(batch)
        # Events, collisions and rejects all come from one parse.
        with staged_table(parse_logs({log_format: numbered}), "parsed") as parsed:
            events, rejects = promoted_events(parsed, source_id, source_epoch, rules)
            commit = f"{stream_id(events.sparkSession, checkpoint)}-{batch_id}"
            if batch_id and batch_id % compact_every == 0:
                event_index.compact(events.sparkSession, f"{store}/index")
            store_events(events, store, commit)
            rejects.write.mode("overwrite").parquet(f"{store}/rejects/commit={commit}")

    writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(commit_batch)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="15 seconds")).start()


def hourly_windows(observations: DataFrame, lateness: str | None = None) -> DataFrame:
    """Counts per tumbling UTC hour and kind. Works on a stream with update
    output; without ``lateness`` late rows still count, state then keeps every
    hour seen."""
    rows = observations.withWatermark("observed_at", lateness) if lateness else observations
    return (
        rows.groupBy(F.window("observed_at", "1 hour").alias("w"), "kind")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("hour"), F.col("w.end").alias("hour_end"), "kind", "n")
    )
