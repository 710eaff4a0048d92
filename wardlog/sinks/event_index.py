"""Insert-if-absent for event ids without a scan of the event store.

``ids/bucket=B/commit=C`` holds the ids and content hashes that a commit brought
into a bucket of the id's hash. ``marks`` is the membership summary in the same
folders: 32 other bits of the hash, a few bytes an id. A micro-batch reads the
marks of the buckets its ids fall into and then opens only those folders of ids
whose marks it meets; a mark met by chance costs a read and decides nothing.

Both are below ``gen=G``. ``compact`` folds a generation's commits into one
folder a bucket of the next, with as many buckets as its rows ask for, and
renames the pointer last, so a compaction that dies leaves the old generation
in force. Every row keeps the commit it came
with: a commit that is run again does not see itself and replaces its own
folders. One writer, like the store itself.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.session import staged_table
from wardlog.sinks.storage import file_system, replace_file
from wardlog.sources.files import path_exists

#: Buckets of a new index, a power of two, and the ids a bucket is meant for.
BUCKETS = 16
BUCKET_IDS = 1_000_000
IDS = "event_id string, event_hash string, origin string, bucket int, commit string"
MARKS = "mark int, bucket int, commit string"
#: The folder of compacted rows in place of a commit's name.
FOLDED = "folded"


def bucket_of(event_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(event_id.cast("string")), F.lit(buckets)).cast("int")


def mark_of(event_id: Column) -> Column:
    """Bits of the hash that the bucket does not depend on."""
    return F.shiftright(F.xxhash64(event_id.cast("string")), 32).cast("int")


def _generation(spark: SparkSession, root: str) -> tuple[int, int]:
    """(generation in force, its buckets); 0 before the first compaction."""
    if not path_exists(spark, f"{root}/CURRENT"):
        return 0, BUCKETS
    pointer = json.loads(spark.read.text(f"{root}/CURRENT", wholetext=True).first().value)
    return pointer["generation"], pointer["buckets"]


def _write(rows: DataFrame, folder: str) -> None:
    """(event_id, event_hash, origin, bucket, commit) as ids and marks; a
    commit that is repeated replaces its folders. Ids come last: without them
    marks open nothing."""
    with staged_table(rows, "index-rows") as stored:
        _write_stored(stored, folder)


def _write_stored(rows: DataFrame, folder: str) -> None:
    """The same of rows that are stored, as they are read twice."""
    marks = rows.select(mark_of(F.col("event_id")).alias("mark"), "bucket", "commit")
    for name, table in (("marks", marks), ("ids", rows)):
        dealt = table.repartition("bucket").sortWithinPartitions("bucket", table.columns[0])
        writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket", "commit").parquet(f"{folder}/{name}")


def _rows(events: DataFrame, origin: Column, commit: str, buckets: int) -> DataFrame:
    bucket = bucket_of(F.col("event_id"), buckets).alias("bucket")
    return events.select(F.col("event_id").cast("string").alias("event_id"), "event_hash", origin.alias("origin"), bucket, F.lit(commit).alias("commit"))


def append(events: DataFrame, root: str, commit: str) -> None:
    """Add a commit's events (event_id, event_hash) to the index."""
    generation, buckets = _generation(events.sparkSession, root)
    _write(_rows(events, F.lit(commit), commit, buckets), f"{root}/gen={generation}")


def rebuild(events: DataFrame, root: str) -> None:
    """Index a store (event_id, event_hash, commit) that has no index, or a lost one, in a new generation."""
    generation, buckets = _generation(events.sparkSession, root)
    with staged_table(events.select("event_id", "event_hash", "commit"), "index-rows") as stored:
        wanted = max(1, -(-stored.count() // BUCKET_IDS))
        buckets = max(buckets, 1 << (wanted - 1).bit_length())
        _write_stored(_rows(stored, F.col("commit"), FOLDED, buckets), f"{root}/gen={generation + 1}")
    _point(events.sparkSession, root, generation + 1, buckets)


def compact(spark: SparkSession, root: str) -> None:
    """Fold all commits of the generation in force into one folder a bucket."""
    folder = f"{root}/gen={_generation(spark, root)[0]}/ids"
    if path_exists(spark, folder):
        rows = spark.read.schema(IDS).parquet(folder)
        rebuild(rows.select("event_id", "event_hash", F.col("origin").alias("commit")), root)


def _point(spark: SparkSession, root: str, generation: int, buckets: int) -> None:
    system, beside = file_system(spark, f"{root}/CURRENT.next")
    out = system.create(beside, True)
    out.write(bytearray(json.dumps({"generation": generation, "buckets": buckets}).encode()))
    out.close()
    replace_file(spark, f"{root}/CURRENT.next", f"{root}/CURRENT")


def known(batch: DataFrame, root: str, without: str | None = None) -> DataFrame:
    """(event_id, event_hash) of stored events with ids of ``batch``, without
    those of one commit. At most buckets x commits folder names reach the driver."""
    spark = batch.sparkSession
    generation, count = _generation(spark, root)
    folder = f"{root}/gen={generation}"
    nothing = spark.createDataFrame([], "event_id string, event_hash string")
    if not path_exists(spark, f"{folder}/ids"):
        return nothing
    asked = batch.select(bucket_of(F.col("event_id"), count).alias("bucket"), mark_of(F.col("event_id")).alias("mark")).distinct()
    buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]
    if not buckets:
        return nothing
    marks = spark.read.schema(MARKS).parquet(f"{folder}/marks").where(F.col("bucket").isin(buckets))
    met = marks.join(asked, ["bucket", "mark"], "left_semi").select("bucket", "commit").distinct()
    folders = [f"{folder}/ids/bucket={r.bucket}/commit={r.commit}" for r in met.collect() if r.commit != without]
    folders = [f for f in folders if path_exists(spark, f)]  # marks of a write that died
    if not folders:
        return nothing
    rows = spark.read.schema(IDS).option("basePath", f"{folder}/ids").parquet(*folders)
    rows = rows.where(F.col("origin") != without) if without else rows
    ids = batch.select(F.col("event_id").cast("string").alias("event_id")).distinct()
    return rows.join(ids, "event_id", "left_semi").select("event_id", "event_hash")
