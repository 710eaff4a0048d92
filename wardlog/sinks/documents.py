"""Published JSON documents and single-file publication."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.config import LIMITS, NAMES, WireNames
from wardlog.functions.times import GRANULARITIES, period_end, utc_stamp
from wardlog.operators.canonical import transport_escaped
from wardlog.operators.rollup import PERIOD, label_sources, order_sources, top_n
from wardlog.session import cut_lineage, staged_table
from wardlog.sinks.render import render_ipset, render_nft, render_text
from wardlog.sinks.storage import file_system, join_files, replace_file, write_bytes
from wardlog.sources.files import path_exists

SENSORS = "array<struct<source_id:string,source_epoch:string,kind:string,count:bigint>>"
VALUES = "array<struct<value:string,count:bigint>>"
VALUE_DIMENSIONS = ("source_ips", "usernames", "passwords", "paths")


def publish_file(df: DataFrame, path: str) -> None:
    """Write a one-column text table as the single file ``path``. The rows go
    from a task to storage, never through the driver; the rename makes the
    new content appear at once."""
    spark = df.sparkSession
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    df.coalesce(1).write.text(staging)
    system, folder = file_system(spark, staging)
    part = next(s.getPath() for s in system.listStatus(folder) if s.getPath().getName().startswith("part-"))
    replace_file(spark, part.toString(), path)
    system.delete(folder, True)


def parts_folder(path: str) -> str:
    """Where a list's parts lie: beside it, so that its folder holds documents only."""
    folder, _, name = path.rpartition("/")
    return f"{folder}/parts/{name}"


def publish_lines(lines: DataFrame, path: str, single_file: bool = True) -> None:
    """Write rendered (ord, line) rows in order. The rows are dealt out by ranges
    of their position, each range is sorted and becomes one part, so a list of
    any length is written by all tasks. The parts joined in the index's order are
    the document; the index names them and is renamed last. The parts of
    the index before it stay for readers that are under way.

    ``single_file`` also joins them to the file ``path``: bytes copied one after
    the other with a small buffer, as a storage without joining demands.
    """
    _publish(lines, path, single_file)


def publish_array(items: DataFrame, path: str, head: str, tail: str, closing: str, single_file: bool = True) -> None:
    """The same for one JSON document: ``head``, the elements (ord, text) joined
    by commas, ``tail``. Every element ends in ``closing``, and positions are
    distinct. An element's row starts with its comma, so that parts need only
    be joined; ``closing`` is what ends the rows of a part."""
    first = F.col("ord") == items.agg(F.min("ord").alias("ord")).scalar()
    body = F.expr("substring(text, 1, length(text) - 1)")
    lines = items.select("ord", F.concat(F.when(first, F.lit("")).otherwise(F.lit(",")), body).alias("line"))
    _publish(lines, path, single_file, closing, head, tail)


def _publish(lines: DataFrame, path: str, single_file: bool, end: str = "\n", head: str = "", tail: str = "") -> None:
    spark, version, base = lines.sparkSession, uuid.uuid4().hex, parts_folder(path)
    folder = f"{base}/{version}"
    lines.repartitionByRange("ord").sortWithinPartitions("ord").select("line").write.option("lineSep", end).text(folder)
    system, written = file_system(spark, folder)
    files = sorted((s.getPath().getName(), s.getLen()) for s in system.listStatus(written) if s.getPath().getName().startswith("part-"))
    around = {"head": head.encode(), "tail": tail.encode()}
    for name, data in around.items():
        if data:
            write_bytes(spark, f"{folder}/{name}", data)
    files = [("head", len(around["head"])), *files, ("tail", len(around["tail"]))]
    before = read_index(spark, path)
    parts = [{"name": f"{version}/{name}", "bytes": size} for name, size in files if size]
    staging = f"{base}.index.staging-{version}"
    write_bytes(spark, staging, json.dumps({"parts": parts}).encode())
    replace_file(spark, staging, f"{base}.index")
    in_use = {version, *(part["name"].split("/")[0] for part in before)}
    for old in system.listStatus(written.getParent()):
        if old.getPath().getName() not in in_use:
            system.delete(old.getPath(), True)
    if single_file:
        join_files(spark, [f"{base}/{part['name']}" for part in parts], f"{path}.staging-{version}")
        replace_file(spark, f"{path}.staging-{version}", path)


def read_index(spark: SparkSession, path: str) -> list[dict]:
    """The parts of a published list in order; none before the first."""
    index = f"{parts_folder(path)}.index"
    if not path_exists(spark, index):
        return []
    return json.loads(spark.read.text(index, wholetext=True).first().value)["parts"]


def rollup_periods(totals: DataFrame, counts: DataFrame, heads: DataFrame) -> DataFrame:
    """One row per period with the published nested document in ``period``:
    all sensors and at most 100 values per other dimension."""
    values = (
        top_n(counts)
        .groupBy(*PERIOD)
        .agg(
            *[
                F.array_sort(
                    F.collect_list(F.when(F.col("dimension") == d, F.struct("rank", "value", "count")))
                ).alias(d)
                for d in VALUE_DIMENSIONS
            ]
        )
    )
    sensors = (
        order_sources(label_sources(counts, heads))
        .groupBy(*PERIOD)
        .agg(
            F.array_sort(F.collect_list(F.struct("rank", "source_id", "source_epoch", "kind", "count"))).alias("sources")
        )
    )
    joined = totals.join(sensors, PERIOD, "left").join(values, PERIOD, "left")
    sensor = lambda s: F.struct(*[s[n].alias(n) for n in ("source_id", "source_epoch", "kind", "count")])
    plain = {
        "sources": F.transform("sources", sensor),
        **{d: F.transform(d, lambda v: F.struct(v["value"].alias("value"), v["count"].alias("count"))) for d in VALUE_DIMENSIONS},
    }
    return joined.select(
        *PERIOD,
        F.struct(
            utc_stamp(F.col("period_start")).alias("start"),
            utc_stamp(period_end(F.col("granularity"), F.col("period_start"))).alias("end"),
            F.col("total"),
            *[
                F.coalesce(expr, F.from_json(F.lit("[]"), SENSORS if name == "sources" else VALUES)).alias(name)
                for name, expr in plain.items()
            ],
        ).alias("period"),
    )


def rollup_head(spark: SparkSession, granularity: str, updated_at: str | None, names: WireNames = NAMES) -> str:
    """What precedes the periods of a granularity's document."""
    fields = F.struct(
        F.lit(names.schema("rollup")).alias("schema_version"),
        F.lit(names.label).alias("label"),
        F.lit(granularity).alias("granularity"),
        F.lit(updated_at).cast("string").alias("updated_at"),
    )
    text = spark.range(1).select(transport_escaped(F.to_json(fields)).alias("text")).first().text
    return text.removesuffix("}") + ',"periods":['


def rollup_items(periods: DataFrame, granularity: str) -> DataFrame:
    """(ord, text) of a granularity's periods, each as its JSON."""
    text = transport_escaped(F.to_json("period")).alias("text")
    return periods.where(F.col("granularity") == granularity).select(F.col("period_start").alias("ord"), text)


def write_rollups(
    totals: DataFrame, counts: DataFrame, heads: DataFrame, updated_at: str | None, directory: str, names: WireNames = NAMES
) -> None:
    """One document per granularity, written in parts from one computation of the periods."""
    with staged_table(rollup_periods(totals, counts, heads), "periods") as periods:
        for granularity in GRANULARITIES:
            head = rollup_head(periods.sparkSession, granularity, updated_at, names)
            publish_array(rollup_items(periods, granularity), f"{directory}/{granularity}.json", head, "]}\n", "}")


def quarantine_document(entries: DataFrame, now: str, updated_at: str | None, names: WireNames = NAMES) -> DataFrame:
    """Reject report; its time is now with entries, else the state's."""
    item = F.struct("file", "sha256", "bytes", "reason")
    listed = F.array_sort(F.collect_list(item))
    stamp = F.when(F.size("_l") > 0, F.lit(now)).otherwise(F.lit(updated_at or "1970-01-01T00:00:00Z"))
    return entries.limit(LIMITS.quarantine_entries).agg(listed.alias("_l")).select(
        transport_escaped(
            F.to_json(
                F.struct(
                    F.lit(names.schema("quarantine")).alias("schema_version"),
                    stamp.alias("updated_at"),
                    F.col("_l").alias("entries"),
                )
            )
        ).alias("text")
    )


def write_quarantine(entries: DataFrame, now: str, updated_at: str | None, path: str, names: WireNames = NAMES) -> None:
    publish_file(quarantine_document(entries, now, updated_at, names), path)


def manifest_blobs(statuses: DataFrame) -> DataFrame:
    """Objects that may be deleted: accepted batches and identical replays."""
    return statuses.where(F.col("status").isin("accepted", "replay")).select("blob_name")


def manifest_items(statuses: DataFrame) -> DataFrame:
    """(ord, text) of a run's deletable objects, each as its JSON string."""
    blobs = manifest_blobs(statuses).distinct().withColumn("_json", F.to_json(F.array("blob_name")))
    return blobs.select(F.col("blob_name").alias("ord"), F.expr("substring(_json, 2, length(_json) - 2)").alias("text"))


def write_manifest(statuses: DataFrame, path: str, names: WireNames = NAMES, single_file: bool = True) -> None:
    """The manifest names all of one run's batches, in parts like every list."""
    head = json.dumps({"schema_version": names.schema("accepted-manifest")}, separators=(",", ":")).removesuffix("}")
    publish_array(manifest_items(statuses), path, head + ',"blobs":[', "]}\n", '"', single_file)


def write_deny_lists(
    lists: DataFrame, now: Column, directory: str, names: WireNames = NAMES, single_files: bool = True
) -> None:
    """Two lists in three formats. ``lists`` is read six times, so it is best
    given as a stored or cached table."""
    windows = {"recent": LIMITS.recent_hours * 3600, "persistent": LIMITS.persistent_days * 86_400}
    for name, seconds in windows.items():
        publish_lines(render_text(lists, name, now, names), f"{directory}/{name}.txt", single_files)
        publish_lines(render_nft(lists, name, now, names), f"{directory}/{name}.nft", single_files)
        publish_lines(render_ipset(lists, name, seconds, now, names), f"{directory}/{name}.ipset", single_files)


def envelope_conflicts(envelopes: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(blob_name, contents) of names that would stand for different bytes,
    within ``envelopes`` or against what is ``stored`` (blob_name, sha256)."""
    digests = envelopes.select("blob_name", F.sha2("content", 256).alias("sha256"))
    if stored is not None:
        digests = digests.unionByName(stored.select("blob_name", "sha256"))
    # two different digests exist exactly when the smallest differs from the largest
    ends = digests.groupBy("blob_name").agg(F.min("sha256").alias("_lo"), F.max("sha256").alias("_hi"))
    return ends.where(F.col("_lo") != F.col("_hi")).select("blob_name")


def write_envelopes(envelopes: DataFrame, path: str) -> DataFrame:
    """Append signed envelopes (source_id, blob_name, content) to the outbox
    table. A name stands for one content: names that come with two contents in
    this call, or with other bytes than stored, are returned and none of their
    rows is written. Repeated rows and stored ones are left out, so a call that
    is made again after a failure adds what is missing."""
    spark = envelopes.sparkSession
    stored = spark.read.parquet(path).select("blob_name", "sha256") if path_exists(spark, path) else None
    conflicts = cut_lineage(envelope_conflicts(envelopes, stored))
    fresh = envelopes.withColumn("sha256", F.sha2("content", 256)).join(conflicts, "blob_name", "left_anti")
    if stored is not None:
        fresh = fresh.join(stored.select("blob_name").distinct(), "blob_name", "left_anti")
    columns = envelopes.columns
    one = fresh.groupBy("source_id", "blob_name").agg(F.first(F.struct(*columns, "sha256")).alias("e")).select("e.*")
    one.write.mode("append").partitionBy("source_id").parquet(path)
    return conflicts
