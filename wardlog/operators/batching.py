"""From promoted events to hourly batches.

Events: source_id, source_epoch, event_id, kind, observed_at, source_ip,
username, password, path, rule_ids and optionally nanos.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlog.config import LIMITS, NAMES, Limits, WireNames
from wardlog.functions.text import sequence_number
from wardlog.functions.times import days, hour_of, hours, utc_text
from wardlog.operators.canonical import signing_text, transport_payload
from wardlog.session import stage_table

SENSOR = ["source_id", "source_epoch"]


def ready_events(events: DataFrame, watermark: Column) -> DataFrame:
    """Events older than the watermark that are in no batch yet."""
    ready = events.where(F.col("observed_at") < watermark)
    return ready.where(F.col("batch_sequence").isNull()) if "batch_sequence" in events.columns else ready


def batch_cut(
    events: DataFrame, watermark: Column, limit: int = LIMITS.batch_records, limits: Limits = LIMITS
) -> DataFrame:
    """All ready events with the ``batch`` of their sensor (0, 1, ...) and
    their ``position`` in it (1, 2, ...), earliest first. A batch has at most
    ``limit`` events and lies within one stretch of 31 days, counted from the
    sensor's earliest hour; nothing is left over.

    Places come from counts: events per sensor and minute are summed in order
    within each stretch (at most 44,640 rows), and only the events of one
    sensor's minute are ranked together.
    """
    ready = stage_table(ready_events(events, watermark), "ready")  # read three times below
    origin = ready.groupBy(*SENSOR).agg(hour_of(F.min("observed_at")).alias("_origin"))
    since = F.unix_seconds("observed_at") - F.unix_seconds("_origin")
    placed = ready.join(origin, SENSOR).withColumns(
        {
            "_stretch": F.floor(since / (limits.window_days * 86_400)),
            "_minute": F.floor(F.unix_seconds("observed_at") / 60),
        }
    )
    before = lambda over: F.coalesce(
        F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    stretch = [*SENSOR, "_stretch"]
    minutes = placed.groupBy(*stretch, "_minute").agg(F.count("*").alias("_n"))
    in_order = minutes.withColumn("_before", before(Window.partitionBy(*stretch).orderBy("_minute"))).drop("_n")
    batches = minutes.groupBy(*stretch).agg(F.ceil(F.sum("_n") / limit).alias("_n"))
    first = batches.withColumn("_first", before(Window.partitionBy(*SENSOR).orderBy("_stretch"))).drop("_n")
    bases = in_order.join(first, stretch)
    order = [F.col("observed_at"), *([F.col("nanos")] if "nanos" in events.columns else []), F.col("event_id")]
    rank = F.row_number().over(Window.partitionBy(*stretch, "_minute").orderBy(*order))
    place = F.col("_before") + F.col("_rank") - 1
    return (
        placed.withColumn("_rank", rank)
        .join(bases, [*stretch, "_minute"])
        .withColumns(
            {
                "batch": (F.col("_first") + F.floor(place / limit)).cast("bigint"),
                "position": (place % limit + 1).cast("int"),
            }
        )
        .select(*events.columns, "batch", "position")
    )


def record_value() -> Column:
    return F.coalesce("username", "path")


def record_keys(by: list[str]) -> list[str]:
    return [*by, "kind", "source_ip", "username", "password", "path", "rule_ids"]


def hourly_counts(events: DataFrame, by: list[str]) -> DataFrame:
    """Level one: record key and hour to a count and first/last time. All the
    heavy reduction happens here, map-side first."""
    at = F.struct("observed_at", *(["nanos"] if "nanos" in events.columns else []), *(
        ["observed_text"] if "observed_text" in events.columns else []
    ))
    return events.groupBy(*record_keys(by), hour_of(F.col("observed_at")).alias("hour")).agg(
        F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last")
    )


def aggregate_records(events: DataFrame, by: list[str]) -> DataFrame:
    """One record per key with count, first/last time and its sorted hourly
    buckets. Level two folds at most 744 hours per record."""
    text = lambda s: F.col(f"{s}.observed_text") if "observed_text" in events.columns else utc_text(F.col(f"{s}.observed_at"))
    return (
        hourly_counts(events, by)
        .groupBy(*record_keys(by))
        .agg(
            F.sum("n").alias("count"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            F.array_sort(
                F.collect_list(F.struct(F.col("hour").alias("at"), F.col("n").alias("n")))
            ).alias("_hours"),
        )
        .select(
            *record_keys(by),
            "count",
            F.col("first.observed_at").alias("first_at"),
            F.col("last.observed_at").alias("last_at"),
            text("first").alias("first_observed_at"),
            text("last").alias("last_observed_at"),
            F.transform(
                "_hours", lambda b: F.struct(utc_text(b["at"]).alias("hour"), b["n"].alias("count"))
            ).alias("hourly_buckets"),
        )
    )


def hourly_buckets(events: DataFrame, by: list[str]) -> DataFrame:
    """The bucket rows of :func:`aggregate_records` in long form."""
    return hourly_counts(events, by).select(*record_keys(by), "hour", "n")


def observation_window(events: DataFrame, by: list[str]) -> DataFrame:
    """Half-open whole-hour window per group."""
    return events.groupBy(*by).agg(
        hour_of(F.min("observed_at")).alias("window_start"),
        (hour_of(F.max("observed_at")) + hours(1)).alias("window_end"),
        F.count("*").alias("observations"),
    )


def record_order() -> list[Column]:
    """Byte order of the record key. Missing text sorts as empty text."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return [
        F.col("kind"),
        F.col("source_ip"),
        F.coalesce(record_value(), F.lit("")),
        blank("password"),
        F.col("first_observed_at"),
        F.array_join("rule_ids", "\x1f"),
    ]


def assemble_payloads(
    events: DataFrame,
    headers: DataFrame,
    by: list[str],
    classifier_version: str,
    names: WireNames = NAMES,
) -> DataFrame:
    """Payload structs from events already assigned to batches.

    ``headers`` has one row per batch: ``by`` plus sequence,
    previous_batch_hash (null for the first) and created_at text. The caller
    guarantees at most 10,000 events per batch, which bounds the array.
    """
    records = aggregate_records(events, by)
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(record_order())])
    nested = records.groupBy(*by).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    key.alias("key"),
                    F.struct(
                        "kind",
                        "source_ip",
                        "username",
                        "password",
                        "path",
                        "count",
                        "first_observed_at",
                        "last_observed_at",
                        "hourly_buckets",
                        "rule_ids",
                    ).alias("record"),
                )
            )
        ).alias("_records"),
        hour_of(F.min("first_at")).alias("_start"),
        (hour_of(F.max("last_at")) + hours(1)).alias("_end"),
    )
    joined = nested.join(headers, by)
    return joined.select(
        *by,
        F.struct(
            F.lit(names.schema("batch")).alias("schema_version"),
            F.col("source_id"),
            F.col("source_epoch"),
            F.col("sequence"),
            F.nullif("previous_batch_hash", F.lit("")).alias("previous_batch_hash"),
            F.col("created_at"),
            F.struct(utc_text(F.col("_start")).alias("start"), utc_text(F.col("_end")).alias("end")).alias(
                "observation_window"
            ),
            F.lit(classifier_version).alias("classifier_version"),
            F.transform("_records", lambda r: r["record"]).alias("records"),
        ).alias("payload"),
    )


# The most that one event adds to an encoded payload besides its texts and
# rule ids, and the most bytes that escaping makes of one.
RECORD_BYTES = 420
ESCAPED_BYTES = 6
HEADER_BYTES = 8_192


def event_bytes() -> Column:
    """An upper bound of what one event adds to the encoded payload. Events of
    one record are merged there, so sums of it are bounds as well."""
    texts = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("username", "password", "path")), F.lit(0))
    return (texts * ESCAPED_BYTES + F.octet_length(F.to_json("rule_ids")) + RECORD_BYTES).cast("bigint")


def size_split(cut: DataFrame, created_at: str, classifier_version: str, names: WireNames = NAMES, limits: Limits = LIMITS) -> DataFrame:
    """The cut with every batch whose encoded payload is too large divided into
    consecutive parts that fit; both ``batch`` and ``position`` are numbered
    anew and every event stays. Payloads are built only of batches whose sum of
    bounds is too large; one window over the events of those that are (10,000
    at most each) finds the parts."""
    by = [*SENSOR, "batch"]
    bound = F.sum(event_bytes()) + HEADER_BYTES
    suspects = cut.groupBy(*by).agg(bound.alias("_bound")).where(F.col("_bound") > limits.batch_bytes).select(*by)
    doubtful = cut.join(suspects, by, "left_semi")
    headers = batch_headers(doubtful, None, created_at)
    size = F.octet_length(transport_payload(F.col("payload")))
    large = assemble_payloads(doubtful, headers, by, classifier_version, names).where(size > limits.batch_bytes).select(*by)
    large = stage_table(large, "large")  # read twice below
    running = Window.partitionBy(*by).orderBy("position")
    marked = cut.join(large.withColumn("_large", F.lit(True)), by, "left")
    part = F.floor(F.sum(event_bytes()).over(running) / (limits.batch_bytes - HEADER_BYTES))
    parts = marked.withColumn("_part", F.when(F.col("_large"), part).otherwise(0)).drop("_large")
    numbered = (
        parts.groupBy(*by, "_part")
        .agg(F.min("position").alias("_from"))
        .withColumn("_batch", F.row_number().over(Window.partitionBy(*SENSOR).orderBy("batch", "_part")) - 1)
    )
    return (
        parts.join(numbered, [*by, "_part"])
        .withColumn("position", F.col("position") - F.col("_from") + 1)
        .withColumn("batch", F.col("_batch").cast("bigint"))
        .drop("_part", "_from", "_batch")
    )


def batch_headers(events: DataFrame, heads: DataFrame | None, created_at: str) -> DataFrame:
    """Header of each (sensor, batch): the sequence goes on from the sensor's
    chain head. The first batch refers to the head's hash, later ones to
    ``OPEN_HASH`` until :func:`link_batches` knows their predecessor."""
    each = events.select(*SENSOR, "batch").distinct()
    if heads is None:
        start, known = F.lit(0).cast("decimal(20,0)"), F.lit(None).cast("string")
    else:
        each = each.join(heads.select(*SENSOR, "next_sequence", "previous_hash"), SENSOR, "left")
        start, known = F.coalesce(sequence_number(F.col("next_sequence")), F.lit(0)), F.col("previous_hash")
    return each.select(
        *SENSOR,
        "batch",
        (start + F.col("batch")).cast("decimal(20,0)").cast("string").alias("sequence"),
        F.when(F.col("batch") == 0, known).otherwise(F.lit(OPEN_HASH)).alias("previous_batch_hash"),
        F.lit(created_at).alias("created_at"),
    )


OPEN_HASH = "0" * 64


def link_batches(batches: DataFrame, names: WireNames = NAMES) -> DataFrame:
    """Chain the batches of each sensor: every ``previous_batch_hash`` that is
    still open becomes the hash of the batch before. The hash covers that very
    field, so a chain is sequential by definition; sensors run in parallel, a
    sensor's canonical texts pass through its task one by one, and only hashes
    come back."""
    texts = batches.select(*SENSOR, "batch", signing_text(F.col("payload"), names).alias("text"))
    marker = f'"previous_batch_hash":"{OPEN_HASH}"'

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sensor, digest = None, ""
        for part in parts:
            found = []
            for source, epoch, _, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if (source, epoch) != sensor:
                    sensor, digest = (source, epoch), ""
                before = digest
                text = text.replace(marker, f'"previous_batch_hash":"{before}"', 1) if before else text
                digest = hashlib.sha256(text.encode()).hexdigest()
                found.append(before)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(found, pa.string())], names=[*SENSOR, "batch", "_before"])

    in_order = texts.repartition(*SENSOR).sortWithinPartitions(*SENSOR, "batch")
    links = in_order.mapInArrow(run, "source_id string, source_epoch string, batch bigint, _before string")
    previous = F.when(F.col("_before") != "", F.col("_before")).otherwise(F.col("payload.previous_batch_hash"))
    fields = batches.schema["payload"].dataType.fieldNames()
    payload = F.struct(*[(previous if n == "previous_batch_hash" else F.col(f"payload.{n}")).alias(n) for n in fields])
    return batches.join(links, [*SENSOR, "batch"]).withColumn("payload", payload).drop("_before")


def build_batches(
    events: DataFrame,
    heads: DataFrame,
    created_at: str,
    watermark: Column,
    classifier_version: str,
    max_observations: int = LIMITS.batch_records,
    names: WireNames = NAMES,
    limits: Limits = LIMITS,
) -> DataFrame:
    """All batches of every sensor's ready events, chained from its head: cut,
    split by size, aggregate, link. Rows: source_id, source_epoch, batch, payload."""
    if not 1 <= max_observations <= limits.batch_records:
        raise ValueError(f"max_observations must lie between 1 and {limits.batch_records}")
    # Read several times below, so each is stored once.
    cut = stage_table(batch_cut(events, watermark, max_observations, limits), "cut")
    split = stage_table(size_split(cut, created_at, classifier_version, names, limits), "split")
    return assemble_batches(split, heads, created_at, classifier_version, names)


def assemble_batches(
    cut: DataFrame, heads: DataFrame, created_at: str, classifier_version: str, names: WireNames = NAMES
) -> DataFrame:
    """Chained payloads of events that have their batch."""
    headers = batch_headers(cut, heads, created_at)
    payloads = assemble_payloads(cut, headers, [*SENSOR, "batch"], classifier_version, names)
    return link_batches(stage_table(payloads, "payloads"), names)


def next_pending(batches: DataFrame) -> DataFrame:
    """Oldest unpublished batch per sensor."""
    pending = batches.where(F.col("published_receipt").isNull())
    whole = F.struct(*batches.columns)
    return (
        pending.groupBy(*SENSOR)
        .agg(F.min_by(whole, sequence_number(F.col("sequence"))).alias("_b"))
        .select("_b.*")
    )
