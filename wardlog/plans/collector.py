"""The sensor side: lines to promoted events, events to hourly batches."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.config import LIMITS, NAMES, RuleConfig, WireNames
from wardlog.operators.batching import SENSOR, assemble_batches, batch_cut, batch_headers, size_split
from wardlog.operators.canonical import with_identity
from wardlog.operators.classify import promote
from wardlog.operators.events import with_content_hash
from wardlog.session import stage_table
from wardlog.sources.lines import flat_observations, parse_logs, split_rejects

EVENT_COLUMNS = (
    "source_id",
    "source_epoch",
    "event_id",
    "event_hash",
    "adapter_id",
    "cursor",
    "kind",
    "observed_at",
    "observed_text",
    "nanos",
    "source_ip",
    "username",
    "password",
    "path",
    "status",
    "rule_ids",
)


def collect_events(
    lines_by_format: dict[str, DataFrame],
    source_id: str,
    source_epoch: str,
    rules: RuleConfig = RuleConfig(),
) -> tuple[DataFrame, DataFrame]:
    """(promoted events with content hash, rejects). Narrow from the lines to
    the events: no shuffle before the store's own deduplication. Lines are
    parsed once for both; what waits in the shared folder is without them."""
    parsed = stage_table(parse_logs(lines_by_format).drop("line"), "parsed")
    return promoted_events(parsed, source_id, source_epoch, rules)


def promoted_events(
    parsed: DataFrame, source_id: str, source_epoch: str, rules: RuleConfig = RuleConfig()
) -> tuple[DataFrame, DataFrame]:
    """The same from parsed lines."""
    good, rejects = split_rejects(parsed)
    promoted = promote(flat_observations(good), rules)
    events = (
        with_content_hash(promoted)
        .withColumn("source_id", F.lit(source_id))
        .withColumn("source_epoch", F.lit(source_epoch))
    )
    return events.select(*EVENT_COLUMNS), rejects


def hour_and_watermark(now: datetime) -> tuple[datetime, datetime]:
    """A batch is created for the full hour and takes events older than the
    hour less 30 seconds; later ones wait for the next batch. A time without
    zone is UTC."""
    now = now.replace(tzinfo=timezone.utc) if now.tzinfo is None else now.astimezone(timezone.utc)
    hour = now.replace(minute=0, second=0, microsecond=0)
    return hour, hour - timedelta(seconds=LIMITS.watermark_seconds)


def instant(at: datetime) -> Column:
    """A zoned time as TIMESTAMP, to the microsecond."""
    since = at - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit(since // timedelta(microseconds=1)).cast("bigint"))


def pump(
    events: DataFrame,
    assigned: DataFrame,
    heads: DataFrame,
    now: datetime,
    classifier_version: str,
    names: WireNames = NAMES,
) -> tuple[DataFrame, DataFrame]:
    """(all batches of the events that wait, event assignments).

    ``assigned`` (event_id, source_id, source_epoch, sequence) says which
    events are in a batch already. Late events are not dropped: they are
    simply still unassigned. One call empties the backlog; callers append the
    assignments and advance the heads to each sensor's last batch.
    """
    waiting = events.join(assigned.select("event_id"), "event_id", "left_anti")
    return cut_round(waiting, heads, now, classifier_version, names)


def cut_round(
    waiting: DataFrame,
    heads: DataFrame,
    now: datetime,
    classifier_version: str,
    names: WireNames = NAMES,
    max_observations: int = LIMITS.batch_records,
) -> tuple[DataFrame, DataFrame]:
    """(batches, assignments) of those events in no batch that are ready at ``now``."""
    hour, watermark = hour_and_watermark(now)
    created_at = hour.strftime("%Y-%m-%dT%H:%M:%SZ")
    cut = stage_table(batch_cut(waiting, instant(watermark), max_observations), "cut")
    cut = stage_table(size_split(cut, created_at, classifier_version, names), "split")
    batches = with_identity(assemble_batches(cut, heads, created_at, classifier_version, names), names)
    sequences = batch_headers(cut, heads, created_at).select(*SENSOR, "batch", "sequence")
    assignments = cut.join(sequences, [*SENSOR, "batch"]).select("event_id", *SENSOR, "sequence")
    return batches, assignments


def still_waiting(waiting: DataFrame, now: datetime) -> DataFrame:
    """The events that :func:`cut_round` leaves."""
    ready = F.col("observed_at") < instant(hour_and_watermark(now)[1])
    return waiting.where(~F.coalesce(ready, F.lit(False)))
