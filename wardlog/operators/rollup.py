"""Rollups: hourly, daily, monthly and yearly totals per dimension.

State is kept long (one row per value) instead of nested maps, so every fold
is a grouped sum with map-side combine on a key that includes the value; a
hot sensor, address or period never gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlog.config import LIMITS
from wardlog.functions.text import holds, sequence_number
from wardlog.functions.times import GRANULARITIES, days, period_end, period_start
from wardlog.operators.classify import SSH
from wardlog.operators.ranking import bounded_top

PERIOD = ["granularity", "period_start"]
DIMENSION = [*PERIOD, "dimension"]
VALUE = [*DIMENSION, "value"]
DIMENSIONS = ("sources", "source_ips", "usernames", "passwords", "paths")


def record_buckets(batches: DataFrame) -> DataFrame:
    """Accepted batches (source_id, source_epoch, source_kind, sequence,
    payload) to one row per record and hour, numbered in arrival order."""
    return (
        batches.select(
            "source_id",
            "source_epoch",
            "source_kind",
            sequence_number(F.col("sequence")).alias("seq"),
            F.posexplode("payload.records").alias("record_no", "r"),
        )
        .select(
            "source_id",
            "source_epoch",
            "source_kind",
            "seq",
            "record_no",
            "r.kind",
            "r.source_ip",
            "r.username",
            "r.password",
            "r.path",
            F.posexplode("r.hourly_buckets").alias("bucket_no", "b"),
        )
        .withColumn("hour", F.col("b.hour").cast("timestamp"))
        .withColumn("n", F.col("b.count"))
        .drop("b")
    )


ARRIVAL = ("source_id", "source_epoch", "seq", "record_no", "bucket_no")


def _in_all_periods(df: DataFrame, granularities: tuple[str, ...] = GRANULARITIES) -> DataFrame:
    each = F.array(
        *[
            F.struct(F.lit(g).alias("granularity"), period_start(g, F.col("hour")).alias("period_start"))
            for g in granularities
        ]
    )
    return df.withColumn("_p", F.explode(each)).select("_p.*", *[c for c in df.columns if c != "hour"])


def explode_periods(buckets: DataFrame) -> DataFrame:
    """Each hourly bucket in its four periods."""
    return _in_all_periods(buckets)


def period_totals(buckets: DataFrame) -> DataFrame:
    """Events per period. Hours are summed first, so the fourfold expansion
    acts on one row per hour."""
    hourly = buckets.groupBy("hour").agg(F.sum("n").alias("n"))
    return _in_all_periods(hourly).groupBy(*PERIOD).agg(F.sum("n").alias("total"))


def dimension_values(publish_passwords: Column | None = None) -> Column:
    """ARRAY<STRUCT<dimension, value>> of one bucket row. Passwords count only
    from decoy sensors."""
    publish = F.col("source_kind") == "decoy" if publish_passwords is None else publish_passwords
    ssh = F.col("kind") == SSH
    pair = lambda name, value, when=None: F.when(
        value.isNotNull() if when is None else when,
        F.struct(F.lit(name).alias("dimension"), value.alias("value")),
    )
    return F.array_compact(
        F.array(
            pair("sources", F.concat_ws("/", "source_id", "source_epoch")),
            pair("source_ips", F.col("source_ip")),
            pair("usernames", F.col("username"), ssh),
            pair("passwords", F.col("password"), ssh & publish & holds(F.col("password") != "")),
            pair("paths", F.col("path"), ~ssh),
        )
    )


def period_dimensions(
    buckets: DataFrame, arrival: list[str] | None = None, granularities: tuple[str, ...] = GRANULARITIES
) -> DataFrame:
    """Counts per (granularity, period_start, dimension, value).

    Two grouped sums: per hour first, where nearly all reduction happens,
    then the requested granularities from the reduced rows. With ``arrival`` (order
    columns) each value also carries the earliest position it arrived at.
    """
    order = F.min(F.struct(*arrival)).alias("arrival") if arrival else None
    hourly = (
        buckets.withColumn("_d", F.explode(dimension_values()))
        .groupBy("hour", "_d.dimension", "_d.value")
        .agg(F.sum("n").alias("count"), *([order] if arrival else []))
    )
    return (
        _in_all_periods(hourly, granularities)
        .groupBy(*VALUE)
        .agg(F.sum("count").alias("count"), *([F.min("arrival").alias("arrival")] if arrival else []))
    )


def _split_by_size(values: DataFrame, keys: list[str], cap: int) -> tuple[DataFrame, DataFrame]:
    """(groups with at most ``cap`` rows, larger groups). Only the larger ones
    need ranking; the list of them is one row per group."""
    large = values.groupBy(*keys).count().where(F.col("count") > cap).select(*keys)
    return values.join(large, keys, "left_anti"), values.join(large, keys, "left_semi")


def cap_dimension(
    counts: DataFrame, cap: int = LIMITS.dimension_values, held: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """A report of the first ``cap`` values of each dimension to arrive, values
    already held first. Returns (shown counts, overflow per dimension): what is
    not shown adds to the overflow, so totals stay exact. The state itself
    keeps every value.
    """
    fresh = counts.withColumn("_new", F.lit(1))
    if held is not None:
        kind = counts.schema["arrival"].dataType
        old = held.select(*VALUE, "count").withColumn("arrival", F.lit(None).cast(kind)).withColumn("_new", F.lit(0))
        fresh = fresh.unionByName(old)
    values = fresh.groupBy(*VALUE).agg(
        F.sum("count").alias("count"), F.min("_new").alias("_new"), F.min("arrival").alias("arrival")
    )
    small, large = _split_by_size(values, DIMENSION, cap)
    # Held values precede all others; among them the order does not matter.
    order = [F.col("_new"), F.col("arrival"), F.col("value")]
    top = bounded_top(large, DIMENSION, order, cap, salt_on=VALUE)
    kept = small.unionByName(top).select(*VALUE, "count")
    return kept, overflow_of(values, kept)


def overflow_of(values: DataFrame, kept: DataFrame) -> DataFrame:
    """Per dimension, the count that ``kept`` lost against ``values``: one
    grouped sum over both, signed."""
    return (
        values.select(*DIMENSION, "count")
        .unionByName(kept.select(*DIMENSION, (-F.col("count")).alias("count")))
        .groupBy(*DIMENSION)
        .agg(F.sum("count").alias("overflow"))
        .where(F.col("overflow") > 0)
    )


def merge_state(*tables: DataFrame) -> DataFrame:
    """Fold count tables of one shape (totals, counts or overflow)."""
    first = tables[0]
    number = next(c for c in ("total", "count", "overflow") if c in first.columns)
    keys = [c for c in first.columns if c != number]
    union = first
    for table in tables[1:]:
        union = union.unionByName(table)
    return union.groupBy(*keys).agg(F.sum(number).alias(number))


def by_count() -> list[Column]:
    return [F.col("count").desc(), F.col("value").asc()]


def trim_periods(
    counts: DataFrame,
    now: Column,
    keep: int = LIMITS.public_values,
    retention_days: int = LIMITS.period_retention_days,
) -> tuple[DataFrame, DataFrame]:
    """A report with bounded old periods: hourly periods that ended before the
    retention are gone, others show their top values. Returns (counts, overflow
    of what is not shown). The state itself keeps every value of a period."""
    end = period_end(F.col("granularity"), F.col("period_start"))
    old = end < now - days(retention_days)
    current = counts.where(~old)
    coarse = counts.where(old & (F.col("granularity") != "hourly"))
    small, large = _split_by_size(coarse, DIMENSION, keep)
    top = bounded_top(large, DIMENSION, by_count(), keep, salt_on=VALUE)
    kept = small.unionByName(top)
    return current.unionByName(kept), overflow_of(coarse, kept)


def drop_expired_hours(
    table: DataFrame, now: Column, retention_days: int = LIMITS.period_retention_days
) -> DataFrame:
    """The same rule for totals and overflow of expired hourly periods."""
    end = period_end(F.col("granularity"), F.col("period_start"))
    return table.where(~((F.col("granularity") == "hourly") & (end < now - days(retention_days))))


def count_guard(table: DataFrame, column: str) -> DataFrame:
    """Fail the job when a count leaves the safe integer range."""
    too_large = F.raise_error(F.lit("rollup count exceeds the safe JSON integer limit")).cast("bigint")
    return table.withColumn(
        column, F.when(F.col(column) > LIMITS.safe_integer, too_large).otherwise(F.col(column))
    )


def top_n(counts: DataFrame, n: int = LIMITS.public_values) -> DataFrame:
    """Published values: highest counts first, value ascending on ties, with
    ``rank``. The sources dimension is published whole elsewhere."""
    ranked = counts.where(F.col("dimension") != "sources")
    return bounded_top(ranked, DIMENSION, by_count(), n, salt_on=VALUE, rank="rank")


def published_values(counts: DataFrame, n: int = LIMITS.public_values) -> tuple[DataFrame, DataFrame]:
    """(top values with rank, overflow per period and dimension): shown and
    overflow add up to all that was counted."""
    shown = top_n(counts, n)
    return shown, overflow_of(counts.where(F.col("dimension") != "sources"), shown)


def label_sources(counts: DataFrame, heads: DataFrame) -> DataFrame:
    """Sensor totals with their kind; unknown sensors count as hosts."""
    kinds = heads.select(
        F.concat_ws("/", "source_id", "source_epoch").alias("value"), F.col("kind").alias("_kind")
    )
    parts = F.split("value", "/", 2)
    return (
        counts.where((F.col("dimension") == "sources") & F.contains("value", F.lit("/")))
        .join(kinds, "value", "left")
        .select(
            *PERIOD,
            F.get(parts, F.lit(0)).alias("source_id"),
            F.get(parts, F.lit(1)).alias("source_epoch"),
            F.coalesce(F.nullif("_kind", F.lit("")), F.lit("host")).alias("kind"),
            "count",
        )
    )


def order_sources(labelled: DataFrame) -> DataFrame:
    """All sensors of each period in published order, with ``rank``. A group
    is one period's sensors, bounded by the registry."""
    order = Window.partitionBy(*PERIOD).orderBy(F.col("count").desc(), "source_id", "source_epoch")
    return labelled.withColumn("rank", F.row_number().over(order))


