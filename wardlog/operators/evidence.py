"""Deny-list evidence: qualifying events, folding, expiry and the lists.

Evidence facts are one row per (list key, sensor, day) with the end of the
latest qualifying hour; the nested record is a view of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.config import LIMITS
from wardlog.functions.addresses import deny_key, ip_number
from wardlog.functions.times import days, hours, utc_date
from wardlog.operators.classify import SSH
from wardlog.operators.networks import excluded_prefix_anti_join
from wardlog.operators.ranking import text_digits, threshold_top
from wardlog.session import cut_lineage

FACT = ["key", "source_id", "day"]


def with_deny_key(buckets: DataFrame) -> DataFrame:
    return buckets.withColumn("key", deny_key(F.col("source_ip")))


def host_multi_username(buckets: DataFrame, batch: list[str]) -> DataFrame:
    """Host SSH slots (batch, key, hour) with at least two usernames. Two
    different names exist exactly when the smallest differs from the largest:
    constant state per slot instead of a distinct set."""
    return (
        buckets.where((F.col("source_kind") == "host") & (F.col("kind") == SSH))
        .groupBy(*batch, "source_id", "key", "hour")
        .agg(F.min("username").alias("_lo"), F.max("username").alias("_hi"))
        .where(F.col("_lo") < F.col("_hi"))
        .select("key", "source_id", "hour")
    )


def qualifying_events(buckets: DataFrame, batch: list[str]) -> DataFrame:
    """Distinct (key, source_id, hour): anything a decoy saw, any HTTP probe,
    and the host SSH slots above. ``batch`` names the columns of a batch's
    identity besides source_id, because the username rule counts per batch.

    One pass: all three rules are aggregates of a (batch, key, hour) slot.
    """
    host_ssh = (F.col("source_kind") == "host") & (F.col("kind") == SSH)
    name = F.when(host_ssh, F.col("username"))
    return (
        buckets.groupBy(*batch, "source_id", "key", "hour")
        .agg(
            F.max(~host_ssh).alias("_direct"), F.min(name).alias("_lo"), F.max(name).alias("_hi")
        )
        .where(F.col("_direct") | (F.col("_lo") < F.col("_hi")))
        .select("key", "source_id", "hour")
    )


def evidence_facts(events: DataFrame) -> DataFrame:
    return events.groupBy("key", "source_id", utc_date(F.col("hour")).alias("day")).agg(
        (F.max("hour") + hours(1)).alias("last_seen")
    )


def merge_evidence(*facts: DataFrame) -> DataFrame:
    union = facts[0]
    for table in facts[1:]:
        union = union.unionByName(table)
    return union.groupBy(*FACT).agg(F.max("last_seen").alias("last_seen"))


def nest_evidence(facts: DataFrame, max_days: int = LIMITS.deny_days) -> DataFrame:
    """The published record: last_seen, the newest days, latest day per sensor.
    A key's days are bits of 32-day blocks, folded over all sensors before
    anything is listed; sensors come as one row each."""
    number = F.unix_date("day")
    days_of = facts.groupBy("key", F.floor(number / 32).cast("int").alias("block")).agg(
        F.max("last_seen").alias("last_seen"), F.bit_or(_bit(F.pmod(number, F.lit(32)))).alias("bits")
    )
    sensors = facts.groupBy("key", "source_id").agg(F.max("day").alias("latest"))
    both = days_of.select("key", "last_seen", F.struct("block", "bits").alias("b"), F.lit(None).cast("struct<source_id:string,latest:date>").alias("s"))
    both = both.unionByName(sensors.select("key", F.struct("source_id", "latest").alias("s")), allowMissingColumns=True)
    per_key = both.groupBy("key").agg(
        F.max("last_seen").alias("last_seen"),
        F.array_sort(F.collect_list("b")).alias("_blocks"),
        F.map_from_entries(F.array_sort(F.collect_list("s"))).alias("sources"),
    )
    set_days = lambda b: F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.getbit(b["bits"], i) == 1),
        lambda i: F.date_from_unix_date(b["block"] * 32 + i),
    )
    all_days = F.flatten(F.transform("_blocks", set_days))
    newest = F.slice(all_days, F.greatest(F.size(all_days) - max_days, F.lit(0)) + 1, F.lit(max_days))
    return per_key.select("key", "last_seen", newest.alias("days"), "sources")


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), position.cast("int"))


def deny_evidence(events: DataFrame) -> DataFrame:
    """Qualifying events to nested evidence records."""
    return nest_evidence(evidence_facts(events))


def prune_evidence(facts: DataFrame, now: Column) -> DataFrame:
    """Drop keys last seen 30 days ago or earlier, and older days. A key whose
    last hour is inside the window has that hour's day inside it too, so one
    row filter is equivalent; the key test only matters for the boundary."""
    cutoff = now - days(LIMITS.persistent_days)
    alive = facts.groupBy("key").agg(F.max("last_seen").alias("_last")).where(F.col("_last") > cutoff)
    recent = facts.where(F.col("day") >= utc_date(cutoff))
    return recent.join(alive.select("key"), "key", "left_semi")


def cap_evidence(facts: DataFrame, limit: int = LIMITS.deny_records) -> DataFrame:
    """A report of the ``limit`` keys seen last; on a tie the smaller key goes.
    The stored evidence keeps every key until it expires. Hours and the first
    bytes of keys are counted (a last hour ends on the hour, so there are few),
    only the keys at the edge are ranked."""
    keys = facts.groupBy("key").agg(F.max("last_seen").alias("_last"))
    digits = [F.unix_micros("_last"), *text_digits(F.col("key"), 2)]
    kept = threshold_top(keys, digits, [F.col("_last").desc(), F.col("key").desc()], limit, salt_on=["key"])
    return facts.join(kept.select("key"), "key", "left_semi")


def deny_order() -> list[Column]:
    """IPv4 before IPv6, numeric within a family (BINARY compares by byte)."""
    return [F.col("family"), F.col("addr")]


def build_deny_lists(
    facts: DataFrame, now: Column, never: DataFrame | None = None
) -> DataFrame:
    """Entries (list, key, timeout_s, family, addr) of both lists at ``now``.

    recent: seen within 72 hours. persistent: seen within 30 days by two
    sensors or on three days inside that window.
    """
    cutoff_day = utc_date(now - days(LIMITS.persistent_days))
    per_source_day = facts.withColumn("_in", F.col("day") >= cutoff_day)
    # One row per key from here on, far fewer than events: stored once, since
    # the address expressions below are long to plan over a long query.
    # Days inside the window are bits: the window has 31, and what comes after
    # it shares the last bit, as acceptance refuses hours that are yet to come.
    day = F.least(F.date_diff("day", cutoff_day), F.lit(62))
    per_key = per_source_day.groupBy("key").agg(
        F.max("last_seen").alias("last_seen"),
        F.bit_count(F.bit_or(F.when(F.col("_in"), _bit(day)))).alias("_days"),
        F.min(F.when(F.col("_in"), F.col("source_id"))).alias("_first"),
        F.max(F.when(F.col("_in"), F.col("source_id"))).alias("_second"),
    )
    recent_end = F.col("last_seen") + hours(LIMITS.recent_hours)
    persistent_end = F.col("last_seen") + days(LIMITS.persistent_days)
    # "Two sensors" holds exactly when the smallest id differs from the largest.
    proven = (F.col("_first") < F.col("_second")) | (F.col("_days") >= LIMITS.persistent_min_days)
    left = lambda end: F.ceil((F.unix_micros(end) - F.unix_micros(now)) / 1_000_000).cast("bigint")
    entries = F.array_compact(
        F.array(
            F.when(
                recent_end > now,
                F.struct(F.lit("recent").alias("list"), left(recent_end).alias("timeout_s")),
            ),
            F.when(
                (persistent_end > now) & proven,
                F.struct(F.lit("persistent").alias("list"), left(persistent_end).alias("timeout_s")),
            ),
        )
    )
    listed = (
        excluded_prefix_anti_join(cut_lineage(per_key), never)
        .withColumn("_e", F.explode(entries))
        .withColumn("_a", ip_number(F.substring_index("key", "/", 1)))
    )
    return listed.select("_e.list", "key", "_e.timeout_s", "_a.family", "_a.addr")
