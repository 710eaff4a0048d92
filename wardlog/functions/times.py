"""Time: RFC 3339 with nanoseconds, and rollup periods.

TIMESTAMP holds microseconds, so parsed times keep their full fraction in a
separate ``nanos`` field and their text in normal form. Everything is UTC,
whatever the session's time zone: nothing here formats, parses or truncates in
that zone.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlog.functions.binding import bind

RFC3339 = r"\A(\d{4}-\d{2}-\d{2})T(\d{1,2}):(\d{2}:\d{2})(?:[.,](\d+))?(Z|[+-]\d{2}:\d{2})\z"

GRANULARITIES = ("hourly", "daily", "monthly", "yearly")
# Length of a period's label, a prefix of its start's UTC text.
LABEL_LENGTH = {"hourly": 20, "daily": 10, "monthly": 7, "yearly": 4}
# What completes a label to the text of the period's start.
LABEL_REST = {"hourly": "", "daily": "T00:00:00Z", "monthly": "-01T00:00:00Z", "yearly": "-01-01T00:00:00Z"}
MONTHS = {"monthly": 1, "yearly": 12}


def utc_wall(ts: Column) -> Column:
    """The UTC clock at an instant, as TIMESTAMP_NTZ."""
    seconds = (F.unix_micros(ts).cast("decimal(18,0)") * F.lit(Decimal("0.000001"))).cast("decimal(18,6)")
    zero = F.lit(0)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds)


def utc_date(ts: Column) -> Column:
    """The UTC date of an instant."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / 86_400).cast("int"))


def utc_midnight(date: Column) -> Column:
    """The instant at which a date begins in UTC."""
    return F.timestamp_seconds(F.unix_date(date).cast("bigint") * 86_400)


def parse_rfc3339(col: Column) -> Column:
    """STRUCT<ts TIMESTAMP, nanos INT, text STRING> in UTC, or null.

    ``ts`` is truncated to microseconds, ``nanos`` is the whole fraction of
    the second, ``text`` is the UTC form without trailing zeros.
    """
    names = ("date", "hour", "rest", "fraction", "zone")
    parts = F.struct(*[F.regexp_extract(col, RFC3339, i + 1).alias(n) for i, n in enumerate(names)])

    def instant(p: Column) -> Column:
        local = F.try_to_timestamp(
            F.concat(p["date"], F.lit(" "), F.lpad(p["hour"], 2, "0"), F.lit(":"), p["rest"], F.lit("Z")),
            F.lit("yyyy-MM-dd HH:mm:ssX"),
        )
        zone_hours = F.substring(p["zone"], 2, 2).try_cast("int")
        zone_minutes = F.substring(p["zone"], 5, 2).try_cast("int")
        offset = F.when(p["zone"] == "Z", F.lit(0)).when(
            (zone_hours <= 24) & (zone_minutes < 60),
            F.when(p["zone"].startswith("-"), F.lit(-1)).otherwise(F.lit(1))
            * (zone_hours * 3600 + zone_minutes * 60),
        )
        return F.struct(
            (F.unix_seconds(local) - offset).alias("seconds"),
            F.rpad(F.substring(p["fraction"], 1, 9), 9, "0").alias("digits"),
            F.regexp_replace(F.substring(p["fraction"], 1, 9), r"0+\z", "").alias("shown"),
        )

    def parsed(t: Column) -> Column:
        micros = F.substring(t["digits"], 1, 6).try_cast("bigint")
        return F.when(
            t["seconds"].isNotNull(),
            F.struct(
                F.timestamp_micros(t["seconds"] * 1_000_000 + micros).alias("ts"),
                t["digits"].try_cast("int").alias("nanos"),
                F.concat(
                    F.substring(utc_text(F.timestamp_seconds(t["seconds"])), 1, 19),
                    F.when(t["shown"] != "", F.concat(F.lit("."), t["shown"])).otherwise(F.lit("")),
                    F.lit("Z"),
                ).alias("text"),
            ),
        )

    return bind(bind(parts, instant), parsed)


def utc_timestamp(col: Column) -> Column:
    """RFC 3339 with any offset to its UTC text, or null."""
    return parse_rfc3339(col)["text"]


def strict_utc(col: Column) -> Column:
    """Parsed struct for RFC 3339 with a literal Z, otherwise null."""
    return F.when(col.endswith("Z"), parse_rfc3339(col))


def utc_text(ts: Column) -> Column:
    """TIMESTAMP to RFC 3339 UTC text without trailing zeros."""
    return F.concat(F.translate(utc_wall(ts).cast("string"), " ", "T"), F.lit("Z"))


def utc_stamp(ts: Column) -> Column:
    """The same to the second."""
    return F.concat(F.substring(utc_text(ts), 1, 19), F.lit("Z"))


def hour_of(ts: Column) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / 3_600) * 3_600)


def hours(n: int) -> Column:
    return F.expr(f"INTERVAL '{n}' HOUR")


def days(n: int) -> Column:
    """24-hour days: windows are exact durations, not calendar steps."""
    return hours(24 * n)


def period_start(granularity: str, ts: Column) -> Column:
    if granularity == "hourly":
        return hour_of(ts)
    date = utc_date(ts)
    return utc_midnight(date if granularity == "daily" else F.trunc(date, "month" if granularity == "monthly" else "year"))


def period_label(granularity: Column, start: Column) -> Column:
    text = utc_stamp(start)
    label = None
    for name in GRANULARITIES:
        cut = F.substring(text, 1, LABEL_LENGTH[name])
        label = F.when(granularity == name, cut) if label is None else label.when(granularity == name, cut)
    return label


def parse_period(granularity: Column, label: Column) -> Column:
    """Start of a labelled period, null when the label does not parse."""
    start = None
    for name in GRANULARITIES:
        text = F.concat(label, F.lit(LABEL_REST[name]))
        whole = F.when(F.length(label) == LABEL_LENGTH[name], F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssX")))
        start = F.when(granularity == name, whole) if start is None else start.when(granularity == name, whole)
    return start


def period_end(granularity: Column, start: Column) -> Column:
    later = lambda name: utc_midnight(F.add_months(utc_date(start), MONTHS[name]))
    return (
        F.when(granularity == "hourly", start + hours(1))
        .when(granularity == "daily", start + hours(24))
        .when(granularity == "monthly", later("monthly"))
        .when(granularity == "yearly", later("yearly"))
    )


def period_bounds(granularity: Column, label: Column) -> Column:
    """STRUCT<start, end> of a labelled period, half-open."""
    start = parse_period(granularity, label)
    return F.struct(start.alias("start"), period_end(granularity, start).alias("end"))
