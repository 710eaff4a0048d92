"""Validators. Each adds ``reject_reason``: the first violated rule or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.config import LIMITS, NAMES, WireNames
from wardlog.functions.addresses import deny_key, is_canonical_ip
from wardlog.functions.binding import bind
from wardlog.functions.text import (
    bounded_text,
    first_reason,
    hex_digest,
    holds,
    safe_file_name,
    valid_identity,
    valid_rule_ids,
    valid_sequence,
)
from wardlog.functions.times import days, hour_of, strict_utc
from wardlog.operators.canonical import transport_payload
from wardlog.operators.classify import HTTP, SSH


def observation_reason(c, schema_version: Column | None, names: WireNames = NAMES) -> Column:
    """First violated rule of an observation. ``c`` maps a field name to its
    column; observed_at is RFC 3339 text, ssh and http are structs."""
    ssh, http = c("ssh"), c("http")
    rules = []
    if schema_version is not None:
        rules.append((~holds(schema_version == names.schema("observation")), "schema_version"))
    rules += [
        (~bounded_text(c("event_id"), LIMITS.event_id_bytes), "event_id"),
        (~bounded_text(c("cursor"), LIMITS.cursor_bytes), "cursor"),
        (strict_utc(c("observed_at")).isNull(), "observed_at"),
        (~is_canonical_ip(c("source_ip")), "source_ip"),
        (~holds(c("kind").isin(SSH, HTTP)), "kind"),
        ((c("kind") == SSH) & (ssh.isNull() | http.isNotNull()), "ssh_payload"),
        ((c("kind") == SSH) & ~bounded_text(ssh["username"], LIMITS.username_bytes), "username"),
        (
            (c("kind") == SSH)
            & holds(ssh["password"] != "")
            & ~bounded_text(ssh["password"], LIMITS.password_bytes),
            "password",
        ),
        ((c("kind") == HTTP) & (http.isNull() | ssh.isNotNull()), "http_payload"),
        ((c("kind") == HTTP) & ~bounded_text(http["request_target"], LIMITS.path_bytes), "request_target"),
        ((c("kind") == HTTP) & ~holds(http["status"].between(100, 599)), "status"),
    ]
    return first_reason(*rules)


def validate_observations(observations: DataFrame, names: WireNames = NAMES) -> DataFrame:
    return observations.withColumn(
        "reject_reason", observation_reason(F.col, F.col("schema_version"), names)
    )


def _at(col: Column) -> Column:
    """Comparable instant of a parsed time: microseconds, then nanoseconds."""
    return F.struct(col["ts"].alias("ts"), col["nanos"].alias("nanos"))


def _instant(ts: Column) -> Column:
    return F.struct(ts.alias("ts"), F.lit(0).alias("nanos"))


def record_reason(r: Column, start: Column, end: Column) -> Column:
    """First violated rule of one record inside the window [start, end), whose
    bounds are parsed time structs."""
    optional = lambda name: F.coalesce(r[name], F.lit(""))
    count_ok = lambda n: holds(n.between(1, LIMITS.safe_integer))
    buckets = r["hourly_buckets"]

    def rules(t: Column) -> Column:
        """All rules with the record's times parsed once."""
        first, last, h = t["first"], t["last"], t["hours"]
        aligned = lambda x: holds(_at(x) == _instant(hour_of(x["ts"])))
        inside = lambda x: holds((x["ts"] >= hour_of(start["ts"])) & (_at(x) < _at(end)))
        # A forged count must not overflow the job: the sum turns null instead.
        total = F.aggregate(buckets, F.lit(0).cast("bigint"), lambda s, b: F.try_add(s, b["count"]))
        ascending = F.forall(
            F.sequence(F.lit(1), F.size(h)),
            lambda i: (i == 1) | (F.get(h, i - 2)["ts"] < F.get(h, i - 1)["ts"]),
        )
        return first_reason(
            (~is_canonical_ip(r["source_ip"]), "source_ip"),
            (~count_ok(r["count"]), "count"),
            (~holds(r["kind"].isin(SSH, HTTP)), "kind"),
            ((r["kind"] == SSH) & ((optional("username") == "") | (optional("path") != "")), "ssh_fields"),
            ((r["kind"] == SSH) & ~bounded_text(r["username"], LIMITS.username_bytes), "username"),
            (
                (r["kind"] == SSH)
                & (optional("password") != "")
                & ~bounded_text(r["password"], LIMITS.password_bytes),
                "password",
            ),
            (
                (r["kind"] == HTTP)
                & ((optional("path") == "") | (optional("username") != "") | (optional("password") != "")),
                "http_fields",
            ),
            ((r["kind"] == HTTP) & ~bounded_text(r["path"], LIMITS.path_bytes), "path"),
            (first.isNull(), "first_observed_at"),
            (last.isNull(), "last_observed_at"),
            (_at(last) < _at(first), "time_order"),
            ((_at(first) < _at(start)) | (_at(last) >= _at(end)), "time_window"),
            (~holds(F.size(buckets).between(1, LIMITS.hourly_buckets)), "bucket_number"),
            (F.exists(h, lambda x: x.isNull()), "bucket_hour"),
            (~F.forall(h, aligned), "bucket_alignment"),
            (~F.forall(h, inside), "bucket_window"),
            (~holds(ascending), "bucket_order"),
            (~F.forall(buckets, lambda b: count_ok(b["count"])), "bucket_count"),
            (~holds(total == r["count"]), "bucket_total"),
            (~holds(F.get(h, F.lit(0))["ts"] == hour_of(first["ts"])), "first_bucket"),
            (~holds(F.element_at(h, -1)["ts"] == hour_of(last["ts"])), "last_bucket"),
            (~valid_rule_ids(r["rule_ids"]), "rule_ids"),
        )

    parsed = F.struct(
        strict_utc(r["first_observed_at"]).alias("first"),
        strict_utc(r["last_observed_at"]).alias("last"),
        F.transform(buckets, lambda b: strict_utc(b["hour"])).alias("hours"),
    )
    return bind(parsed, rules)


def validate_records(records: DataFrame) -> DataFrame:
    """Records in flat rows, with window_start and window_end as text."""
    r = F.struct(*[F.col(n).alias(n) for n in records.columns if n not in ("window_start", "window_end")])
    bound = F.struct(
        r.alias("r"),
        strict_utc(F.col("window_start")).alias("s"),
        strict_utc(F.col("window_end")).alias("e"),
    )
    reason = bind(bound, lambda v: record_reason(v["r"], v["s"], v["e"]))
    return records.withColumn("reject_reason", reason)


def _sort_key(r: Column) -> Column:
    value = F.when(r["kind"] == HTTP, r["path"]).otherwise(r["username"])
    return F.struct(
        r["kind"].alias("kind"),
        r["source_ip"].alias("source_ip"),
        F.coalesce(value, F.lit("")).alias("value"),
        F.coalesce(r["password"], F.lit("")).alias("password"),
        r["first_observed_at"].alias("first_observed_at"),
        F.array_join(r["rule_ids"], "\x1f").alias("rules"),
    )


def payload_reason(p: Column, names: WireNames = NAMES) -> Column:
    """First violated rule of a payload, down to its records. A batch is one
    row of at most 1 MiB, so its records are judged in place."""
    times = F.struct(
        strict_utc(p["observation_window"]["start"]).alias("start"),
        strict_utc(p["observation_window"]["end"]).alias("end"),
    )
    previous = F.coalesce(p["previous_batch_hash"], F.lit(""))

    def rules(t: Column) -> Column:
        start, end = t["start"], t["end"]
        latest = F.struct((start["ts"] + days(LIMITS.window_days)).alias("ts"), start["nanos"].alias("nanos"))
        faulty = F.exists(p["records"], lambda r: record_reason(r, start, end).isNotNull())
        return first_reason(
            (~holds(p["schema_version"] == names.schema("batch")), "schema_version"),
            (~valid_identity(p["source_id"], p["source_epoch"]), "identity"),
            (~valid_sequence(p["sequence"]), "sequence"),
            ((p["sequence"] == "0") & (previous != ""), "previous_batch_hash"),
            ((p["sequence"] != "0") & ~hex_digest(previous, 64), "previous_batch_hash"),
            (strict_utc(p["created_at"]).isNull(), "created_at"),
            (start.isNull() | end.isNull(), "window_time"),
            (~holds(_at(start) < _at(end)), "window_empty"),
            (_at(end) > latest, "window_length"),
            (
                ~holds(F.octet_length(p["classifier_version"]).between(1, LIMITS.classifier_bytes)),
                "classifier_version",
            ),
            (~holds(F.size(p["records"]).between(1, LIMITS.batch_records)), "record_number"),
            (faulty, "record"),
            (~holds(bind(F.transform(p["records"], _sort_key), _ascending)), "record_order"),
            (F.octet_length(transport_payload(p)) > LIMITS.batch_bytes, "payload_size"),
        )

    return bind(times, rules)


def _ascending(keys: Column) -> Column:
    return F.forall(
        F.sequence(F.lit(1), F.size(keys)), lambda i: (i == 1) | (F.get(keys, i - 2) < F.get(keys, i - 1))
    )


def validate_payloads(batches: DataFrame, names: WireNames = NAMES) -> DataFrame:
    return batches.withColumn("reject_reason", payload_reason(F.col("payload"), names))


def central_timing(window_end: Column, created_at: Column, now: Column) -> Column:
    """True when a batch's parsed times are acceptable centrally."""
    skew = F.expr(f"INTERVAL {LIMITS.clock_skew_minutes} MINUTE")
    both = F.struct(window_end.alias("end"), created_at.alias("created"))
    return holds(
        bind(both, lambda t: (_at(t["end"]) <= _at(t["created"])) & (_at(t["created"]) <= _instant(now + skew)))
    )


def quarantine_reason(batches: DataFrame) -> DataFrame:
    """Ordered first failure, from condition columns computed upstream:
    size_ok, envelope_ok, registered (null when no registration matched),
    enabled, key_ok, name_ok, signature_ok, time_ok."""
    ok = lambda name: holds(F.col(name))
    return batches.withColumn(
        "reason",
        first_reason(
            (~ok("size_ok"), "invalid_size"),
            (~ok("envelope_ok"), "invalid_envelope"),
            (~(ok("registered") & ok("enabled")), "unregistered_source"),
            (~ok("key_ok"), "unregistered_key"),
            (~ok("name_ok"), "invalid_blob_name"),
            (~ok("signature_ok"), "invalid_signature"),
            (~ok("time_ok"), "invalid_time"),
        ),
    )


def quarantine_entries(rejected: DataFrame) -> DataFrame:
    """Published form of rejects: a report of the first in scan order, sorted.
    All of them are in the committed table of rejects."""
    return (
        rejected.select(
            safe_file_name(F.col("file")).alias("file"), "sha256", "bytes", "reason", F.col("file").alias("_scan")
        )
        .orderBy("_scan")
        .limit(LIMITS.quarantine_entries)
        .orderBy("file")
        .drop("_scan")
    )


def state_violations(
    totals: DataFrame, counts: DataFrame, evidence: DataFrame, records: DataFrame | None = None
) -> DataFrame:
    """Violated invariants of stored tables as (check, violations) rows.
    Aggregations only; ``validate_state`` turns a non-zero row into an error."""
    safe = lambda c: holds(F.col(c).between(1, LIMITS.safe_integer))
    named = lambda df, name, bad: df.select(
        F.lit(name).alias("check"), F.sum(F.when(bad, 1).otherwise(0)).cast("bigint").alias("violations")
    ).select("check", F.coalesce("violations", F.lit(0).cast("bigint")).alias("violations"))
    key_ok = holds(deny_key(F.substring_index("key", "/", 1)) == F.col("key"))
    return (
        named(totals, "period_total", ~safe("total"))
        .unionByName(named(counts, "dimension_count", ~safe("count")))
        .unionByName(named(counts, "dimension_value", ~holds(F.col("value") != "")))
        .unionByName(named(evidence, "evidence_key", ~key_ok))
        .unionByName(named(evidence, "evidence_source", ~holds(F.col("source_id") != "")))
        .unionByName(
            named(evidence, "evidence_time", ~holds(F.col("last_seen") == hour_of(F.col("last_seen"))))
        )
    )


def validate_state(totals: DataFrame, counts: DataFrame, evidence: DataFrame) -> None:
    bad = state_violations(totals, counts, evidence).where("violations > 0").collect()
    if bad:
        raise ValueError("stored state is invalid: " + ", ".join(sorted(r.check for r in bad)))


