"""The central step: envelopes in, folded state and published outputs out."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.config import LIMITS, NAMES, WireNames
from wardlog.functions.text import holds, sequence_number
from wardlog.functions.times import days, parse_rfc3339, strict_utc
from wardlog.operators.acceptance import (
    LANES,
    accept_chain,
    audit_chain,
    join_registry,
    mark_replays,
    moved_chains,
    refresh_kinds,
    verify_chain,
    verify_run,
    with_digests,
)
from wardlog.operators.canonical import decode_batches, verify_signatures
from wardlog.operators.evidence import (
    build_deny_lists,
    evidence_facts,
    merge_evidence,
    prune_evidence,
    qualifying_events,
    with_deny_key,
)
from wardlog.operators.rollup import (
    count_guard,
    drop_expired_hours,
    merge_state,
    period_dimensions,
    period_totals,
    record_buckets,
)
from wardlog.operators.validate import (
    central_timing,
    payload_reason,
    quarantine_entries,
    quarantine_reason,
    validate_state,
)
from wardlog.sinks import state as store
from wardlog.sinks.documents import write_deny_lists, write_manifest, write_quarantine, write_rollups

SENSOR = ["source_id", "source_epoch"]


@dataclass(frozen=True)
class IngestResult:
    version: int
    accepted: int
    replayed: int
    quarantined: int


def check_envelopes(files: DataFrame, registry: DataFrame, now: str, names: WireNames = NAMES) -> DataFrame:
    """Files (file, bytes, content) with identity, payload and the first
    failing ``reason``. One narrow pass: signatures, the one costly check, are
    verified only for rows that passed the others that precede it."""
    p = F.col("payload")
    decoded = decode_batches(files, names).select(
        "file",
        "bytes",
        "payload",
        "signature",
        "payload_hash",
        "blob_name",
        F.coalesce("envelope_sha256", F.sha2(F.lit(b""), 256)).alias("sha256"),
        p["source_id"].alias("source_id"),
        p["source_epoch"].alias("source_epoch"),
        p["sequence"].alias("sequence"),
        p["previous_batch_hash"].alias("previous_batch_hash"),
        p["created_at"].alias("created_at"),
        F.col("content").isNotNull().alias("size_ok"),
        (p.isNotNull() & payload_reason(p, names).isNull()).alias("envelope_ok"),
    )
    instant = F.lit(now).cast("timestamp")
    joined = join_registry(decoded, registry)
    conditions = joined.withColumns(
        {
            "key_ok": holds(F.col("signature.key_id") == F.col("registered_key_id")),
            "name_ok": holds(
                F.col("blob_name").startswith(F.col("blob_prefix")) & (F.col("file") == F.col("blob_name"))
            ),
            "time_ok": central_timing(
                strict_utc(p["observation_window"]["end"]), strict_utc(F.col("created_at")), instant
            ),
            "signature_ok": F.lit(True),
        }
    )
    passed = F.col("reason").isNull() | (F.col("reason") == "invalid_time")
    verified = verify_signatures(quarantine_reason(conditions), names, when=passed)
    reason = F.when(passed & ~F.col("signature_valid"), "invalid_signature").otherwise(F.col("reason"))
    return verified.withColumn("reason", reason).drop(
        "size_ok", "envelope_ok", "key_ok", "name_ok", "time_ok", "signature_ok", "signature_valid"
    )


def decide(checked: DataFrame, state: store.State) -> DataFrame:
    """``status`` of every file: accepted, replay, or the quarantine reason.
    Only sequences behind their sensor's head can be stored already; without
    any, no accepted batch is read."""
    identity = ["file", "bytes", "sha256", *SENSOR, "sequence", "previous_batch_hash", "payload_hash", "blob_name"]
    valid = checked.where(F.col("reason").isNull()).select(*identity)
    at = state.heads.select(*SENSOR, sequence_number(F.col("next_sequence")).alias("_next"))
    placed = valid.join(at, SENSOR, "left").withColumn("_old", holds(sequence_number(F.col("sequence")) < F.col("_next"))).drop("_next")
    old, news = placed.where("_old").drop("_old"), placed.where("NOT _old").drop("_old")
    failed = checked.where(F.col("reason").isNotNull()).select(*identity, F.col("reason").alias("status"))
    if old.isEmpty():
        return accept_chain(news, state.heads).unionByName(failed)
    marked = mark_replays(old, state.accepted)
    settled = marked.where(F.col("status").isNotNull())
    news = news.unionByName(marked.where(F.col("status").isNull()).drop("status"))
    return settled.unionByName(accept_chain(news, state.heads)).unionByName(failed)


def check_state(state: store.State, audit: bool = False) -> None:
    """Refuse to build on a damaged state. What the last run wrote is checked
    against what it said; ``audit``, or a state without digests, reads all."""
    whole = audit or state.moved is None
    table = lambda n: state.tables[n] if whole else state.fresh.get(n, state.tables[n])
    validate_state(table("totals"), table("counts"), table("evidence"))
    if not whole:
        broken = verify_run(state.last, state.moved, state.heads)
    elif state.moved is None:
        broken = verify_chain(state.accepted)
    else:
        broken = audit_chain(state.accepted, state.heads)
    if found := broken.limit(1).collect():
        raise ValueError(f"stored chain of {found[0].source_id} is invalid: {found[0].violation}")


def next_heads(state: store.State, moved: DataFrame, registry: DataFrame) -> DataFrame:
    """Chain heads after the run, with the digest of all stored batches, labelled
    with the registry's current kinds."""
    held = state.heads if state.moved is not None or not state.version else with_digests(state.heads, state.accepted)
    before = held.select(*SENSOR, *[F.col(c).alias(f"_{c}") for c in LANES])
    sums = {c: (F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).cast("decimal(38,0)") for c in LANES}
    after = moved.join(before, SENSOR, "left").withColumns(sums).select(*held.columns)
    still = held.join(moved, SENSOR, "left_anti")
    return refresh_kinds(still.unionByName(after), registry)


def fold_rollups(state: store.State, buckets: DataFrame, now):
    """(totals, counts, overflow) after folding a run's buckets. Every value is
    kept; what a publication does not show is derived there. Only hourly
    periods expire. ``overflow`` carries on what an older state had spilled."""
    totals = drop_expired_hours(count_guard(merge_state(state.totals, period_totals(buckets)), "total"), now)
    counts = drop_expired_hours(count_guard(merge_state(state.counts, period_dimensions(buckets)), "count"), now)
    return totals, counts, drop_expired_hours(state.overflow, now)


def run_evidence(buckets: DataFrame) -> DataFrame:
    """The evidence that a run's buckets add."""
    return evidence_facts(qualifying_events(with_deny_key(buckets), ["source_epoch", "seq"]))


def fold_evidence(state: store.State, buckets: DataFrame, now) -> DataFrame:
    return prune_evidence(merge_evidence(state.evidence, run_evidence(buckets)), now)


# Reasons that a later run may find gone; any other is final.
HEALING = ("sequence_gap", "hash_chain_mismatch", "invalid_time", "unregistered_source", "unregistered_key")


def next_parked(files: DataFrame, refused: DataFrame, parked: DataFrame, now) -> DataFrame:
    """Refused files worth another try, with the time they were first parked;
    after 30 days they are given up, so a hostile sender cannot grow the state."""
    again = refused.where(F.col("status").isin(*HEALING)).select("file")
    known = parked.select("file", "since")
    rows = files.join(again, "file", "left_semi").join(known, "file", "left")
    return rows.withColumn("since", F.coalesce("since", now)).where(F.col("since") > now - days(LIMITS.persistent_days))


def run_ingest(
    spark: SparkSession,
    files: DataFrame,
    registry: DataFrame,
    root: str,
    now: str,
    run_key: str,
    names: WireNames = NAMES,
    outputs: str | None = None,
    manifest: str | None = None,
    retry_parked: bool = False,
    park: bool = False,
    check: bool = True,
) -> IngestResult | None:
    """One central run. ``now`` is RFC 3339 UTC text.

    Idempotent: a run key that is already committed does nothing and returns
    None. With ``park`` rejected files that may heal are kept in the state and,
    with ``retry_parked``, tried again, because a stream shows every file once while
    a batch run scans the input folder anew each time.
    """
    state = store.load_state(spark, root)
    if state.run_key == run_key:
        return None
    if check and state.version:
        check_state(state)
    version = state.version + 1
    instant = F.lit(now).cast("timestamp")
    if retry_parked:
        files = files.unionByName(state.parked.drop("since").join(files.select("file"), "file", "left_anti"))
    if park:
        files = store.stage(files, root, version, "files")
    checked = store.stage(check_envelopes(files, registry, now, names), root, version, "checked")
    statuses = store.stage(decide(checked, state), root, version, "statuses")
    won = statuses.where(F.col("status") == "accepted").select("file")
    batches = checked.where(F.col("reason").isNull()).join(won, "file", "left_semi")
    accepted = store.stage(
        batches.select(*SENSOR, F.col("source_kind").alias("kind"), "sequence", "payload_hash", "blob_name", "created_at"),
        root,
        version,
        "accepted",
    )
    # The one wide intermediate: records by hour, read by both folds.
    buckets = store.stage(
        record_buckets(batches), root, version, "buckets"
    )
    added = {"totals": period_totals(buckets), "counts": period_dimensions(buckets), "evidence": run_evidence(buckets)}
    parts = store.fold_parts(state, added, root, version, datetime.fromisoformat(now))
    folded = store.read_parts(spark, root, parts)
    # no value counts more than its period, so the totals guard both
    totals, counts = store.stage(count_guard(folded["totals"], "total"), root, version, "totals"), folded["counts"]
    write = lambda df, name: store.write_version(df, root, version, name)
    moved = moved_chains(accepted, state.heads)
    write(moved, "moved")
    heads = write(next_heads(state, moved, registry), "heads")
    refused = statuses.where(~F.col("status").isin("accepted", "replay"))
    write(next_parked(files, refused, state.parked, instant) if park else state.parked, "parked")
    store.append_accepted(accepted, root, version)
    store.append_rejects(refused.withColumn("reason", F.col("status")), root, version)

    created = F.col("created_at")
    newest = accepted.select(created, parse_rfc3339(created).alias("t")).agg(
        F.max_by("created_at", F.struct("t.ts", "t.nanos")).alias("at")
    ).first().at
    updated_at = _newer(spark, newest, state.updated_at)
    tally = {r.status: r["count"] for r in statuses.groupBy("status").count().collect()}
    if outputs:
        write_rollups(totals, counts, heads, updated_at, f"{outputs}/rollups", names)
        entries = quarantine_entries(refused.withColumn("reason", F.col("status")))
        write_quarantine(entries, now, updated_at, f"{outputs}/quarantine.json", names)
    # Before the pointer: a run that dies in between is made again and writes it again.
    if manifest:
        write_manifest(statuses, manifest, names)
    store.commit_state(spark, root, version, run_key, updated_at, parts, True)
    accepted_n, replayed_n = tally.get("accepted", 0), tally.get("replay", 0)
    return IngestResult(version, accepted_n, replayed_n, sum(tally.values()) - accepted_n - replayed_n)


def _newer(spark: SparkSession, candidate: str | None, current: str | None) -> str | None:
    if candidate is None or current is None:
        return candidate or current
    times = spark.range(1).select(
        parse_rfc3339(F.lit(candidate)).alias("a"), parse_rfc3339(F.lit(current)).alias("b")
    )
    newer = times.select(
        F.struct("a.ts", "a.nanos") > F.struct(F.col("b.ts").alias("ts"), F.col("b.nanos").alias("nanos"))
    ).first()[0]
    return candidate if newer else current


def publish_deny_lists(
    spark: SparkSession, root: str, now: str, directory: str, never: DataFrame | None = None,
    names: WireNames = NAMES, single_files: bool = True,
) -> None:
    """Render both lists from the committed state: parts with an index and, on
    request, the one file the parts make up."""
    state = store.load_state(spark, root)
    instant = F.lit(now).cast("timestamp")
    # parts expire by whole days; what is too old within the oldest day goes here
    lists = build_deny_lists(prune_evidence(state.evidence, instant), instant, never)
    if state.version:
        lists = store.stage(lists, root, state.version, "lists")
    write_deny_lists(lists, instant, directory, names, single_files)
