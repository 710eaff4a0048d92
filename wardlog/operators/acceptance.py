"""Acceptance of batches: registry, replays, hash chains, heads.

Candidates: source_id, source_epoch, sequence, previous_batch_hash,
payload_hash, blob_name. A sensor's chain is sequential by nature; here it is cut
into blocks of sequences. Each block says where every hash that can enter it
comes out, a scan over a sensor's blocks links these, and each block then judges
its own batches. So a sensor holding most of the batches is spread over the
cluster, and what passes one task is one row a block and entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.functions.text import blob_name, hex_digest, holds, sequence_number

SENSOR = ["source_id", "source_epoch"]
STEP = [*SENSOR, "seq"]


def join_registry(batches: DataFrame, registry: DataFrame) -> DataFrame:
    """Attach the registration; ``registered`` is null where there is none. The
    planner sees the registry's size and sends it along when it is small."""
    dimension = registry.select(
        *SENSOR,
        F.lit(True).alias("registered"),
        "enabled",
        F.col("kind").alias("source_kind"),
        F.col("key_id").alias("registered_key_id"),
        "public_key",
        "blob_prefix",
    )
    return batches.join(dimension, SENSOR, "left")


def mark_replays(candidates: DataFrame, accepted: DataFrame) -> DataFrame:
    """``status``: replay for a byte-identical resend, replay_conflict for
    other content at an accepted sequence, null for news."""
    known = accepted.select(
        *SENSOR, "sequence", F.col("payload_hash").alias("_hash"), F.col("blob_name").alias("_name")
    )
    same = (F.col("_hash") == F.col("payload_hash")) & (F.col("_name") == F.col("blob_name"))
    return (
        candidates.join(known, [*SENSOR, "sequence"], "left")
        .withColumn(
            "status",
            F.when(F.col("_hash").isNull(), F.lit(None).cast("string"))
            .when(same, "replay")
            .otherwise("replay_conflict"),
        )
        .drop("_hash", "_name")
    )


def chain_heads(accepted: DataFrame) -> DataFrame:
    """Next sequence and last hash per sensor."""
    seq = sequence_number(F.col("sequence"))
    return accepted.groupBy(*SENSOR).agg(
        (F.max(seq) + 1).cast("decimal(20,0)").cast("string").alias("next_sequence"),
        F.max_by("payload_hash", seq).alias("previous_hash"),
    )


#: Sequences of a block.
BLOCK = 1024
SEQUENCE = "decimal(20,0)"


def _block(seq: Column, size: int) -> Column:
    """First sequence of the block."""
    return (seq - seq % size).cast(SEQUENCE)


def _first_links(rows: Iterator[tuple]) -> dict[int, dict[str, str]]:
    """Per sequence, the hash of the first name to continue each previous hash; rows in order."""
    found: dict[int, dict[str, str]] = {}
    for seq, prev, digest in rows:
        found.setdefault(seq, {}).setdefault(prev, digest)
    return found


def through_block(start: int, links: dict[int, dict[str, str]], heads: list[tuple[int, str]], size: int = BLOCK) -> Iterator[tuple[int, str, str | None]]:
    """(entry sequence, entry hash, hash at the block's end or None) of every
    hash that can enter the block at its start, and of a head inside it. Built
    from the last sequence down, so rivals cost no walk of their own."""
    wanted = dict(heads)
    after: dict[str, str | None] = {}
    low = min([start, *wanted]) if start in links else min(wanted, default=start + size)
    for seq in range(start + size - 1, low - 1, -1):
        own = links.get(seq, {})
        last = seq == start + size - 1
        after = {prev: digest if last else after.get(digest) for prev, digest in own.items()}
        if seq in wanted:
            yield seq, wanted[seq], after.get(wanted[seq])
    if start in links:
        yield from ((start, prev, out) for prev, out in after.items() if (start, prev) not in heads)


def _block_ends(rows: DataFrame, size: int) -> DataFrame:
    """(sensor, start, entry_seq, entry_hash, exit_hash) of blocks, from candidates and heads."""
    names = [*SENSOR, "start", "entry_seq", "entry_hash", "exit_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, heads = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            if key is None or key[2] is None:
                return
            start = int(key[2])
            found = list(through_block(start, _first_links(held), heads, size))
            if found:
                entry, digest, end = zip(*found, strict=True)
                n = len(found)
                kinds = [pa.string(), pa.string(), pa.decimal128(20, 0), pa.decimal128(20, 0), pa.string(), pa.string()]
                columns = [[key[0]] * n, [key[1]] * n, [key[2]] * n, [Decimal(e) for e in entry], digest, end]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for source, epoch, start, seq, prev, digest, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (source, epoch, start) != key:
                    yield from out()
                    key, held, heads = (source, epoch, start), [], []
                if head:
                    heads.append((int(seq), digest))
                elif seq is not None:
                    held.append((int(seq), prev, digest))
        yield from out()

    dealt = rows.repartition(*SENSOR, "start").sortWithinPartitions(*SENSOR, "start", "seq", "blob_name")
    schema = f"source_id string, source_epoch string, start {SEQUENCE}, entry_seq {SEQUENCE}, entry_hash string, exit_hash string"
    return dealt.select(*SENSOR, "start", "seq", "prev", "payload_hash", "head").mapInArrow(run, schema)


def _entries(ends: DataFrame, heads: DataFrame, size: int) -> DataFrame:
    """(sensor, start, entry_seq, entry_hash) of the blocks that a chain reaches: a
    scan over the blocks of a sensor, from its head or from nothing."""
    names = [*SENSOR, "start", "entry_seq", "entry_hash"]

    def reached(head: tuple[int, str], blocks: list[tuple]) -> Iterator[tuple]:
        seq, digest = head
        exits: dict[int, dict] = {}
        for start, entry, entered, end in blocks:
            exits.setdefault(int(start), {})[int(entry), entered] = end
        while (start := seq - seq % size) in exits:
            yield start, seq, digest
            end = exits[start].get((seq, digest))
            if end is None:
                return
            seq, digest = start + size, end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sensor, head, blocks = None, (0, ""), []

        def out() -> Iterator[pa.RecordBatch]:
            found = list(reached(head, blocks)) if sensor else []
            if found:
                starts, entries, digests = zip(*found, strict=True)
                number = lambda values: pa.array([Decimal(v) for v in values], pa.decimal128(20, 0))
                columns = [pa.array([sensor[0]] * len(found), pa.string()), pa.array([sensor[1]] * len(found), pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, number(starts), number(entries), pa.array(digests, pa.string())], names=names)

        for batch in batches:
            for source, epoch, start, entry, entered, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (source, epoch) != sensor:
                    yield from out()
                    sensor, head, blocks = (source, epoch), (0, ""), []
                if start is None:
                    head = (int(entry), entered)
                else:
                    blocks.append((start, entry, entered, end))
        yield from out()

    none = F.lit(None)
    first = heads.select(*SENSOR, none.cast(SEQUENCE).alias("start"), "entry_seq", "entry_hash", none.cast("string").alias("exit_hash"))
    dealt = ends.unionByName(first).repartition(*SENSOR).sortWithinPartitions(*SENSOR, "start")
    return dealt.mapInArrow(run, f"source_id string, source_epoch string, start {SEQUENCE}, entry_seq {SEQUENCE}, entry_hash string")


def accept_chain(candidates: DataFrame, heads: DataFrame, size: int = BLOCK) -> DataFrame:
    """Add ``status``: accepted, sequence_gap, hash_chain_mismatch or
    replay_conflict, as if candidates were tried one by one in the order of
    sensor, sequence and name.

    At each sequence the first name that continues the head wins: later names
    conflict with it, earlier names had the wrong hash. Where none does the
    chain ends; what lies beyond is a gap. No job runs while this is built.
    """
    seq = sequence_number(F.col("sequence")).cast(SEQUENCE)
    prev = F.coalesce("previous_batch_hash", F.lit(""))
    next_seq = sequence_number(F.col("next_sequence")).cast(SEQUENCE)
    known = heads.select(*SENSOR, next_seq.alias("entry_seq"), F.coalesce("previous_hash", F.lit("")).alias("entry_hash"))
    steps = candidates.select(*SENSOR, _block(seq, size).alias("start"), seq.alias("seq"), prev.alias("prev"), "payload_hash", "blob_name", F.lit(False).alias("head"))
    at_head = known.select(
        *SENSOR,
        _block(F.col("entry_seq"), size).alias("start"),
        F.col("entry_seq").alias("seq"),
        F.lit(None).cast("string").alias("prev"),
        F.col("entry_hash").alias("payload_hash"),
        F.lit(None).cast("string").alias("blob_name"),
        F.lit(True).alias("head"),
    )
    entries = _entries(_block_ends(steps.unionByName(at_head), size), known, size)
    entered = {"_entry": F.lit(None).cast("string"), "_start": _block(seq, size), "_seq": seq, "_prev": prev}
    rows = candidates.withColumns(entered)
    opening = {c: F.lit(None).cast(candidates.schema[c].dataType) for c in candidates.columns if c not in SENSOR}
    opening |= {"_entry": F.col("entry_hash"), "_start": F.col("start"), "_seq": F.col("entry_seq"), "_prev": F.lit(None).cast("string")}
    return _judged(rows.unionByName(entries.select(*SENSOR, *[c.alias(n) for n, c in opening.items()])), candidates)


def _judged(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Status of the candidates of each block; an entry row (``_entry`` not null) comes first in its block."""
    where = {n: rows.columns.index(n) for n in (*SENSOR, "_start", "_seq", "_prev", "_entry", "payload_hash")}
    names = candidates.columns
    keep = [rows.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, front, head, done = None, None, None, None
        for batch in batches:
            status = []
            for source, epoch, start, seq, prev, entry, digest in zip(*(batch.column(k).to_pylist() for k in where.values()), strict=True):
                if (source, epoch, start) != key:
                    key, front, head, done = (source, epoch, start), None, None, None
                if entry is not None:
                    front, head = seq, entry
                    status.append(None)
                elif seq is not None and seq == front:
                    if prev == head:
                        status.append("accepted")
                        done, front, head = seq, seq + 1, digest
                    else:
                        status.append("hash_chain_mismatch")
                else:
                    status.append("replay_conflict" if seq is not None and seq == done else "sequence_gap")
            told = pa.array(status, pa.string())
            chosen = [*(batch.column(k) for k in keep), told]
            yield pa.RecordBatch.from_arrays(chosen, names=[*names, "status"]).filter(told.is_valid())

    order = [*SENSOR, "_start", F.col("_entry").isNull(), "_seq", "blob_name"]
    schema = candidates.schema.__class__(list(candidates.schema.fields)).add("status", "string")
    return rows.repartition(*SENSOR, "_start").sortWithinPartitions(*order).mapInArrow(run, schema)


#: Columns of a stored batch that its digest covers.
STORED = ("source_id", "source_epoch", "kind", "sequence", "payload_hash", "blob_name", "created_at")
LANES = ("digest_a", "digest_b")


def digest_sums() -> list[Column]:
    """Two sums of 60 bits of each row's SHA-256. Sums of parts add up to the sum
    of the whole, so a digest is carried from run to run and no order is needed."""
    text = F.sha2(F.to_json(F.struct(*STORED)), 256)
    lane = lambda i: F.conv(F.substring(text, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
    return [F.sum(lane(i)).cast("decimal(38,0)").alias(name) for i, name in enumerate(LANES)]


def moved_chains(accepted: DataFrame, heads: DataFrame) -> DataFrame:
    """What a run's accepted batches make of their sensors' chains: where the
    chain stood before, its head now, steps and digest of the run, and kind."""
    seq = sequence_number(F.col("sequence"))
    before = heads.select(*SENSOR, F.col("next_sequence").alias("_before"))
    moved = accepted.groupBy(*SENSOR).agg(
        F.max("kind").alias("kind"),
        (F.max(seq) + 1).cast(SEQUENCE).cast("string").alias("next_sequence"),
        F.max_by("payload_hash", seq).alias("previous_hash"),
        F.count("*").alias("steps"),
        *digest_sums(),
    )
    return moved.join(before, SENSOR, "left").withColumn("first_sequence", F.coalesce("_before", F.lit("0"))).drop("_before")


def _spans(accepted: DataFrame, digests: bool = False) -> DataFrame:
    """First, last and number of steps per sensor, most copies of one, whether a
    name or hash is malformed. Two grouped aggregations, no ordered scan."""
    named = F.col("blob_name") == blob_name(
        F.col("source_id"), F.col("source_epoch"), F.col("sequence"), F.col("payload_hash")
    )
    per_step = (
        accepted.withColumn("seq", sequence_number(F.col("sequence")))
        .groupBy(*STEP)
        .agg(
            F.count("*").alias("n"),
            F.max(F.when(holds(named) & hex_digest(F.col("payload_hash"), 64), 0).otherwise(1)).alias("bad"),
            *(digest_sums() if digests else []),
        )
    )
    return per_step.groupBy(*SENSOR).agg(
        F.count("*").alias("steps"),
        F.min("seq").alias("first"),
        F.max("seq").alias("last"),
        F.max("n").alias("copies"),
        F.max("bad").alias("bad"),
        *(F.sum(c).cast("decimal(38,0)").alias(c) for c in (LANES if digests else ())),
    )


def _violation(first: Column) -> Column:
    return (
        F.when((F.col("first") != first) | (F.col("last") + 1 - first != F.col("steps")), "chain_not_contiguous")
        .when(F.col("copies") > 1, "repeated_sequence")
        .when(F.col("bad") > 0, "invalid_name_or_hash")
    )


def verify_chain(accepted: DataFrame) -> DataFrame:
    """Sensors whose stored chain is not contiguous from zero, has a repeated
    sequence, a malformed hash or a name that is not deterministic."""
    checked = _spans(accepted).withColumn("violation", _violation(F.lit(0)))
    return checked.where(F.col("violation").isNotNull()).select(*SENSOR, "violation")


def verify_run(stored: DataFrame, moved: DataFrame, heads: DataFrame) -> DataFrame:
    """The same for the rows of one run alone: they must continue the chain from
    where ``moved`` says it stood, have the digest it tells and end at the head."""
    told = moved.select(*SENSOR, sequence_number(F.col("first_sequence")).alias("_first"), *[F.col(c).alias(f"_{c}") for c in LANES])
    at = heads.select(*SENSOR, sequence_number(F.col("next_sequence")).alias("_next"))
    both = _spans(stored, digests=True).join(told, SENSOR, "full").join(at, SENSOR, "left")
    same = F.lit(True)
    for c in LANES:
        same = same & holds(F.col(c) == F.col(f"_{c}"))
    checked = both.withColumn(
        "violation",
        F.coalesce(
            F.when(F.col("_first").isNull() | F.col("steps").isNull(), "rows_changed"),
            _violation(F.col("_first")),
            F.when(~same, "rows_changed"),
            F.when(~holds(F.col("last") + 1 == F.col("_next")), "head_changed"),
        ),
    )
    return checked.where(F.col("violation").isNotNull()).select(*SENSOR, "violation")


def with_digests(heads: DataFrame, accepted: DataFrame) -> DataFrame:
    """Heads with the digest of all their stored batches."""
    sums = accepted.groupBy(*SENSOR).agg(*digest_sums())
    return heads.drop(*LANES).join(sums, SENSOR, "left")


def audit_chain(accepted: DataFrame, heads: DataFrame) -> DataFrame:
    """Every stored batch against the chain rules and the digest in its head."""
    told = heads.select(*SENSOR, F.lit(True).alias("_head"), *[F.col(c).alias(f"_{c}") for c in LANES])
    both = accepted.groupBy(*SENSOR).agg(*digest_sums()).join(told, SENSOR, "full")
    same = F.col("_head").isNotNull()
    for c in LANES:
        same = same & holds(F.col(c) == F.col(f"_{c}"))
    changed = both.where(~same).select(*SENSOR, F.lit("rows_changed").alias("violation"))
    return verify_chain(accepted).unionByName(changed).groupBy(*SENSOR).agg(F.min("violation").alias("violation"))


def run_summary(statuses: DataFrame) -> DataFrame:
    """Accepted, replayed and quarantined counts from a ``status`` column."""
    kind = (
        F.when(F.col("status") == "accepted", "accepted")
        .when(F.col("status") == "replay", "replayed")
        .otherwise("quarantined")
    )
    return statuses.groupBy(kind.alias("outcome")).agg(F.count("*").alias("batches"))


def latest_update(accepted: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Newest creation time over accepted batches."""
    return accepted.agg(F.max(F.col("created_at") if created_at is None else created_at).alias("updated_at"))


def refresh_kinds(heads: DataFrame, registry: DataFrame) -> DataFrame:
    """Copy each registered sensor's current kind, also without new batches."""
    current = registry.select(*SENSOR, F.col("kind").alias("_kind"))
    return (
        heads.join(current, SENSOR, "left")
        .withColumn("kind", F.coalesce("_kind", "kind"))
        .drop("_kind")
    )


def fetch_targets(registry: DataFrame, heads: DataFrame) -> DataFrame:
    """Enabled sensors with a repository and the next sequence they need."""
    return (
        registry.where(F.col("enabled") & holds(F.col("repository") != ""))
        .join(heads.select(*SENSOR, "next_sequence"), SENSOR, "left")
        .select(*SENSOR, "repository", F.coalesce("next_sequence", F.lit("0")).alias("next_sequence"))
        .orderBy(*SENSOR)
    )
