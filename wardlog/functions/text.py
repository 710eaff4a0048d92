"""Text and identity predicates. Every limit counts bytes, not characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlog.config import LIMITS, NAMES, WireNames

# The patterns of the data model.
CONTROL = r"[\x00-\x1f\x7f]"
SOURCE_ID = r"\A[a-z0-9](?:[a-z0-9._-]{0,62}[a-z0-9])?\z"
SOURCE_EPOCH = r"\A[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
RULE_ID = r"\A[a-z0-9](?:[a-z0-9._/-]{0,126}[a-z0-9])?\z"
SEQUENCE = r"\A(?:0|[1-9][0-9]{0,18})\z"
ETAG = r'\A"[0-9A-Za-z._:-]{1,128}"\z'
JOURNAL_CURSOR = r"\A[a-z]+=[0-9a-f]+(?:;[a-z]+=[0-9a-f]+)*\z"
REPOSITORY = r"\A[A-Za-z0-9](?:[A-Za-z0-9]|-[A-Za-z0-9]){0,38}/[A-Za-z0-9._-]{1,100}\z"


def holds(condition: Column) -> Column:
    """A predicate that is false, not null, on missing input."""
    return F.coalesce(condition, F.lit(False))


def matches(col: Column, pattern: str) -> Column:
    return holds(col.rlike(pattern))


def bounded_text(col: Column, max_bytes: int) -> Column:
    """Non-empty, at most ``max_bytes``, valid UTF-8, no control characters."""
    return holds(
        F.octet_length(col).between(1, max_bytes)
        & F.is_valid_utf8(col)
        & ~col.rlike(CONTROL)
    )


def hex_digest(col: Column, length: int) -> Column:
    return matches(col, rf"\A[0-9a-f]{{{length}}}\z")


def sanitize_password(col: Column) -> Column:
    """An unusable password is dropped; it never rejects its event."""
    return F.when(bounded_text(col, LIMITS.password_bytes), col)


def valid_identity(source_id: Column, source_epoch: Column) -> Column:
    return (
        holds(F.octet_length(source_id) <= LIMITS.source_id_bytes)
        & matches(source_id, SOURCE_ID)
        & matches(source_epoch, SOURCE_EPOCH)
    )


def valid_key_id(col: Column) -> Column:
    return bounded_text(col, LIMITS.key_id_bytes)


def valid_sequence(col: Column) -> Column:
    return matches(col, SEQUENCE)


def valid_rule_ids(col: Column) -> Column:
    """1 to 16 well-formed identifiers, sorted and unique."""
    return holds(
        F.size(col).between(1, LIMITS.rule_ids)
        & F.forall(
            col,
            lambda rule: holds(F.octet_length(rule) <= LIMITS.rule_id_bytes)
            & matches(rule, RULE_ID),
        )
        & (F.array_sort(F.array_distinct(col)) == col)
    )


def valid_repository(col: Column) -> Column:
    name = F.element_at(F.split(col, "/"), -1)
    return (
        matches(col, REPOSITORY)
        & holds(~name.isin(".", ".."))
        & ~holds(F.lower(name).endswith(".git"))
    )


def valid_journal_cursor(col: Column) -> Column:
    return holds(F.octet_length(col) <= LIMITS.cursor_bytes) & matches(col, JOURNAL_CURSOR)


def safe_file_name(col: Column) -> Column:
    """A relative name that may be published; anything else is masked."""
    safe = (
        holds(F.octet_length(col).between(1, LIMITS.quarantine_file_bytes))
        & holds(F.is_valid_utf8(col))
        & ~holds(col.startswith("/"))
        & ~holds(F.contains(col, F.lit("..")))
        & ~matches(col, CONTROL)
    )
    return F.when(safe, col).otherwise(F.lit("unsafe-name"))


def sequence_number(col: Column) -> Column:
    """19 digits can exceed BIGINT, so sequences compare as decimals. Null for
    text that is no sequence: a hostile name must not fail the job."""
    return col.try_cast("decimal(20,0)")


def event_id(adapter: Column, cursor: Column) -> Column:
    """Stable event id; null where the adapter name or cursor is unusable."""
    usable = (
        holds(F.octet_length(adapter) > 0)
        & ~matches(adapter, r"[:\x00\r\n]")
        & holds(F.octet_length(cursor).between(1, LIMITS.cursor_bytes))
        & ~matches(cursor, r"[\x00\r\n]")
    )
    return F.when(usable, F.concat(adapter, F.lit(":"), F.sha2(cursor.cast("binary"), 256)))


def blob_name(source_id: Column, source_epoch: Column, sequence: Column, payload_hash: Column) -> Column:
    """Deterministic object name; the digit count makes names sort by sequence."""
    return F.concat_ws(
        "/",
        source_id,
        source_epoch,
        F.concat(F.length(sequence).cast("string"), F.lit("-"), sequence),
        F.concat(payload_hash, F.lit(".json")),
    )


def file_name(sequence: Column, payload_hash: Column) -> Column:
    return F.concat(F.lit("batch-"), sequence, F.lit("-"), payload_hash, F.lit(".json"))


def receipt_file_name(envelope_file: Column) -> Column:
    return F.concat(F.regexp_replace(envelope_file, r"\.json\z", ""), F.lit(".receipt.json"))


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The name of the first violated rule, or null. ``rules`` are pairs of
    (violated, name) in order of precedence."""
    reason = None
    for violated, name in rules:
        reason = F.when(violated, name) if reason is None else reason.when(violated, name)
    return reason


def validate_receipts(receipts, names: WireNames = NAMES):
    """Add ``reject_reason`` to a table of upload receipts."""
    c = F.col
    expected = blob_name(c("source_id"), c("source_epoch"), c("sequence"), c("payload_hash"))
    return receipts.withColumn(
        "reject_reason",
        first_reason(
            (~holds(c("schema_version") == names.schema("outbox-receipt")), "schema_version"),
            (~valid_identity(c("source_id"), c("source_epoch")), "identity"),
            (~valid_sequence(c("sequence")), "sequence"),
            (~(hex_digest(c("payload_hash"), 64) & hex_digest(c("envelope_sha256"), 64)), "hashes"),
            (~holds(c("blob_name") == expected), "blob_name"),
            (~matches(c("etag"), ETAG), "etag"),
        ),
    )
