"""Log lines to observations.

Input tables have ``value`` (one log line) and ``cursor`` (its stable
position). Parsers return the observation columns plus ``reject_reason``;
lines that are well-formed but not of interest are filtered out. A malformed
line is never fatal: :func:`split_rejects` separates it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.config import LIMITS, NAMES, WireNames
from wardlog.functions.addresses import canonical_ip
from wardlog.functions.binding import bind
from wardlog.functions.text import (
    event_id,
    first_reason,
    holds,
    sanitize_password,
    valid_journal_cursor,
)
from wardlog.functions.times import parse_rfc3339, utc_text, utc_timestamp
from wardlog.operators.classify import HTTP, SSH
from wardlog.operators.validate import observation_reason

SSH_TYPE = "struct<username:string,password:string>"
HTTP_TYPE = "struct<request_target:string,status:int>"

# Fixed value: the one message form that counts as a failed login. The name
# is attacker-chosen, so both ends are anchored and the last address wins.
FAILED_LOGIN = (
    r"(?d)\AFailed (?:password|publickey|keyboard-interactive/pam) for (?:invalid user )?(.+) "
    r"from (\S+) port [0-9]+ ssh2(?:: [A-Za-z0-9-]+ SHA256:[A-Za-z0-9+/]+)?\z"
)


# Scheme and authority of a file's address.
ADDRESS = r"\A[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?"


def relative_path(file: Column, root: str) -> Column:
    """The path of a file below ``root``, or its whole path when it lies
    elsewhere. Works on addresses as the file source reports them."""
    below = quote(re.sub(ADDRESS, "", root).rstrip("/") + "/", safe="/:@!$&'()*+,;=~-._%")
    path = F.regexp_replace(file, ADDRESS, "")
    return F.when(path.startswith(below), F.substring(path, F.lit(len(below) + 1), F.length(path))).otherwise(path)


def line_cursors(lines: DataFrame) -> DataFrame:
    """Give lines of shipped files a position that survives a re-read:
    file, digest of the line and the number of the copy. Equal lines of one
    file are interchangeable, so copies are counted, not ordered: one grouped
    count, whatever share of a file one line makes up.

    Input: value, file. ``file`` is the path below the root that is followed
    (see :func:`relative_path`): files of two folders may share a name. A
    rotated chunk must keep its path when shipped again.
    """
    copies = lines.groupBy("file", "value").agg(F.count("*").alias("_n"))
    return copies.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n")))).select(
        "value",
        F.concat_ws(
            ":",
            F.col("file"),
            F.sha2(F.col("value").cast("binary"), 256),
            F.col("_copy").cast("string"),
        ).alias("cursor"),
    )


def read_json_lines(
    lines: DataFrame, fields: Mapping[str, str], strict: bool, max_bytes: int = LIMITS.log_line_bytes
) -> DataFrame:
    """Decode one JSON object per line into ``doc`` and ``reject_reason``.

    ``fields`` maps a key to STRING or BIGINT. The value must be exactly one
    object: wrapping it together with a key derived from the line itself shows
    trailing data, which the JSON functions would ignore. Types are checked on
    VARIANT fields because plain decoding coerces them.
    """
    value = F.col("value")
    digest = F.sha2(value.cast("binary"), 256)
    wrapped = F.json_object_keys(F.concat(F.lit('{"x":'), value, F.lit(',"'), digest, F.lit('":1}')))
    keys = F.json_object_keys(value)
    raw = F.from_json(value, ", ".join(f"`{name}` VARIANT" for name in fields))
    decoded = lines.withColumn("_raw", raw)
    field = lambda name: F.col("_raw").getField(name)
    mistyped = F.lit(False)
    for name, kind in fields.items():
        mistyped = mistyped | ~F.coalesce(
            F.schema_of_variant(field(name)).isin(kind, "VOID"), F.lit(True)
        )
    unknown = F.size(F.array_except(keys, F.array(*[F.lit(n) for n in fields]))) > 0
    rules = [
        (~holds(F.octet_length(value).between(1, max_bytes)), "line_size"),
        (~holds(F.is_valid_utf8(value)), "line_utf8"),
        (~holds(wrapped == F.array(F.lit("x"), digest)) | keys.isNull(), "line_json"),
    ]
    if strict:
        rules.append((unknown, "unknown_field"))
    rules.append((mistyped, "field_type"))
    doc = F.struct(
        *[F.try_variant_get(field(n), "$", k.lower()).alias(n) for n, k in fields.items()]
    )
    return decoded.withColumn("doc", doc).withColumn("reject_reason", first_reason(*rules)).drop("_raw")


def _observations(
    parsed: DataFrame,
    adapter: str,
    kind: str,
    cursor: Column,
    address: Column,
    observed_at: Column,
    ssh: Column,
    http: Column,
    early: list[tuple[Column, str]],
    names: WireNames,
) -> DataFrame:
    """Common tail of the parsers: assemble, then validate what was built. The
    generator at the end keeps the row's fields from being derived again for
    every later use."""
    early_reason = first_reason(*early) if early else F.lit(None).cast("string")
    built = F.struct(
        F.lit(names.schema("observation")).alias("schema_version"),
        event_id(F.lit(adapter), cursor).alias("event_id"),
        cursor.alias("cursor"),
        F.lit(kind).alias("kind"),
        observed_at.alias("observed_at"),
        canonical_ip(address).alias("source_ip"),
        ssh.cast(SSH_TYPE).alias("ssh"),
        http.cast(HTTP_TYPE).alias("http"),
        F.col("value").alias("line"),
        F.coalesce("reject_reason", early_reason).alias("early"),
    )

    def judged(o: Column) -> Column:
        kept = ("schema_version", "event_id", "cursor", "kind", "observed_at", "source_ip", "ssh", "http", "line")
        reason = F.coalesce(o["early"], observation_reason(lambda n: o[n], None, names))
        return F.struct(*[o[n].alias(n) for n in kept], reason.alias("reject_reason"))

    return parsed.select(F.inline(F.array(bind(built, judged))))


def parse_access_log(lines: DataFrame, names: WireNames = NAMES) -> DataFrame:
    """Web access lines (strict JSON) to HTTP observations."""
    parsed = read_json_lines(
        lines,
        {"time": "STRING", "remote_addr": "STRING", "request_uri": "STRING", "request": "STRING", "status": "BIGINT"},
        strict=True,
    )
    words = F.filter(F.split(F.col("doc.request"), r"(?U)\s+"), lambda w: w != "")
    target = F.coalesce(
        F.nullif("doc.request_uri", F.lit("")), F.when(F.size(words) == 3, F.get(words, F.lit(1)))
    )
    return _observations(
        parsed,
        "nginx",
        HTTP,
        F.col("cursor"),
        F.col("doc.remote_addr"),
        utc_timestamp(F.col("doc.time")),
        F.lit(None),
        F.struct(target.alias("request_target"), F.coalesce("doc.status", F.lit(0)).try_cast("int").alias("status")),
        [(target.isNull(), "request_line")],
        names,
    )


def parse_honeypot_log(lines: DataFrame, names: WireNames = NAMES) -> DataFrame:
    """Honeypot lines to SSH observations; only failed logins count."""
    parsed = read_json_lines(
        lines,
        {"eventid": "STRING", "timestamp": "STRING", "src_ip": "STRING", "username": "STRING", "password": "STRING"},
        strict=False,
    ).where(F.col("reject_reason").isNotNull() | holds(F.col("doc.eventid") == "cowrie.login.failed"))
    return _observations(
        parsed,
        "cowrie",
        SSH,
        F.col("cursor"),
        F.col("doc.src_ip"),
        utc_timestamp(F.col("doc.timestamp")),
        F.struct(
            F.col("doc.username").alias("username"), sanitize_password(F.col("doc.password")).alias("password")
        ),
        F.lit(None),
        [],
        names,
    )


def parse_ssh_journal(lines: DataFrame, names: WireNames = NAMES) -> DataFrame:
    """Journal records to SSH observations; the cursor is in the record.

    Records over 256 KiB or without a journal cursor are rejected before the
    message is looked at.
    """
    parsed = read_json_lines(
        lines,
        {"__CURSOR": "STRING", "__REALTIME_TIMESTAMP": "STRING", "MESSAGE": "STRING"},
        strict=False,
    )
    oversized = F.octet_length("value") > LIMITS.journal_record_bytes
    no_cursor = ~valid_journal_cursor(F.col("doc.__CURSOR"))
    parsed = parsed.withColumn(
        "reject_reason",
        F.when(oversized, "record_size").when(
            F.col("reject_reason").isNull() & no_cursor, "journal_cursor"
        ).otherwise(F.col("reject_reason")),
    ).where(F.col("reject_reason").isNotNull() | holds(F.col("doc.MESSAGE").rlike(FAILED_LOGIN)))
    micros = F.when(
        F.col("doc.__REALTIME_TIMESTAMP").rlike(r"\A\+?[0-9]+\z"),
        F.col("doc.__REALTIME_TIMESTAMP").try_cast("bigint"),
    )
    return _observations(
        parsed,
        "openssh",
        SSH,
        F.col("doc.__CURSOR"),
        F.regexp_extract("doc.MESSAGE", FAILED_LOGIN, 2),
        utc_text(F.timestamp_micros(micros)),
        F.struct(
            F.regexp_extract("doc.MESSAGE", FAILED_LOGIN, 1).alias("username"),
            F.lit(None).cast("string").alias("password"),
        ),
        F.lit(None),
        [(micros.isNull(), "journal_time")],
        names,
    )


Parser = Callable[[DataFrame], DataFrame]
PARSERS: dict[str, Parser] = {
    "nginx": parse_access_log,
    "cowrie": parse_honeypot_log,
    "openssh": parse_ssh_journal,
}


def register_parser(name: str, parser: Parser) -> None:
    """Add a log format; the parser returns the columns the built-in ones do."""
    PARSERS[name] = parser


def parse_logs(lines_by_format: Mapping[str, DataFrame]) -> DataFrame:
    """Parse several formats into one table of observations and rejects."""
    unsupported = sorted(set(lines_by_format) - set(PARSERS))
    if unsupported:
        raise ValueError(f"unsupported log formats: {', '.join(unsupported)}")
    parsed = [
        PARSERS[name](lines).withColumn("adapter_id", F.lit(name)) for name, lines in lines_by_format.items()
    ]
    union = parsed[0]
    for table in parsed[1:]:
        union = union.unionByName(table)
    return union


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, rejects): rejects keep only cursor and reason, never the
    line, so a log's private contents do not leak into diagnostics."""
    good = parsed.where(F.col("reject_reason").isNull()).drop("reject_reason", "line")
    bad = parsed.where(F.col("reject_reason").isNotNull()).select("cursor", "reject_reason")
    return good, bad


def flat_observations(observations: DataFrame) -> DataFrame:
    """Nested observations to the flat table the classifiers read. The text
    keeps all nanoseconds; ``nanos`` orders within a microsecond."""
    nested = ("ssh", "http", "schema_version", "observed_at")
    return (
        observations.withColumn("_t", parse_rfc3339(F.col("observed_at")))
        .select(
            *[c for c in observations.columns if c not in nested],
            F.col("observed_at").alias("observed_text"),
            F.col("_t.ts").alias("observed_at"),
            F.col("_t.nanos").alias("nanos"),
            F.col("ssh.username").alias("username"),
            F.col("ssh.password").alias("password"),
            F.col("http.request_target").alias("request_target"),
            F.col("http.status").alias("status"),
        )
    )
