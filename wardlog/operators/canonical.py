"""Canonical encodings, hashes and signatures of batches.

For this schema (integers, ASCII keys, no control characters in text) the
RFC 8785 form is ``to_json`` of a struct whose fields are in alphabetical
order, and the transport form is ``to_json`` in declared order with five
characters escaped. Both run inside the JVM.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlog import schemas
from wardlog.config import NAMES, WireNames
from wardlog.functions.text import blob_name, file_name, holds

# Characters the transport form escapes.
TRANSPORT_ESCAPES = {
    "<": "\\u003c",
    ">": "\\u003e",
    "&": "\\u0026",
    "\u2028": "\\u2028",
    "\u2029": "\\u2029",
}


def _optional(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def _bucket(b: Column, names: tuple[str, ...]) -> Column:
    return F.struct(*[b[n].alias(n) for n in names])


def _record(r: Column, order, bucket_order) -> Column:
    fields = {
        "kind": r["kind"],
        "source_ip": r["source_ip"],
        "username": _optional(r["username"]),
        "password": _optional(r["password"]),
        "path": _optional(r["path"]),
        "count": r["count"],
        "first_observed_at": r["first_observed_at"],
        "last_observed_at": r["last_observed_at"],
        "hourly_buckets": F.transform(r["hourly_buckets"], lambda b: _bucket(b, bucket_order)),
        "rule_ids": r["rule_ids"],
    }
    return F.struct(*[fields[n].alias(n) for n in order(fields)])


def _payload(p: Column, order) -> Column:
    fields = {
        "schema_version": p["schema_version"],
        "source_id": p["source_id"],
        "source_epoch": p["source_epoch"],
        "sequence": p["sequence"],
        "previous_batch_hash": _optional(p["previous_batch_hash"]),
        "created_at": p["created_at"],
        "observation_window": F.struct(
            *[p["observation_window"][n].alias(n) for n in order(dict.fromkeys(["start", "end"]))]
        ),
        "classifier_version": p["classifier_version"],
        "records": F.transform(
            p["records"],
            lambda r: _record(r, order, tuple(order(dict.fromkeys(["hour", "count"])))),
        ),
    }
    return F.struct(*[fields[n].alias(n) for n in order(fields)])


def transport_escaped(text: Column) -> Column:
    for plain, escape in TRANSPORT_ESCAPES.items():
        text = F.replace(text, F.lit(plain), F.lit(escape))
    return text


def canonical_payload(payload: Column) -> Column:
    """RFC 8785 text of a payload struct."""
    return F.to_json(_payload(payload, sorted))


def transport_payload(payload: Column) -> Column:
    return transport_escaped(F.to_json(_payload(payload, list)))


def canonical_envelope(envelope: Column) -> Column:
    """The exact transport text of a signed batch."""
    signature = envelope["signature"]
    return transport_escaped(
        F.to_json(
            F.struct(
                _payload(envelope["payload"], list).alias("payload"),
                F.struct(*[signature[n].alias(n) for n in ("algorithm", "key_id", "value")]).alias("signature"),
            )
        )
    )


def signing_text(payload: Column, names: WireNames = NAMES) -> Column:
    return F.concat(F.lit(names.signing_domain), canonical_payload(payload))


def payload_hash(payload: Column, names: WireNames = NAMES) -> Column:
    return F.sha2(signing_text(payload, names).cast("binary"), 256)


def with_identity(batches: DataFrame, names: WireNames = NAMES) -> DataFrame:
    """Add payload_hash, file_name and blob_name to rows with ``payload``."""
    p = F.col("payload")
    return (
        batches.withColumn("payload_hash", payload_hash(p, names))
        .withColumn("file_name", file_name(p["sequence"], F.col("payload_hash")))
        .withColumn(
            "blob_name",
            blob_name(p["source_id"], p["source_epoch"], p["sequence"], F.col("payload_hash")),
        )
    )


def decode_batches(files: DataFrame, names: WireNames = NAMES) -> DataFrame:
    """Decode ``content`` (BINARY) strictly.

    Adds ``envelope`` (null when rejected), identity columns and
    ``envelope_sha256``. Strictness is one comparison: re-encoding what was
    read must give the input bytes, so unknown or repeated keys, trailing
    data, coerced types and other spellings all fail it.
    """
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    parsed = files.withColumn("_text", text).withColumn("_read", F.from_json("_text", schemas.ENVELOPE))
    signature = F.col("_read.signature")
    complete = (
        F.col("_read.payload").isNotNull()
        & signature["algorithm"].isNotNull()
        & signature["key_id"].isNotNull()
        & signature["value"].isNotNull()
    )
    exact = holds(canonical_envelope(F.col("_read")) == F.col("_text")) & complete
    return (
        parsed.withColumn("envelope", F.when(exact, F.col("_read")))
        .drop("_text", "_read")
        .withColumn("payload", F.col("envelope.payload"))
        .withColumn("signature", F.col("envelope.signature"))
        .drop("envelope")
        .transform(with_identity, names)
        .withColumn("envelope_sha256", F.sha2("content", 256))
    )


# --- Ed25519 verification (RFC 8032), the one check with no JVM built-in. ---

_P = 2**255 - 19
_L = 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, _P - 2, _P) % _P
_ROOT = pow(2, (_P - 1) // 4, _P)


def _decompress(data: bytes):
    y = int.from_bytes(data, "little")
    sign, y = y >> 255, y & (1 << 255) - 1
    square = (y * y - 1) * pow(_D * y * y + 1, _P - 2, _P) % _P
    x = pow(square, (_P + 3) // 8, _P)
    if (x * x - square) % _P:
        x = x * _ROOT % _P
    if (x * x - square) % _P or (x == 0 and sign):
        return None
    if x & 1 != sign:
        x = _P - x
    return x, y % _P, 1, x * y % _P


def _add(p, q):
    a = (p[1] - p[0]) * (q[1] - q[0]) % _P
    b = (p[1] + p[0]) * (q[1] + q[0]) % _P
    c = 2 * p[3] * q[3] * _D % _P
    d = 2 * p[2] * q[2] % _P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % _P, g * h % _P, f * g % _P, e * h % _P


def _multiply(scalar: int, point):
    total = (0, 1, 1, 0)
    while scalar:
        if scalar & 1:
            total = _add(total, point)
        point = _add(point, point)
        scalar >>= 1
    return total


def _base_point():
    return _decompress((4 * pow(5, _P - 2, _P) % _P).to_bytes(32, "little"))


def ed25519_valid(public_key: bytes, message: bytes, signature: bytes) -> bool:
    if len(public_key) != 32 or len(signature) != 64:
        return False
    scalar = int.from_bytes(signature[32:], "little")
    key = _decompress(public_key)
    if key is None or scalar >= _L:
        return False
    digest = hashlib.sha512(signature[:32] + public_key + message).digest()
    challenge = int.from_bytes(digest, "little") % _L
    negated = (_P - key[0], key[1], key[2], _P - key[3])
    x, y, z, _ = _add(_multiply(scalar, _base_point()), _multiply(challenge, negated))
    inverse = pow(z, _P - 2, _P)
    x, y = x * inverse % _P, y * inverse % _P
    return (y | (x & 1) << 255).to_bytes(32, "little") == signature[:32]


@F.pandas_udf(T.BooleanType())
def _verify(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for keys, texts, signatures in batches:
        yield pd.Series(
            [
                None not in (k, t, s) and ed25519_valid(bytes(k), t.encode(), bytes(s))
                for k, t, s in zip(keys, texts, signatures)
            ],
            dtype="bool",
        )


BASE64_URL = r"\A[A-Za-z0-9_-]*\z"


def base64url(col: Column) -> Column:
    """Unpadded base64url to BINARY; null when malformed."""
    standard = F.translate(col, "-_", "+/")
    padded = F.rpad(standard, F.ceil(F.length(standard) / 4).cast("int") * 4, F.lit("="))
    well_formed = col.rlike(BASE64_URL) & (F.length(col) % 4 != 1)
    return F.when(well_formed, F.when(col == "", F.lit(b"")).otherwise(F.unbase64(padded)))


def to_base64url(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def verify_signatures(batches: DataFrame, names: WireNames = NAMES, when: Column | None = None) -> DataFrame:
    """Add ``signature_valid`` to rows with payload, signature, public_key.

    A check costs milliseconds in Python, so only rows that satisfy ``when``
    and could verify at all send their text across; the others send nulls and
    come back false.
    """
    signature = F.col("signature")
    plausible = holds(signature["algorithm"] == "Ed25519") & holds(F.length(signature["value"]) == 86)
    if when is not None:
        plausible = plausible & when
    only = lambda col: F.when(plausible, col)
    verdict = _verify(
        only(base64url(F.col("public_key"))),
        only(signing_text(F.col("payload"), names)),
        only(base64url(signature["value"])),
    )
    return batches.withColumn("signature_valid", holds(verdict))
