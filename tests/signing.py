"""Test-side signing of envelopes; sensors keep their own keys."""

from __future__ import annotations

import hashlib
import json

from wardlog.operators import canonical as c

SECRET = bytes(range(32))
EPOCH = "0b8f6c1e-7a52-4c39-9d41-2e6f0a9b7c53"


def _encode(point) -> bytes:
    inverse = pow(point[2], c._P - 2, c._P)
    x, y = point[0] * inverse % c._P, point[1] * inverse % c._P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _expand(secret: bytes):
    h = hashlib.sha512(secret).digest()
    scalar = int.from_bytes(h[:32], "little") & ((1 << 254) - 8) | (1 << 254)
    return scalar, h[32:]


def public_key(secret: bytes = SECRET) -> bytes:
    return _encode(c._multiply(_expand(secret)[0], c._base_point()))


def sign(message: bytes, secret: bytes = SECRET) -> bytes:
    scalar, prefix = _expand(secret)
    r = int.from_bytes(hashlib.sha512(prefix + message).digest(), "little") % c._L
    point = _encode(c._multiply(r, c._base_point()))
    k = int.from_bytes(hashlib.sha512(point + public_key(secret) + message).digest(), "little") % c._L
    return point + ((r + k * scalar) % c._L).to_bytes(32, "little")


def record(kind="ssh_auth_failure", ip="11.0.0.1", hour="2026-09-10T19", count=1, **fields):
    ordered = {"kind": kind, "source_ip": ip}
    for name in ("username", "password", "path"):
        if name in fields:
            ordered[name] = fields[name]
    ordered.update(
        count=count,
        first_observed_at=f"{hour}:05:00Z",
        last_observed_at=f"{hour}:10:00Z",
        hourly_buckets=[{"hour": f"{hour}:00:00Z", "count": count}],
        rule_ids=["ssh/all-attempts-v1" if kind == "ssh_auth_failure" else "http/sensitive-file-v1"],
    )
    return ordered


def payload(sequence="0", previous=None, records=None, source="sensor-one", created="2026-09-10T20:00:00Z", start="2026-09-10T19:00:00Z", end="2026-09-10T20:00:00Z"):
    body = {
        "schema_version": "wardlog.batch/v1",
        "source_id": source,
        "source_epoch": EPOCH,
        "sequence": sequence,
    }
    if previous:
        body["previous_batch_hash"] = previous
    body.update(
        created_at=created,
        observation_window={"start": start, "end": end},
        classifier_version="rules-v1",
        records=records or [record(username="root", count=2)],
    )
    return body


def transport(value) -> bytes:
    text = json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    for plain, code in (("<", "003c"), (">", "003e"), ("&", "0026"), ("\u2028", "2028"), ("\u2029", "2029")):
        text = text.replace(plain, "\\u" + code)
    return text.encode()


def message_of(body) -> bytes:
    return b"wardlog-batch-v1\0" + json.dumps(body, separators=(",", ":"), ensure_ascii=False, sort_keys=True).encode()


def envelope(body, secret: bytes = SECRET, key_id="key-1"):
    """(relative file name, bytes, payload hash) of a signed batch."""
    message = message_of(body)
    digest = hashlib.sha256(message).hexdigest()
    signed = {
        "payload": body,
        "signature": {"algorithm": "Ed25519", "key_id": key_id, "value": c.to_base64url(sign(message, secret))},
    }
    sequence = body["sequence"]
    name = f"{body['source_id']}/{body['source_epoch']}/{len(sequence)}-{sequence}/{digest}.json"
    return name, transport(signed), digest


def registry(*sources, repository="owner/data"):
    return {
        "schema_version": "wardlog.registry/v1",
        "repository": repository,
        "sources": [
            {
                "source_id": s["source_id"],
                "source_epoch": EPOCH,
                "key_id": s.get("key_id", "key-1"),
                "public_key": c.to_base64url(public_key(s.get("secret", SECRET))),
                "blob_prefix": f"{s['source_id']}/{EPOCH}/",
                **({"kind": s["kind"]} if "kind" in s else {}),
                "enabled": s.get("enabled", True),
            }
            for s in sources
        ],
    }
