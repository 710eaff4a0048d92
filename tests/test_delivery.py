"""Fetch selection, integrity, receipts."""

import hashlib

from pyspark.sql import functions as F

from wardlog.functions.text import validate_receipts
from wardlog.operators import delivery

EPOCH = "0b8f6c1e-7a52-4c39-9d41-2e6f0a9b7c53"
LISTING = "repository string, path string, mode string, type string, sha string, size bigint"
TARGETS = "source_id string, source_epoch string, repository string, next_sequence string"


def path(source, sequence, digit):
    return f"{source}/{EPOCH}/{len(sequence)}-{sequence}/{digit * 64}.json"


def entry(name, mode="100644", kind="blob", sha="a" * 40, size=9, repository="alice/batches"):
    return (repository, name, mode, kind, sha, size)


def pick(spark, entries, targets=(("alice-pi", EPOCH, "alice/batches", "1"),), **kwargs):
    out = delivery.select_new_batches(
        spark.createDataFrame(entries, LISTING), spark.createDataFrame(list(targets), TARGETS), **kwargs
    )
    return sorted(((r.source_id, r.sequence) for r in out.collect()), key=lambda x: (x[0], int(x[1])))


def test_only_new_regular_canonical_files_in_sequence_order(spark):
    entries = [
        entry(path("alice-pi", s, d)) for s, d in (("0", "a"), ("10", "c"), ("1", "b"), ("2", "d"), ("1" * 40, "e"))
    ]
    entries += [
        entry(path("bob-pi", "3", "e")), entry(path("alice-pi", "4", "f"), mode="120000"), entry(path("alice-pi", "5", "f"), sha="zz"),
        entry(f"alice-pi/{EPOCH}/2-05/{'0' * 64}.json"), entry(path("alice-pi", "6", "f"), size=0), entry(path("alice-pi", "7", "f"), kind="tree"),
        entry(path("alice-pi", "8", "f"), repository="mallory/batches"), entry(path("alice-pi", "9", "f"), size=2_000_000),
    ]
    assert pick(spark, entries) == [("alice-pi", "1"), ("alice-pi", "2"), ("alice-pi", "10")]


def test_budget_share_and_existing_files(spark):
    entries = [entry(path("alice-pi", str(i), "a")) for i in range(5)]
    here = spark.createDataFrame([(path("alice-pi", "0", "a"),)], "path string")
    targets = [("alice-pi", EPOCH, "alice/batches", "0")]
    assert pick(spark, entries, targets, existing=here) == [("alice-pi", str(i)) for i in range(1, 5)]
    assert pick(spark, entries, targets, existing=here, budget=2) == [("alice-pi", "1"), ("alice-pi", "2")]
    many = [entry(path("alice-pi", str(i), "a")) for i in range(600)] + [
        entry(path("bob-pi", str(i), "b"), repository="bob/batches") for i in range(60)
    ]
    both = targets + [("bob-pi", EPOCH, "bob/batches", "0")]
    assert len(pick(spark, many, both)) == 660
    assert pick(spark, many, both, per_source=48) == [(s, str(i)) for s in ("alice-pi", "bob-pi") for i in range(48)]


def test_content_must_match_the_listed_tree(spark):
    data = b"hello\n"
    # The well-known id of this content.
    assert hashlib.sha1(b"blob 6\0" + data).hexdigest() == "ce013625030ba8dba906f756967f9e9ca394464a"
    listing = spark.createDataFrame([("a", "ce013625030ba8dba906f756967f9e9ca394464a", 6), ("b", "c" * 40, 6)], "path string, sha string, size bigint")
    files = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(data))], "path string, content binary")
    assert [r.path for r in delivery.verify_blob_sha(files, listing).collect()] == ["a"]


def test_receipts(spark):
    digest, base = "a" * 64, {"source_id": "sensor-one", "source_epoch": EPOCH, "sequence": "7", "envelope_sha256": "b" * 64, "etag": '"0x8D"'}
    good = {**base, "schema_version": "wardlog.outbox-receipt/v1", "payload_hash": digest, "blob_name": f"sensor-one/{EPOCH}/1-7/{digest}.json"}
    cases = {
        None: good, "schema_version": {**good, "schema_version": "x"}, "identity": {**good, "source_id": "Sensor"},
        "sequence": {**good, "sequence": "07"}, "hashes": {**good, "payload_hash": digest.upper()},
        "blob_name": {**good, "blob_name": "x"}, "etag": {**good, "etag": "bare"},
    }
    names = list(good)
    table = spark.createDataFrame([tuple(c[n] for n in names) for c in cases.values()], ", ".join(f"{n} string" for n in names))
    assert [r.reject_reason for r in validate_receipts(table).collect()] == list(cases)
    pending = table.limit(1)
    for change, status in (({}, "acked"), ({"envelope_sha256": "c" * 64}, "mismatch"), ({"sequence": "8"}, "orphan")):
        receipt = pending.withColumns({k: F.lit(v) for k, v in change.items()})
        assert status in {r.status for r in delivery.reconcile_receipts(pending, receipt).collect()}
