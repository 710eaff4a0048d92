"""The central step end to end, on signed envelope files."""

import json
import random
from pathlib import Path

import pytest
import signing
from pyspark.sql import functions as F

from wardlog import schemas
from wardlog.config import WireNames
from wardlog.operators import acceptance, canonical
from wardlog.plans import central
from wardlog.plans.central import check_state, publish_deny_lists, run_ingest
from wardlog.sinks.documents import write_envelopes
from wardlog.sinks.state import State, load_rejects, load_state, reject_counts
from wardlog.sources.files import read_never_block, read_registry, scan_envelopes
from wardlog.streaming.ingest import start_ingest, stream_envelopes


def write_files(root: Path, *envelopes) -> None:
    for name, data, _ in envelopes:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)


def read_sources(spark, folder: Path, *sources):
    path = folder / "sources.json"
    path.write_text(json.dumps(signing.registry(*sources)) + "\n")
    return read_registry(spark, str(path), "owner/data")


def ingest(spark, tmp_path, registry, now="2026-09-10T21:00:00Z", key="run-1", **kwargs):
    files = scan_envelopes(spark, str(tmp_path / "in"))
    return run_ingest(
        spark, files, registry, str(tmp_path / "state"), now, key, outputs=str(tmp_path / "out"),
        manifest=str(tmp_path / "out" / "manifest.json"), **kwargs,
    )


def chain(length, source="sensor-one", **kwargs):
    out, previous = [], None
    for i in range(length):
        out.append(signing.envelope(signing.payload(str(i), previous, source=source, **kwargs)))
        previous = out[-1][2]
    return out


def test_bootstrap_writes_the_exact_empty_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    result = ingest(spark, tmp_path, read_sources(spark, tmp_path), now="2026-09-11T07:00:00Z")
    assert (result.accepted, result.replayed, result.quarantined) == (0, 0, 0)
    out = tmp_path / "out"
    for granularity in ("hourly", "daily", "monthly", "yearly"):
        assert (out / "rollups" / f"{granularity}.json").read_text() == (
            '{"schema_version":"wardlog.rollup/v1","label":"self-reported suspected probes",'
            f'"granularity":"{granularity}","periods":[]}}\n'
        )
    assert (out / "quarantine.json").read_text() == (
        '{"schema_version":"wardlog.quarantine/v1","updated_at":"1970-01-01T00:00:00Z","entries":[]}\n'
    )
    assert (out / "manifest.json").read_text() == '{"schema_version":"wardlog.accepted-manifest/v1","blobs":[]}\n'


def test_accepts_replays_and_commits_once(spark, tmp_path):
    registry = read_sources(spark, tmp_path, {"source_id": "sensor-one", "kind": "decoy"})
    records = [
        signing.record(ip="11.0.0.1", username="root", password="a<&>b", count=2),
        signing.record("http_request", ip="1.1.1.1", path="/.env"),
        signing.record("http_request", ip="11.0.0.3", path="/.env"),
    ]
    records.sort(key=lambda r: (r["kind"], r["source_ip"]))
    first = signing.envelope(signing.payload(records=records))
    second = signing.envelope(signing.payload("1", first[2]))
    write_files(tmp_path / "in", first, second)
    result = ingest(spark, tmp_path, registry)
    assert (result.accepted, result.replayed, result.quarantined) == (2, 0, 0)
    hourly = json.loads((tmp_path / "out/rollups/hourly.json").read_text())
    assert hourly["updated_at"] == "2026-09-10T20:00:00Z"
    (period,) = hourly["periods"]
    assert (period["start"], period["end"], period["total"]) == ("2026-09-10T19:00:00Z", "2026-09-10T20:00:00Z", 6)
    assert period["sources"] == [{"source_id": "sensor-one", "source_epoch": signing.EPOCH, "kind": "decoy", "count": 6}]
    assert period["passwords"] == [{"value": "a<&>b", "count": 2}]
    assert period["usernames"] == [{"value": "root", "count": 4}]
    assert "a\\u003c\\u0026\\u003eb" in (tmp_path / "out/rollups/hourly.json").read_text()
    assert json.loads((tmp_path / "out/manifest.json").read_text())["blobs"] == sorted([first[0], second[0]])

    assert ingest(spark, tmp_path, registry) is None  # the same run again
    again = ingest(spark, tmp_path, registry, now="2026-09-10T22:00:00Z", key="run-2")
    assert (again.accepted, again.replayed, again.quarantined) == (0, 2, 0)
    assert json.loads((tmp_path / "out/rollups/hourly.json").read_text())["periods"][0]["total"] == 6

    (tmp_path / "never.json").write_text(
        '{"schema_version":"wardlog.never-block/v1","entries":[{"cidr":"1.1.1.1/32","reason":"resolver"}]}'
    )
    never = read_never_block(spark, str(tmp_path / "never.json"))
    publish_deny_lists(spark, str(tmp_path / "state"), "2026-09-10T22:00:00Z", str(tmp_path / "lists"), never)
    assert (tmp_path / "lists/recent.txt").read_text().splitlines()[4:] == ["11.0.0.1", "11.0.0.3"]
    assert len((tmp_path / "lists/persistent.txt").read_text().splitlines()) == 4
    assert "\t11.0.0.3 timeout 252000s\n}" in (tmp_path / "lists/recent.nft").read_text()
    assert {p.name for p in (tmp_path / "lists").glob("*.*") if not p.name.startswith(".")} == {
        f"{n}.{e}" for n in ("recent", "persistent") for e in ("txt", "nft", "ipset")
    }


def test_each_rejection_has_its_reason_and_leaks_nothing(spark, tmp_path):
    registry = read_sources(
        spark, tmp_path, {"source_id": "sensor-one"}, {"source_id": "sensor-off", "enabled": False}, {"source_id": "sensor-two"}
    )
    root = tmp_path / "in"
    good = signing.envelope(signing.payload())
    write_files(root, good)
    (root / "huge.json").write_bytes(b" " * 1_060_000)
    (root / "empty.json").write_bytes(b"")
    (root / "deep" / "er").mkdir(parents=True)
    (root / "deep" / "er" / "empty.json").write_bytes(b"")
    (root / "deep" / "other.txt").write_bytes(b"")
    (root / "broken.json").write_bytes(good[1] + b" ")
    (root / "moved.json").write_bytes(good[1])
    write_files(
        root,
        signing.envelope(signing.payload(source="sensor-none")),
        signing.envelope(signing.payload(source="sensor-off")),
        signing.envelope(signing.payload(source="sensor-two", records=[signing.record(username="pi", count=1)]), key_id="other"),
        signing.envelope(signing.payload(source="sensor-two"), secret=b"\1" * 32)[:2] + (None,),
    )
    name, data, _ = signing.envelope(signing.payload("0", source="sensor-two", created="2026-09-10T21:05:01Z"))
    write_files(root, (name, data, None))
    gap = signing.envelope(signing.payload("2", good[2]))
    wrong = signing.envelope(signing.payload("1", "f" * 64))
    write_files(root, gap, wrong)
    result = ingest(spark, tmp_path, registry)
    report = json.loads((tmp_path / "out/quarantine.json").read_text())
    reasons = {e["file"]: e["reason"] for e in report["entries"]}
    assert result.accepted == 1 and result.quarantined == len(reasons)
    assert reasons["huge.json"] == reasons["empty.json"] == reasons["deep/er/empty.json"] == "invalid_size"
    assert reasons["broken.json"] == "invalid_envelope" and reasons["moved.json"] == "invalid_blob_name"
    assert reasons[gap[0]] == "sequence_gap" and reasons[wrong[0]] == "hash_chain_mismatch"
    assert reasons[name] == "invalid_time"
    assert sorted(reasons.values()) == sorted(
        ["invalid_size"] * 3 + ["invalid_envelope", "invalid_blob_name"] + ["unregistered_source"] * 2
        + ["unregistered_key", "invalid_signature", "invalid_time", "sequence_gap", "hash_chain_mismatch"]
    )
    assert [e["file"] for e in report["entries"]] == sorted(reasons)
    stored = load_rejects(spark, str(tmp_path / "state"))
    assert {r.file: r.reason for r in stored.collect()} == reasons
    assert {(r.run, r.reason): r.files for r in reject_counts(stored).collect()}[1, "unregistered_source"] == 2
    assert "root" not in (tmp_path / "out/quarantine.json").read_text()


def test_stream_equals_batch_and_retries_parked_files(spark, tmp_path):
    registry = read_sources(spark, tmp_path, {"source_id": "sensor-one"}, {"source_id": "sensor-two", "kind": "decoy"})
    one, two = chain(4), chain(3, source="sensor-two")
    from datetime import datetime, timezone

    clock = lambda: datetime(2026, 9, 10, 21, tzinfo=timezone.utc)

    def drain():
        query = start_ingest(
            stream_envelopes(spark, str(tmp_path / "in")), registry, str(tmp_path / "streamed"), str(tmp_path / "ck"), clock=clock
        )
        query.awaitTermination()

    write_files(tmp_path / "in", one[0], one[2], *two)
    drain()
    assert {r.sequence for r in load_state(spark, str(tmp_path / "streamed")).accepted.where("source_id = 'sensor-one'").collect()} == {"0"}
    write_files(tmp_path / "in", one[1], one[3])
    drain()
    ingest(spark, tmp_path, registry)
    streamed, batch = load_state(spark, str(tmp_path / "streamed")), load_state(spark, str(tmp_path / "state"))
    for name in ("totals", "counts", "overflow", "evidence", "heads"):
        assert sorted(map(str, streamed.tables[name].collect())) == sorted(map(str, batch.tables[name].collect())), name
    assert streamed.accepted.count() == batch.accepted.count() == 7


def test_a_run_that_dies_before_the_pointer_is_made_again(spark, tmp_path, monkeypatch):
    registry = read_sources(spark, tmp_path, {"source_id": "sensor-one"})
    write_files(tmp_path / "in", *chain(2))

    def die(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(central.store, "commit_state", die)
    with pytest.raises(RuntimeError, match="lost"):
        ingest(spark, tmp_path, registry)
    blobs = json.loads((tmp_path / "out/manifest.json").read_text())["blobs"]
    assert len(blobs) == 2 and load_state(spark, str(tmp_path / "state")).version == 0
    monkeypatch.undo()
    assert ingest(spark, tmp_path, registry).accepted == 2
    assert json.loads((tmp_path / "out/manifest.json").read_text())["blobs"] == blobs


def test_only_files_that_may_heal_are_parked_and_not_for_ever(spark):
    files = spark.createDataFrame([(n, 1, bytearray(b"x")) for n in "abcd"], "file string, bytes long, content binary")
    reasons = [("a", "sequence_gap"), ("b", "invalid_signature"), ("c", "unregistered_key"), ("d", "invalid_time")]
    refused = spark.createDataFrame(reasons, "file string, status string")
    since = "timestamp'2026-08-01 00:00:00Z'"
    parked = files.where("file in ('c', 'd')").selectExpr("*", f"if(file = 'c', {since}, timestamp'2026-09-01 00:00:00Z') as since")
    now = F.lit("2026-09-10T00:00:00Z").cast("timestamp")
    rows = {r.file: r.day for r in central.next_parked(files, refused, parked, now).selectExpr("file", "unix_date(date(since)) as day").collect()}
    assert rows == {"a": 20706, "d": 20697}


def test_outbox_never_replaces_other_bytes(spark, tmp_path):
    def rows(*named):
        return spark.createDataFrame(
            [("sensor-one", n, bytearray(c)) for n, c in named], "source_id string, blob_name string, content binary"
        )

    path = str(tmp_path / "outbox")
    assert write_envelopes(rows(("a", b"1"), ("b", b"2")), path).isEmpty()
    conflicts = write_envelopes(rows(("a", b"1"), ("b", b"other"), ("c", b"3")), path)
    assert [r.blob_name for r in conflicts.collect()] == ["b"]
    stored = spark.read.parquet(path).collect()
    assert sorted((r.blob_name, bytes(r.content)) for r in stored) == [("a", b"1"), ("b", b"2"), ("c", b"3")]
    # two contents of one name in one call: neither is stored; repeated rows are
    conflicts = write_envelopes(rows(("d", b"1"), ("d", b"2"), ("e", b"3"), ("e", b"3")), path)
    assert [r.blob_name for r in conflicts.collect()] == ["d"]
    stored = spark.read.parquet(path).collect()
    assert sorted(r.blob_name for r in stored) == ["a", "b", "c", "e"]
    assert write_envelopes(rows(("e", b"3"), ("c", b"3")), path).isEmpty()
    assert spark.read.parquet(path).count() == 4


def test_damaged_state_is_refused(spark):
    empty = load_state(spark, "/tmp/wardlog-no-such-state")
    chain_rows = [("s", signing.EPOCH, "host", "1", "a" * 64, f"s/{signing.EPOCH}/1-1/{'a' * 64}.json", "2026-09-10T20:00:00Z")]
    broken = spark.createDataFrame(chain_rows, schemas.ACCEPTED)
    check_state(empty)
    with pytest.raises(ValueError, match="chain_not_contiguous"):
        check_state(State(1, None, None, broken, empty.tables))
    counts = spark.createDataFrame([("daily", None, "paths", "", 0)], schemas.PERIOD_COUNTS)
    with pytest.raises(ValueError, match="dimension_count, dimension_value"):
        check_state(State(1, None, None, empty.accepted, {**empty.tables, "counts": counts}))


def test_registry_violations_fail_the_read(spark, tmp_path):
    good = signing.registry({"source_id": "sensor-one"})
    path = tmp_path / "r.json"

    def read(document):
        path.write_text(json.dumps(document))
        return read_registry(spark, str(path), "owner/data").collect()

    assert read(good)[0].kind == "host"
    source = good["sources"][0]
    many = [{**source, "source_id": f"s{i}", "blob_prefix": f"s{i}/{signing.EPOCH}/"} for i in range(3_000)]
    assert len(read({**good, "sources": many})) == 3_000
    for bad in (
        {**good, "extra": 1},
        {**good, "repository": "other/data"},
        {**good, "sources": [source, source]},
        {**good, "sources": [{**source, "kind": "other"}]},
        {**good, "sources": [{**source, "public_key": "AA"}]},
        {**good, "sources": [{**source, "blob_prefix": "x/"}]},
        {**good, "sources": [{**source, "github_repository": "a/.."}]},
        {**good, "sources": [{**source, "unknown": 1}]},
    ):
        with pytest.raises(Exception, match="source registry"):
            read(bad)


def test_never_block_file(spark, tmp_path):
    path = tmp_path / "never.json"
    assert read_never_block(spark, str(path)).count() == 0
    path.write_text(
        '{"schema_version":"wardlog.never-block/v1","entries":[{"cidr":"1.1.1.0/24","reason":"resolver"},{"cidr":"::ffff:8.8.8.8/128","reason":"resolver"}]}'
    )
    assert [r.prefix for r in read_never_block(spark, str(path)).collect()] == ["1.1.1.0/24", "8.8.8.8/32"]
    for bad in (
        '{"schema_version":"wardlog.never-block/v1","entries":[{"cidr":"1.1.1.1","reason":"x"}]}',
        '{"schema_version":"wardlog.never-block/v1","entries":[{"cidr":"1.1.1.1/32","reason":""}]}',
        '{"schema_version":"wardlog.never-block/v1","entries":[],"extra":1}',
        '{"schema_version":"other","entries":[]}',
    ):
        path.write_text(bad)
        with pytest.raises(Exception, match="never-block list"):
            read_never_block(spark, str(path)).collect()


ODD = ["plain", "<script>&'\"\\/", "ünïcode ☃ 𝄞", " line ", "\u007f".replace("\u007f", "~"), "a+b %2e", "ſK"]


def test_canonical_forms_match_a_plain_encoder(spark):
    """Odd characters in every text field, both encodings, byte for byte."""
    bodies = []
    for i, odd in enumerate(ODD):
        records = [
            signing.record("http_request", ip="11.0.0.1", path="/" + odd),
            signing.record(ip="11.0.0.1", username=odd, password=odd),
            signing.record(ip="11.0.0.1", username=odd + "x"),
        ]
        bodies.append(signing.payload(str(i), "a" * 64 if i else None, records=records))
    envelopes = [signing.envelope(b) for b in bodies]
    files = spark.createDataFrame([(n, bytearray(d), h) for n, d, h in envelopes], "name string, content binary, digest string")
    rows = canonical.decode_batches(files).withColumn("text", canonical.canonical_payload(F.col("payload"))).collect()
    for row in rows:
        assert row.payload is not None and row.payload_hash == row.digest and row.blob_name == row.name
    assert {r.text for r in rows} == {signing.message_of(b)[17:].decode() for b in bodies}


def test_decoding_is_strict(spark):
    _, data, _ = signing.envelope(signing.payload())
    text = data.decode()
    spoiled = [
        text + " ", " " + text, text + "{}", text.replace('"count":2', '"count":"2"', 1), text.replace('"count":2', '"count":2.0', 1),
        text.replace('{"payload"', '{"extra":1,"payload"'), text.replace('"username":"root"', '"username":"root","username":"root"'),
        text.replace('"username":"root"', '"username":"root","password":""'), text.replace('"key_id":"key-1",', ""), "", "null",
        text.replace("root", "r\\u006fot"), text.replace('"kind":"ssh', '"path":null,"kind":"ssh'),
    ]
    files = spark.createDataFrame([(bytearray(s.encode()),) for s in spoiled] + [(bytearray(b'{"payload":\xff}'),)], "content binary")
    assert all(r.payload is None for r in canonical.decode_batches(files).collect())


def test_signatures(spark):
    # RFC 8032, section 7.1, second test vector.
    secret = bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb")
    public = bytes.fromhex("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c")
    assert signing.public_key(secret) == public
    signature = bytes.fromhex(
        "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"
    )
    assert canonical.ed25519_valid(public, b"\x72", signature) and not canonical.ed25519_valid(public, b"\x73", signature)
    too_large = signature[:32] + (int.from_bytes(signature[32:], "little") + canonical._L).to_bytes(32, "little")
    assert not canonical.ed25519_valid(public, b"\x72", too_large)

    name, data, _ = signing.envelope(signing.payload())
    files = spark.createDataFrame([(bytearray(data),)], "content binary")
    decoded = canonical.decode_batches(files).withColumn("public_key", F.lit(canonical.to_base64url(signing.public_key())))
    tampered = decoded.withColumn("payload", F.col("payload").withField("classifier_version", F.lit("other")))
    assert canonical.verify_signatures(decoded).first().signature_valid
    assert not canonical.verify_signatures(tampered).first().signature_valid


def test_names_are_configurable(spark):
    names = WireNames(namespace="elsewhere")
    body = spark.range(1).select(F.from_json(F.lit(json.dumps(signing.payload())), schemas.PAYLOAD).alias("p"))
    ours, theirs = body.select(canonical.payload_hash(F.col("p")), canonical.payload_hash(F.col("p"), names)).first()
    assert ours != theirs


def walk(candidates, heads=None):
    """Sequential acceptance, one candidate at a time."""
    heads, status = heads or {}, {}
    for source, seq, prev, digest, name in sorted(candidates, key=lambda c: (c[0], c[1], c[4])):
        next_seq, head, done = heads.get(source, (0, "", {}))
        if seq in done:
            status[name] = "replay_conflict"
        elif seq != next_seq:
            status[name] = "sequence_gap"
        elif prev != head:
            status[name] = "hash_chain_mismatch"
        else:
            status[name] = "accepted"
            heads[source] = (seq + 1, digest, {**done, seq: digest})
    return status


@pytest.mark.parametrize("seed", range(3))
def test_chain_acceptance_equals_the_sequential_walk(spark, seed):
    random.seed(seed)
    candidates = []
    for s in range(8):
        pool = [""]
        for seq in range(random.randint(1, 9)):
            made = []
            for k in range(random.choice([1, 1, 1, 2, 3, 0] if s % 2 else [1, 1, 1, 1, 1, 0])):
                prev = random.choice(pool + ["0" * 64]) if s % 2 else pool[0]
                digest = f"{random.getrandbits(256):064x}"
                made.append(digest)
                candidates.append((f"s{s}", seq, prev, digest, f"s{s}/{seq}/{digest}"))
            pool = made or ["f" * 64]
    rows = [(c[0], "e", str(c[1]), c[2] or None, c[3], c[4]) for c in candidates]
    table = spark.createDataFrame(
        rows, "source_id string, source_epoch string, sequence string, previous_batch_hash string, payload_hash string, blob_name string"
    )
    heads = spark.createDataFrame([], "source_id string, source_epoch string, next_sequence string, previous_hash string")
    got = {r.blob_name: r.status for r in acceptance.accept_chain(table, heads).collect()}
    assert got == walk(candidates)


@pytest.mark.parametrize("seed", range(2))
def test_blocks_and_heads_equal_the_sequential_walk(spark, seed):
    """Chains over many small blocks, with rivals, breaks and heads inside blocks."""
    random.seed(seed)
    candidates, heads = [], {}
    for s in range(12):
        first = random.choice([0, 0, 3, 4, 9, 21])
        pool = ["" if not first else "h" * 64]
        if first:
            heads[f"s{s}"] = (first, pool[0], {})
        for seq in range(max(0, first - 2), first + random.randint(1, 30)):
            made = []
            for _ in range(random.choices([1, 2, 0], [30, 4, 1])[0]):
                prev = random.choice(pool) if random.random() < 0.98 else "0" * 64
                digest = f"{random.getrandbits(256):064x}"
                made.append(digest)
                candidates.append((f"s{s}", seq, prev, digest, f"s{s}/{seq}/{digest}"))
            pool = (made or ["f" * 64]) if seq >= first else pool
    rows = [(c[0], "e", str(c[1]), c[2] or None, c[3], c[4]) for c in candidates]
    table = spark.createDataFrame(
        rows, "source_id string, source_epoch string, sequence string, previous_batch_hash string, payload_hash string, blob_name string"
    )
    held = [(s, "e", str(n), h) for s, (n, h, _) in heads.items()]
    frame = spark.createDataFrame(held, "source_id string, source_epoch string, next_sequence string, previous_hash string")
    got = acceptance.accept_chain(table, frame, size=4)
    assert {r.blob_name: r.status for r in got.collect()} == walk(candidates, dict(heads))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # nothing is joined on a sensor


def test_chain_continues_from_stored_heads(spark):
    heads = spark.createDataFrame(
        [("s", "e", "9999999999999999998", "h" * 64)], "source_id string, source_epoch string, next_sequence string, previous_hash string"
    )
    rows = [("s", "e", "9999999999999999998", "h" * 64, "a" * 64, "n")]
    table = spark.createDataFrame(
        rows, "source_id string, source_epoch string, sequence string, previous_batch_hash string, payload_hash string, blob_name string"
    )
    assert acceptance.accept_chain(table, heads).first().status == "accepted"
    moved = acceptance.chain_heads(table).first()
    assert (moved.next_sequence, moved.previous_hash) == ("9999999999999999999", "a" * 64)
