"""Operator 6: archives written, damaged, read and reassembled."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wardlog.llm import segments
from wardlog.session import new_folder

PAGES = "page_id long, url string, html string, payload string, origin string"


def pages_of(spark):
    rows = [
        (3, "http://a.example/x y\r\nInjected: 1", "<p>same</p>"),
        (1, "http://b.example/", "<p>same</p>"),
        (9, None, "<p>same</p>"),
        (4, "http://c.example/", None),
        (2, "http://c.example/2", ""),
        (5, "http://d.example/", "WARC/1.1\r\n\r\n0\r\n\r\n" + "ünï 中 " * 9_000),
        (6, "http://e.example/", "x" * 100),
        (6, "http://e.example/", "x" * 100),
    ]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES).repartition(3)


def read(spark, pages, **options):
    folder = new_folder(spark, "warc-test")
    segments.write_archives(pages, folder, **options)
    return segments.read_records(spark, folder)


def wanted(pages, least=0):
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for page, payload in rows:
        first[payload] = min(page, first.get(payload, page))
    out = []
    for page, payload in rows:
        other = first[payload] < page and len(payload) >= least
        digest = segments.sha1_base32(payload)
        out.append((page, len(payload), digest, "revisit" if other else "response", first[payload] if other else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"segment": 64, "chunk": 10, "archive": 300}, {"least": 1}])
def test_pages_come_back(spark, options):
    pages = pages_of(spark)
    rows = segments.captures(read(spark, pages, **options)).collect()
    assert all(r.complete for r in rows) and all(r.digest_ok in (True, None) for r in rows)
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[f] for f in fields) for r in rows), key=repr) == wanted(pages, options.get("least", 0))


def test_payloads_come_back_whole(spark):
    pages = pages_of(spark)
    whole = segments.reassemble(read(spark, pages, segment=50, chunk=7)).where("record_type = 'response'").collect()
    assert {bytes(r.payload) for r in whole} == {(r.html or "").encode() for r in pages.collect()}


def test_broken_segments_are_reported(spark):
    pages = spark.createDataFrame([(1, "u", "a" * 500)], "page_id long, url string, html string")
    records = read(spark, pages, segment=100)
    assert records.where("segment is not null").count() > 4

    def one(some):
        (row,) = segments.reassemble(some).collect()
        return row.complete, row.payload

    assert one(records.union(records)) == (True, bytearray(b"a" * 500))  # repeated segments count once
    assert one(records.where("segment is null or segment != 3")) == (False, None)
    assert one(records.where("total is null")) == (False, None)  # the last one is missing
    wrong = records.withColumn("total", records.total + 1)
    assert one(wrong) == (False, None)


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert segments.captures(read(spark, none)).count() == 0


@given(st.binary(max_size=300), st.integers(1, 50))
@settings(max_examples=150, deadline=None)
def test_chunked_framing(payload, size):
    framed = segments.chunked(payload, size)
    assert segments.unchunked(framed) == payload
    assert segments.unchunked(framed[:-3]) is None or not framed[:-3]
    assert segments.http_payload(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + framed) == payload


@pytest.mark.parametrize("bad", [b"", b"zz\r\n", b"5\r\nab\r\n0\r\n\r\n", b"-1\r\n\r\n", b"2\r\nabXX0\r\n\r\n"])
def test_damaged_framing(bad):
    assert segments.unchunked(bad) is None


def test_damaged_archive_raises():
    good = b"".join(segments.page_records("urn:x-page:1:0-0", "u", b"body", None))
    assert [r["record_type"] for r in segments.parse(good)] == ["response"]
    for bad in (good[:-9], b"x" + good):
        with pytest.raises(ValueError):
            list(segments.parse(bad))


def test_digest_form():
    assert segments.sha1_base32(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert len(hashlib.sha1(b"").digest()) == 20


def test_references_name_records(spark, tmp_path):
    """Each identifier is unique, and what a revisit refers to is a response's, repeated and null page_ids included."""
    rows = [(5, "u", "same"), (5, "v", "same"), (5, "w", "other"), (2, "u", "same"), (7, "u", "other"), (9, "x", "own"), (None, "y", "same"), (None, "z", "last")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = {}
    for n in (1, 2):  # written twice, the same names
        segments.write_archives(pages, str(tmp_path / f"warc{n}"))
        found[n] = segments.read_records(spark, str(tmp_path / f"warc{n}")).where("record_type in ('response', 'revisit')").collect()
    ids = [r.record_id for r in found[1]]
    assert len(set(ids)) == len(ids) == len(rows)
    responses = {r.record_id for r in found[1] if r.record_type == "response"}
    refers = {r.record_id: r.refers_to for r in found[1] if r.record_type == "revisit"}
    assert set(refers.values()) <= responses and refers["urn:x-page:7"] in {i for i in responses if i.startswith("urn:x-page:5")}
    assert sum(v == "urn:x-page:2" for v in refers.values()) == 2
    assert sorted((r.record_id, r.refers_to or "") for r in found[2]) == sorted((r.record_id, r.refers_to or "") for r in found[1])
