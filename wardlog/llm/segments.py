"""Operator 6: WARC archives with segmented records, written and reassembled.

Writing: a page is an HTTP response in chunked transfer framing. Of pages with
equal payloads the one with the smallest page_id is a ``response``, the others
are ``revisit`` records that refer to it. A block longer than ``SEGMENT`` bytes
is split: the response record is segment 1 and ``continuation`` records follow,
with the origin's identifier, their number and, on the last, the total length.
Archives are closed at ``ARCHIVE`` bytes, so segments may lie in different ones.
Each archive is a row (name, content) whose content is the whole WARC file, in
Parquet that Spark commits.

Reading: archives are cut into records in parallel; continuation records are
grouped with their origin by its identifier, ordered by segment number,
checked for gaps and for the total length, joined, and freed of the chunked
framing. A record's segments are bounded by the record; nothing else is grouped.

Defined cases: a null html is an empty payload; a repeated segment (same origin
and number) counts once; a record with a missing segment, a wrong total length
or damaged framing is returned with ``complete`` false and null payload; rows
that repeat a page_id are separate records; those that also have the smallest
payload are all responses; an empty table gives no archive; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.llm.common import small_batches
from wardlog.session import stage_table

SEGMENT = 16 << 10
CHUNK = 4 << 10
ARCHIVE = 4 << 20
#: Fixed: the archives carry no capture time of their own.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "record_id string, record_type string, target string, payload_digest string, refers_to string, "
    "segment int, origin string, total long, block binary"
)
RECORD_FIELDS = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("target", pa.string()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.string()),
        ("segment", pa.int32()),
        ("origin", pa.string()),
        ("total", pa.int64()),
        ("block", pa.binary()),
    ]
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = (payload[at : at + size] for at in range(0, len(payload), size))
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes | None:
    """The payload, or None where the framing is damaged."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(data[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        if size < 0 or end + 2 + size > len(data):
            return None
        if not size:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + size])
        at = end + 2 + size
        if data[at : at + 2] != b"\r\n":
            return None
        at += 2


def http_payload(block: bytes) -> bytes | None:
    """The payload of an HTTP response block."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:[ \t]*chunked[ \t]*\r?$", head) else body


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_records(
    name: str, url: str | None, payload: bytes, first: str | None, segment: int = SEGMENT, chunk: int = CHUNK
) -> Iterator[bytes]:
    """Records of one page; ``first`` is the response a revisit refers to."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    common = [("WARC-Date", DATE), ("WARC-Target-URI", target)]
    digest = ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}")
    kind = ("Content-Type", "application/http; msgtype=response")
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if first is not None:
        block = status + b"Content-Length: %d\r\n\r\n" % len(payload)
        more = [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{first}>"), digest, kind]
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{name}>"), *common, *more], block)
        return
    block = status + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    number = [("WARC-Segment-Number", "1")] if len(parts) > 1 else []
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{name}>"), *common, digest, kind, *number], parts[0])
    for n, part in enumerate(parts[1:], 2):
        more = [("WARC-Segment-Number", str(n)), ("WARC-Segment-Origin-ID", f"<{name}>")]
        more += [("WARC-Segment-Total-Length", str(len(block)))] if n == len(parts) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name}:{n}>"), *common, *more], part)


def parse(content: bytes) -> Iterator[dict]:
    """The records of one archive; raises on a damaged one."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(fields["content-length"])
        block = content[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError(f"record at byte {at} is cut off")
        number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
        bare = lambda key: fields[key].strip("<>") if key in fields else None
        yield {
            "record_id": bare("warc-record-id"),
            "record_type": fields.get("warc-type"),
            "target": fields.get("warc-target-uri"),
            "payload_digest": fields.get("warc-payload-digest", "").rpartition(":")[2] or None,
            "refers_to": bare("warc-refers-to"),
            "segment": int(number) if number else None,
            "origin": bare("warc-segment-origin-id"),
            "total": int(total) if total else None,
            "block": block,
        }
        at = end + 4 + size + 4


def write_archives(
    pages: DataFrame, folder: str, segment: int = SEGMENT, chunk: int = CHUNK, archive: int = ARCHIVE, least: int = 0
) -> None:
    """Archives of ``pages`` (page_id, url, html) below ``folder``. Payloads
    shorter than ``least`` bytes are never revisits."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    )
    # A record is named by its page; where page_ids repeat, all rows but one by their place in the input too.
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    repeats = rows.groupBy("page_id").agg(F.min("at").alias("own"), F.count("*").alias("n")).where("n > 1")
    # written first, so that the planner knows its size and pages need not move for it
    repeats = stage_table(repeats.select(F.col("page_id").alias("page"), "own"), "repeats")
    plain = F.concat(F.lit("urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    name = F.when(F.col("at") != F.col("own"), F.concat(plain, F.lit(":r"), F.col("at").cast("string"))).otherwise(plain)
    rows = rows.join(repeats, F.col("page_id").eqNullSafe(F.col("page")), "left").withColumn("name", name)
    key = F.sha2("payload", 256)
    least_page = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "name"))).alias("first")
    firsts = rows.groupBy(key.alias("sha")).agg(least_page, F.count("*").alias("n"))
    shared = firsts.where("n > 1").select("sha", "first")
    marked = rows.withColumn("sha", key).join(shared, "sha", "left")
    other = (F.octet_length("payload") >= least) & (F.col("first.page_id") < F.col("page_id"))
    ready = marked.select("name", "url", "payload", F.when(other, F.col("first.name")).alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            name = f"pages-{part:06d}-{number:05d}.warc"
            info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-info:{name}>"), ("WARC-Date", DATE)], b"")
            return pa.RecordBatch.from_pydict(
                {"name": pa.array([name]), "content": pa.array([b"".join([info, *held])], pa.binary())}
            )

        for batch in small_batches(batches, 256):
            for name, url, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for data in page_records(name, url, payload, first, segment, chunk):
                    held.append(data)
                    size += len(data)
                    if size >= archive:
                        yield close()
                        number, held, size = number + 1, [], 0
        if held:
            yield close()

    ready.mapInArrow(write, "name string, content binary").write.mode("errorifexists").parquet(folder)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives, as it stands there."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            found = list(parse(batch.column(0)[0].as_py()))
            for at in range(0, len(found), 512):
                yield pa.RecordBatch.from_pylist(found[at : at + 512], schema=RECORD_FIELDS)

    return spark.read.parquet(folder).select("content").mapInArrow(read, RECORD_SCHEMA)


def reassemble(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """(record_id, record_type, target, payload_digest, refers_to, payload_bytes,
    computed_digest, complete, payload) of every response and revisit, segments
    joined. A revisit has no payload, only its length."""
    fields = ["record_type", "target", "payload_digest", "refers_to"]
    main = F.col("record_type").isin("response", "revisit")
    whole = records.where(main & F.col("segment").isNull()).select(
        "record_id", *fields, F.array(F.struct(F.lit(1).alias("segment"), "block")).alias("segments"),
        F.lit(None).cast("long").alias("total"),
    )
    parts = records.where(F.col("segment").isNotNull())
    head = F.col("origin").isNull()
    grouped = parts.groupBy(F.coalesce("origin", "record_id").alias("record_id")).agg(
        *(F.max(F.when(head, F.col(f))).alias(f) for f in fields),
        F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("segments"),
        F.coalesce(F.max("total"), F.lit(-1).cast("long")).alias("total"),
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 256):
            rows = batch.select(["segments", "total", "record_type"]).to_pylist()
            out = {"payload": [], "payload_bytes": [], "computed_digest": [], "complete": []}
            for row in rows:
                numbers = [s["segment"] for s in row["segments"]]
                block = b"".join(s["block"] for s in row["segments"])
                right = numbers == list(range(1, len(numbers) + 1)) and row["total"] in (None, len(block))
                payload, size = None, None
                if right and row["record_type"] == "revisit":
                    found = re.search(rb"(?im)^content-length:[ \t]*(\d+)", block)
                    size = int(found[1]) if found else None
                elif right:
                    payload = http_payload(block)
                    size = None if payload is None else len(payload)
                out["payload"].append(payload if with_payload else None)
                out["computed_digest"].append(None if payload is None else sha1_base32(payload))
                out["payload_bytes"].append(size)
                out["complete"].append(size is not None)
            kinds = dict(payload=pa.binary(), payload_bytes=pa.int64(), computed_digest=pa.string(), complete=pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in ("record_id", *fields)), *(pa.array(v, kinds[k]) for k, v in out.items())],
                names=["record_id", *fields, *out],
            )

    schema = (
        "record_id string, record_type string, target string, payload_digest string, refers_to string, "
        "payload binary, payload_bytes long, computed_digest string, complete boolean"
    )
    return whole.unionByName(grouped).mapInArrow(join, schema)


def captures(records: DataFrame) -> DataFrame:
    """Per page: its number from the record's identifier, the payload's digest
    computed again where there is a payload, else as the revisit states it."""

    rows = reassemble(records, with_payload=False)
    own = F.col("computed_digest")
    return rows.select(
        F.expr("try_cast(regexp_extract(record_id, '^urn:x-page:(-?[0-9]*)', 1) AS BIGINT)").alias("page_id"),
        "payload_bytes",
        F.coalesce(own, "payload_digest").alias("payload_digest"),
        "record_type",
        F.expr("try_cast(regexp_extract(refers_to, '^urn:x-page:(-?[0-9]*)', 1) AS BIGINT)").alias("refers_to"),
        "complete",
        (own == F.col("payload_digest")).alias("digest_ok"),
    )
