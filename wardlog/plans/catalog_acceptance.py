"""Registered queries: batches, acceptance, validation, delivery."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlog.functions import text
from wardlog.functions.times import strict_utc
from wardlog.operators import acceptance, batching, canonical, delivery, validate
from wardlog.operators.evidence import merge_evidence
from wardlog.operators.rollup import period_dimensions, period_totals
from wardlog.plans.catalog_rollup import facts_of
from wardlog.plans.fixtures import (
    DIMENSIONS_CTE,
    EPOCH,
    EVIDENCE_CTE,
    OBS_CTE,
    PROMOTED_CTE,
    Catalog,
    Fixture,
)

catalog = Catalog()
add = catalog.add

# One batch candidate per event: the sensor is event_id % 3, the sequence the
# event's place among that sensor's ids. Hashes stand in for content.

def blob(hash_sql: str, seq: str = "seq") -> str:
    return f"concat(source_id, '/{EPOCH}/', length(CAST({seq} AS VARCHAR)), '-', {seq}, '/', {hash_sql}, '.json')"


BASE_CTE = f"""
numbered AS (SELECT concat('sensor-', event_id % 3) AS source_id, event_id // 3 AS seq, event_type, ts FROM events),
bounds AS (SELECT max(seq) AS top FROM numbered),
hashed AS (SELECT source_id, seq, event_type, ts, sha256(concat(source_id, '/', seq)) AS hash,
  CASE WHEN seq = 0 THEN NULL WHEN source_id = 'sensor-1' AND seq = (SELECT top * 7 // 10 FROM bounds) THEN repeat('b', 64)
    ELSE sha256(concat(source_id, '/', seq - 1)) END AS prev FROM numbered
  WHERE NOT (source_id = 'sensor-2' AND seq = (SELECT top * 8 // 10 FROM bounds))),
named AS (SELECT *, {blob('hash')} AS blob_name FROM hashed)"""


def numbered(fx: Fixture):
    events = fx.table("events")
    return events.select(
        F.concat(F.lit("sensor-"), (F.col("event_id") % 3).cast("string")).alias("source_id"),
        F.floor(F.col("event_id") / 3).alias("seq"),
        "event_type",
        F.col("ts").cast("timestamp").alias("ts"),
    )


def stand_in(seq):
    return F.sha2(F.concat("source_id", F.lit("/"), seq.cast("string")), 256)


def named(rows):
    """Candidate columns from source_id, seq, hash and prev."""
    return (
        rows.withColumn("source_epoch", F.lit(EPOCH))
        .withColumn("sequence", F.col("seq").cast("string"))
        .withColumnRenamed("hash", "payload_hash")
        .withColumnRenamed("prev", "previous_batch_hash")
        .withColumn(
            "blob_name", text.blob_name(F.col("source_id"), F.col("source_epoch"), F.col("sequence"), F.col("payload_hash"))
        )
    )


def candidates(fx: Fixture):
    """Chains with a broken link in sensor-1 and a hole in sensor-2."""
    rows = numbered(fx)
    top = rows.agg(F.max("seq").alias("top")).first().top
    broken = (F.col("source_id") == "sensor-1") & (F.col("seq") == top * 7 // 10)
    hole = (F.col("source_id") == "sensor-2") & (F.col("seq") == top * 8 // 10)
    rows = rows.where(~hole).select(
        "source_id",
        "seq",
        "event_type",
        "ts",
        stand_in(F.col("seq")).alias("hash"),
        F.when(F.col("seq") == 0, F.lit(None))
        .when(broken, F.lit("b" * 64))
        .otherwise(stand_in(F.col("seq") - 1))
        .alias("prev"),
    )
    return named(rows)


def no_heads(fx: Fixture):
    return fx.spark.createDataFrame(
        [], "source_id string, source_epoch string, next_sequence string, previous_hash string"
    )


@add(
    "accept_chain",
    f"""WITH {BASE_CTE},
    checked AS (SELECT *, seq = row_number() OVER w - 1 AND coalesce(prev, '') = coalesce(lag(hash) OVER w, '') AS ok,
      seq = row_number() OVER w - 1 AS dense FROM named WINDOW w AS (PARTITION BY source_id ORDER BY seq)),
    run AS (SELECT *, bool_and(ok) OVER (PARTITION BY source_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS good FROM checked),
    front AS (SELECT source_id, count(*) FILTER (good) AS front FROM run GROUP BY source_id)
    SELECT source_id, CAST(seq AS VARCHAR) AS sequence, CASE WHEN good THEN 'accepted' WHEN seq = front THEN 'hash_chain_mismatch'
      ELSE 'sequence_gap' END AS status FROM run JOIN front USING (source_id)""",
)
def accept_chain(fx: Fixture):
    return acceptance.accept_chain(candidates(fx), no_heads(fx)).select("source_id", "sequence", "status")


@add("accept_chain_with_heads", f"{catalog.oracles['accept_chain']} WHERE seq >= 5")
def accept_chain_with_heads(fx: Fixture):
    """A second run: the first five sequences are accepted, the others go on from their heads."""
    rows = candidates(fx)
    first = acceptance.accept_chain(rows.where("seq < 5"), no_heads(fx)).where("status = 'accepted'")
    later = acceptance.accept_chain(rows.where("seq >= 5"), acceptance.chain_heads(first))
    return later.select("source_id", "sequence", "status")


RIVALS_CTE = f"""{BASE_CTE},
forks AS (SELECT source_id, seq, hash, prev FROM named
  UNION ALL SELECT source_id, seq, sha256(concat('r/', source_id, '/', seq)), prev FROM named WHERE event_type = 'error'
  UNION ALL SELECT source_id, seq + 1, sha256(concat('s/', source_id, '/', seq)), sha256(concat('r/', source_id, '/', seq)) FROM named
    WHERE event_type = 'error'
  UNION ALL SELECT source_id, seq, sha256(concat('x/', source_id, '/', seq)), repeat('c', 64) FROM named WHERE event_type = 'purchase'),
rivals AS (SELECT *, {blob('hash')} AS blob_name FROM forks)"""


def rivals(fx: Fixture):
    """Rival batches at many sequences of sensors: same predecessor with other
    content, children of those rivals, and batches with a foreign predecessor."""
    base = candidates(fx)
    plain = base.select("source_id", "seq", F.col("payload_hash").alias("hash"), F.col("previous_batch_hash").alias("prev"))
    other = lambda mark: F.sha2(F.concat(F.lit(f"{mark}/"), "source_id", F.lit("/"), F.col("seq").cast("string")), 256)
    at_error, at_purchase = base.where("event_type = 'error'"), base.where("event_type = 'purchase'")
    forks = (
        plain.unionByName(
            at_error.select("source_id", "seq", other("r").alias("hash"), F.col("previous_batch_hash").alias("prev"))
        )
        .unionByName(
            at_error.select("source_id", (F.col("seq") + 1).alias("seq"), other("s").alias("hash"), other("r").alias("prev"))
        )
        .unionByName(at_purchase.select("source_id", "seq", other("x").alias("hash"), F.lit("c" * 64).alias("prev")))
    )
    return named(forks)


@add(
    "accept_chain_forked",
    f"""WITH RECURSIVE {RIVALS_CTE},
    best AS (SELECT source_id, seq, coalesce(prev, '') AS prev, min(blob_name) AS blob_name, min_by(hash, blob_name) AS hash
      FROM rivals GROUP BY ALL),
    walk AS (
      SELECT source_id, seq, hash, blob_name FROM best WHERE seq = 0 AND prev = ''
      UNION ALL
      SELECT b.source_id, b.seq, b.hash, b.blob_name FROM walk w JOIN best b
        ON b.source_id = w.source_id AND b.seq = w.seq + 1 AND b.prev = w.hash),
    front AS (SELECT source_id, max(seq) + 1 AS front FROM walk GROUP BY source_id)
    SELECT r.source_id, CAST(r.seq AS VARCHAR) AS sequence, r.hash AS payload_hash,
      CASE WHEN r.blob_name = w.blob_name THEN 'accepted' WHEN r.blob_name > w.blob_name THEN 'replay_conflict'
        WHEN w.blob_name IS NOT NULL THEN 'hash_chain_mismatch'
        WHEN r.seq = coalesce(f.front, 0) THEN 'hash_chain_mismatch' ELSE 'sequence_gap' END AS status
    FROM rivals r LEFT JOIN walk w ON r.source_id = w.source_id AND r.seq = w.seq LEFT JOIN front f ON r.source_id = f.source_id""",
)
def accept_chain_forked(fx: Fixture):
    out = acceptance.accept_chain(rivals(fx), no_heads(fx))
    return out.select("source_id", "sequence", "payload_hash", "status")


@add(
    "mark_replays",
    f"""WITH {BASE_CTE}, known AS (SELECT * FROM named WHERE seq < (SELECT top // 2 FROM bounds))
    SELECT n.source_id, CAST(n.seq AS VARCHAR) AS sequence, CASE WHEN k.hash IS NULL THEN NULL
      WHEN n.event_type = 'error' THEN 'replay_conflict' ELSE 'replay' END AS status
    FROM named n LEFT JOIN known k ON n.source_id = k.source_id AND n.seq = k.seq""",
)
def mark_replays(fx: Fixture):
    rows = candidates(fx)
    half = numbered(fx).agg(F.max("seq").alias("top")).first().top // 2
    known = rows.where(F.col("seq") < half)
    changed = rows.withColumn(
        "payload_hash", F.when(F.col("event_type") == "error", F.lit("d" * 64)).otherwise(F.col("payload_hash"))
    )
    return acceptance.mark_replays(changed, known).select("source_id", "sequence", "status")


@add(
    "chain_heads",
    f"""WITH {BASE_CTE} SELECT source_id, CAST(max(seq) + 1 AS VARCHAR) AS next_sequence, max_by(hash, seq) AS previous_hash
    FROM named GROUP BY source_id""",
)
def chain_heads(fx: Fixture):
    return acceptance.chain_heads(candidates(fx)).drop("source_epoch")


@add(
    "verify_chain",
    f"""WITH {BASE_CTE}, per AS (SELECT source_id, count(*) AS n, max(seq) AS last, count(DISTINCT seq) AS steps,
      bool_or(event_type = 'error' AND source_id = 'sensor-0') AS bad FROM named GROUP BY source_id)
    SELECT source_id, CASE WHEN last + 1 <> steps THEN 'chain_not_contiguous' WHEN n <> steps THEN 'repeated_sequence'
      ELSE 'invalid_name_or_hash' END AS violation FROM per WHERE last + 1 <> steps OR n <> steps OR bad""",
)
def verify_chain(fx: Fixture):
    """The hole in sensor-2 and wrong names in sensor-0 must show."""
    renamed = F.when(
        (F.col("source_id") == "sensor-0") & (F.col("event_type") == "error"), F.lit("elsewhere.json")
    ).otherwise(F.col("blob_name"))
    stored = candidates(fx).withColumn("blob_name", renamed)
    return acceptance.verify_chain(stored).drop("source_epoch")


@add(
    "run_summary",
    f"""WITH {BASE_CTE} SELECT CASE event_type WHEN 'error' THEN 'quarantined' WHEN 'view' THEN 'replayed' ELSE 'accepted' END AS outcome,
      count(*) AS batches FROM named GROUP BY 1""",
)
def run_summary(fx: Fixture):
    status = (
        F.when(F.col("event_type") == "error", "invalid_time")
        .when(F.col("event_type") == "view", "replay")
        .otherwise("accepted")
    )
    return acceptance.run_summary(candidates(fx).withColumn("status", status))


@add(
    "latest_update",
    "SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM events",
)
def latest_update(fx: Fixture):
    out = acceptance.latest_update(fx.obs, F.col("observed_at"))
    return out.select(F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated_at"))


# The sensor dimension of these queries: one registration per user id, so it
# grows with the data; some are disabled, some ids are missing.
REGISTRY_CTE = """
registry AS (SELECT DISTINCT concat('user-', user_id) AS source_id, user_id % 5 <> 0 AS enabled,
  CASE WHEN user_id % 2 = 0 THEN 'decoy' ELSE 'host' END AS kind, concat('key-', user_id % 7) AS key_id,
  CASE WHEN user_id % 4 = 0 THEN '' ELSE concat('owner-', user_id, '/batches') END AS repository FROM events WHERE user_id % 11 <> 0)"""


def registry(fx: Fixture):
    user = F.col("user_id")
    return (
        fx.table("events")
        .where(user % 11 != 0)
        .select(
            F.concat(F.lit("user-"), user.cast("string")).alias("source_id"),
            F.lit(EPOCH).alias("source_epoch"),
            (user % 5 != 0).alias("enabled"),
            F.when(user % 2 == 0, "decoy").otherwise("host").alias("kind"),
            F.concat(F.lit("key-"), (user % 7).cast("string")).alias("key_id"),
            F.lit(None).cast("string").alias("public_key"),
            F.concat(F.lit("user-"), user.cast("string"), F.lit(f"/{EPOCH}/")).alias("blob_prefix"),
            F.when(user % 4 == 0, "").otherwise(F.concat(F.lit("owner-"), user.cast("string"), F.lit("/batches"))).alias("repository"),
        )
        .distinct()
    )


def by_user(fx: Fixture):
    return fx.table("events").withColumn("ts", F.col("ts").cast("timestamp")).select(
        "*", F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source_id"), F.lit(EPOCH).alias("source_epoch")
    )


@add(
    "join_registry",
    f"""WITH {REGISTRY_CTE} SELECT event_id, coalesce(r.source_id IS NOT NULL, false) AS registered, r.enabled, r.kind AS source_kind
    FROM events e LEFT JOIN registry r ON concat('user-', e.user_id) = r.source_id""",
)
def join_registry(fx: Fixture):
    out = acceptance.join_registry(by_user(fx), registry(fx))
    return out.select("event_id", F.coalesce("registered", F.lit(False)).alias("registered"), "enabled", "source_kind")


@add(
    "quarantine_reason",
    f"""WITH {REGISTRY_CTE} SELECT event_id, CASE
      WHEN event_id % 17 = 3 THEN 'invalid_size' WHEN event_id % 19 = 4 THEN 'invalid_envelope'
      WHEN r.source_id IS NULL OR NOT r.enabled THEN 'unregistered_source'
      WHEN concat('key-', event_id % 7) <> r.key_id AND event_id % 3 = 0 THEN 'unregistered_key'
      WHEN event_id % 23 = 5 THEN 'invalid_blob_name' WHEN event_id % 29 = 6 THEN 'invalid_signature'
      WHEN e.ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-28 00:05:00' THEN 'invalid_time' END AS reason
    FROM events e LEFT JOIN registry r ON concat('user-', e.user_id) = r.source_id""",
)
def quarantine_reason(fx: Fixture):
    event = F.col("event_id")
    key = F.when(event % 3 == 0, F.concat(F.lit("key-"), (event % 7).cast("string"))).otherwise(F.col("registered_key_id"))
    created = F.col("ts") + F.expr("INTERVAL 1 HOUR")
    utc = lambda ts: strict_utc(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    rows = (
        acceptance.join_registry(by_user(fx), registry(fx))
        .withColumn("size_ok", event % 17 != 3)
        .withColumn("envelope_ok", event % 19 != 4)
        .withColumn("key_ok", key == F.col("registered_key_id"))
        .withColumn("name_ok", event % 23 != 5)
        .withColumn("signature_ok", event % 29 != 6)
        .withColumn("time_ok", validate.central_timing(utc(F.col("ts")), utc(created), F.lit("2024-01-28").cast("timestamp")))
    )
    return validate.quarantine_reason(rows).select("event_id", "reason")


@add(
    "central_timing",
    """SELECT event_id, event_type <> 'error' AND ts <= TIMESTAMP '2024-01-20 12:05:00' AS timely FROM events""",
)
def central_timing(fx: Fixture):
    """Windows that end after creation, and clocks ahead of now."""
    at = F.col("ts").cast("timestamp")
    utc = lambda ts: strict_utc(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    end = F.when(F.col("event_type") == "error", at + F.expr("INTERVAL 1 SECOND")).otherwise(at)
    timely = validate.central_timing(utc(end), utc(at), F.lit("2024-01-20 12:00:00").cast("timestamp"))
    return fx.table("events").select("event_id", timely.alias("timely"))


@add(
    "refresh_kinds",
    f"""WITH {REGISTRY_CTE}, heads AS (SELECT concat('user-', user_id) AS source_id, count(*) AS n FROM events GROUP BY user_id)
    SELECT h.source_id, coalesce(r.kind, 'old') AS kind, n FROM heads h LEFT JOIN registry r ON h.source_id = r.source_id""",
)
def refresh_kinds(fx: Fixture):
    heads = by_user(fx).groupBy("source_id", "source_epoch").agg(F.count("*").alias("n")).withColumn("kind", F.lit("old"))
    return acceptance.refresh_kinds(heads, registry(fx)).select("source_id", "kind", "n")


HEADS_CTE = "heads AS (SELECT concat('user-', user_id) AS source_id, CAST(max(event_id) // 2 AS VARCHAR) AS next_sequence FROM events WHERE event_type = 'error' GROUP BY user_id)"


def user_heads(fx: Fixture):
    return (
        by_user(fx)
        .where("event_type = 'error'")
        .groupBy("source_id", "source_epoch")
        .agg(F.floor(F.max("event_id") / 2).cast("string").alias("next_sequence"))
    )


@add(
    "fetch_targets",
    f"""WITH {REGISTRY_CTE}, {HEADS_CTE} SELECT r.source_id, r.repository, coalesce(next_sequence, '0') AS next_sequence
    FROM registry r LEFT JOIN heads h ON r.source_id = h.source_id WHERE enabled AND repository <> ''""",
)
def fetch_targets(fx: Fixture):
    return acceptance.fetch_targets(registry(fx), user_heads(fx)).drop("source_epoch")


@add(
    "select_new_batches",
    f"""WITH {REGISTRY_CTE}, {HEADS_CTE}, listing AS (
      SELECT concat('user-', user_id) AS source_id, concat('owner-', user_id, '/batches') AS repository,
        event_id AS seq, event_type, sha256(CAST(event_id AS VARCHAR)) AS hash FROM events),
    targets AS (SELECT r.source_id, r.repository, CAST(coalesce(next_sequence, '0') AS BIGINT) AS next_seq FROM registry r
      LEFT JOIN heads h ON r.source_id = h.source_id WHERE enabled AND repository <> ''),
    ready AS (SELECT l.* FROM listing l
      JOIN targets t ON l.source_id = t.source_id AND l.repository = t.repository WHERE seq >= next_seq AND event_type NOT IN ('purchase', 'view'))
    SELECT source_id, CAST(seq AS VARCHAR) AS sequence, concat(source_id, '/{EPOCH}/', length(CAST(seq AS VARCHAR)), '-', seq, '/', hash, '.json') AS path
    FROM ready""",
)
def select_new_batches(fx: Fixture):
    """A file per event in its user's listing; links and files already here
    are passed over."""
    files = by_user(fx).withColumn("sequence", F.col("event_id").cast("string"))
    listing = files.select(
        F.concat(F.lit("owner-"), F.col("user_id").cast("string"), F.lit("/batches")).alias("repository"),
        text.blob_name(
            F.col("source_id"), F.col("source_epoch"), F.col("sequence"), F.sha2(F.col("event_id").cast("string"), 256)
        ).alias("path"),
        F.when(F.col("event_type") == "view", "120000").otherwise("100644").alias("mode"),
        F.lit("blob").alias("type"),
        F.sha1(F.col("event_id").cast("string")).alias("sha"),
        F.lit(2048).cast("bigint").alias("size"),
        "event_type",
    )
    here = listing.where("event_type = 'purchase'").select("path")
    targets = acceptance.fetch_targets(registry(fx), user_heads(fx))
    return delivery.select_new_batches(listing.drop("event_type"), targets, here).select("source_id", "sequence", "path")


@add(
    "verify_blob_sha",
    """SELECT doc_id FROM documents WHERE lang <> 'de'""",
)
def verify_blob_sha(fx: Fixture):
    """Object ids of whole documents; those in one language are altered."""
    docs = fx.table("documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"), "lang"
    )
    listing = docs.select(
        "path", delivery.git_blob_sha(F.col("content")).alias("sha"), F.octet_length("content").cast("bigint").alias("size")
    )
    altered = F.when(F.col("lang") == "de", F.reverse(F.col("content").cast("string")).cast("binary")).otherwise(F.col("content"))
    received = docs.select("doc_id", "path", altered.alias("content"))
    return delivery.verify_blob_sha(received, listing).select("doc_id")


@add(
    "git_blob_sha",
    r"""SELECT doc_id, sha1(encode(concat('blob ', strlen(text), chr(0), text))) AS sha FROM documents""",
)
def git_blob_sha(fx: Fixture):
    return fx.table("documents").select("doc_id", delivery.git_blob_sha(F.encode("text", "UTF-8")).alias("sha"))


@add(
    "blob_name",
    f"""WITH {BASE_CTE} SELECT blob_name, concat('batch-', seq, '-', hash, '.json') AS file_name,
      concat('batch-', seq, '-', hash, '.receipt.json') AS receipt FROM named""",
)
def blob_name(fx: Fixture):
    file_name = text.file_name(F.col("sequence"), F.col("payload_hash"))
    return candidates(fx).select(
        "blob_name", file_name.alias("file_name"), text.receipt_file_name(file_name).alias("receipt")
    )


@add(
    "reconcile_receipts",
    f"""WITH {BASE_CTE} SELECT source_id, CAST(seq AS VARCHAR) AS sequence, CASE event_type WHEN 'error' THEN 'pending'
      WHEN 'view' THEN 'orphan' WHEN 'click' THEN 'mismatch' ELSE 'acked' END AS status FROM named""",
)
def reconcile_receipts(fx: Fixture):
    rows = candidates(fx).withColumn("envelope_sha256", F.sha2("blob_name", 256)).withColumn("etag", F.lit('"0x1"'))
    pending = rows.where("event_type <> 'view'")
    receipts = rows.where("event_type <> 'error'").withColumn(
        "envelope_sha256",
        F.when(F.col("event_type") == "click", F.lit("e" * 64)).otherwise(F.col("envelope_sha256")),
    )
    return delivery.reconcile_receipts(pending, receipts).select("source_id", "sequence", "status")


@add(
    "validate_receipts",
    f"""WITH {BASE_CTE} SELECT source_id, CAST(seq AS VARCHAR) AS sequence, CASE event_type WHEN 'error' THEN 'hashes'
      WHEN 'view' THEN 'blob_name' WHEN 'click' THEN 'etag' END AS reject_reason FROM named""",
)
def validate_receipts(fx: Fixture):
    kind = F.col("event_type")
    rows = (
        candidates(fx)
        .withColumn("schema_version", F.lit("wardlog.outbox-receipt/v1"))
        .withColumn("envelope_sha256", F.when(kind == "error", F.lit("XYZ")).otherwise(F.sha2("blob_name", 256)))
        .withColumn("blob_name", F.when(kind == "view", F.lit("elsewhere")).otherwise(F.col("blob_name")))
        .withColumn("etag", F.when(kind == "click", F.lit("bare")).otherwise(F.lit('"0x8D"')))
    )
    return text.validate_receipts(rows).select("source_id", "sequence", "reject_reason")


@add(
    "validate_observations",
    f"""WITH {OBS_CTE} SELECT event_id AS row_id, CASE event_id % 9 WHEN 1 THEN 'schema_version' WHEN 2 THEN 'event_id' WHEN 3 THEN 'cursor'
      WHEN 4 THEN 'observed_at' WHEN 5 THEN 'source_ip' WHEN 6 THEN 'kind'
      WHEN 7 THEN CASE WHEN kind = 'ssh_auth_failure' THEN 'username' ELSE 'request_target' END
      WHEN 8 THEN CASE WHEN kind = 'ssh_auth_failure' THEN 'ssh_payload' ELSE 'http_payload' END END AS reject_reason FROM obs""",
)
def validate_observations(fx: Fixture):
    """One planted fault per residue of the id."""
    fault = lambda n, bad, good: F.when(F.col("event_id") % 9 == n, F.lit(bad)).otherwise(good)
    ssh = F.col("kind") == "ssh_auth_failure"
    user = F.struct(fault(7, "", F.col("username")).alias("username"), F.col("password").alias("password"))
    web = F.struct(fault(7, "/\x01", F.col("request_target")).alias("request_target"), F.col("status").alias("status"))
    both = F.col("event_id") % 9 == 8
    rows = fx.obs.select(
        F.col("event_id").alias("row_id"),
        fault(1, "other/v1", F.lit("wardlog.observation/v1")).alias("schema_version"),
        fault(2, "", F.concat(F.lit("e:"), F.col("event_id").cast("string"))).alias("new_id"),
        fault(3, "c" * 1025, F.lit("cursor")).alias("cursor"),
        fault(4, "2024-01-01T00:00:00+00:00", F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("observed_at"),
        fault(5, "::ffff:1.2.3.4", F.col("source_ip")).alias("source_ip"),
        fault(6, "other", F.col("kind")).alias("kind"),
        F.when(ssh | both, user).alias("ssh"),
        F.when(~ssh | both, web).alias("http"),
    ).withColumnRenamed("new_id", "event_id")
    return validate.validate_observations(rows).select("row_id", "reject_reason")


def hour_records(fx: Fixture):
    """Records of one sensor-hour chunk each; chunks follow from counts, so a
    batch stays near 500 events at any scale."""
    rows = fx.promoted.withColumn("hour", F.date_trunc("hour", "observed_at"))
    sizes = rows.groupBy("source_id", "hour").agg(F.ceil(F.count("*") / 500).alias("chunks"))
    return (
        rows.join(sizes, ["source_id", "hour"])
        .withColumn("chunk", F.col("event_id") % F.col("chunks"))
        .withColumn("hour_no", ((F.unix_seconds("hour") - 1704067200) / 3600).cast("bigint"))
        .withColumn("sequence", (F.col("hour_no") * 1000 + F.col("chunk") + 1).cast("string"))
        .drop("chunks", "chunk", "hour_no")
    )


BATCH = ["source_id", "source_epoch", "sequence"]
HOURLY_CTE = f"""{PROMOTED_CTE},
chunked AS (SELECT p.*, date_trunc('hour', observed_at) AS hr, CAST(ceil(count(*) OVER (PARTITION BY source_id, date_trunc('hour', observed_at)) / 500.0) AS BIGINT) AS chunks FROM promoted p),
batched AS (SELECT *, CAST((CAST(epoch(hr) AS BIGINT) - 1704067200) // 3600 * 1000 + event_id % chunks + 1 AS VARCHAR) AS sequence FROM chunked)"""


def hour_payloads(fx: Fixture):
    events = hour_records(fx)
    headers = events.select(*BATCH, "hour").distinct().select(
        *BATCH,
        F.sha2("sequence", 256).alias("previous_batch_hash"),
        F.date_format(F.col("hour") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
    )
    return batching.assemble_payloads(events, headers, BATCH, "rules-v1")


ISO_MICRO = "regexp_replace(regexp_replace(strftime({0}, '%Y-%m-%dT%H:%M:%S.%f'), '0+$', ''), '\\.$', '') || 'Z'"
PAYLOAD_CTE = f"""{HOURLY_CTE},
recs AS (SELECT source_id, sequence, hr, kind, source_ip, username, password, path, rules, count(*) AS n,
  {ISO_MICRO.format('min(observed_at)')} AS first_text, {ISO_MICRO.format('max(observed_at)')} AS last_text FROM batched GROUP BY ALL),
jsons AS (SELECT *, concat('{{"count":', n, ',"first_observed_at":"', first_text, '","hourly_buckets":[{{"count":', n, ',"hour":"',
    strftime(hr, '%Y-%m-%dT%H:%M:%SZ'), '"}}],"kind":"', kind, '","last_observed_at":"', last_text, '"',
    CASE WHEN password IS NULL THEN '' ELSE concat(',"password":"', password, '"') END,
    CASE WHEN path IS NULL THEN '' ELSE concat(',"path":"', path, '"') END,
    ',"rule_ids":["', replace(rules, ',', '","'), '"],"source_ip":"', source_ip, '"',
    CASE WHEN username IS NULL THEN '' ELSE concat(',"username":"', username, '"') END, '}}') AS j FROM recs),
docs AS (SELECT source_id, sequence, concat('{{"classifier_version":"rules-v1","created_at":"', strftime(hr + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%SZ'),
    '","observation_window":{{"end":"', strftime(hr + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%SZ'), '","start":"', strftime(hr, '%Y-%m-%dT%H:%M:%SZ'),
    '"}},"previous_batch_hash":"', sha256(sequence), '","records":[',
    string_agg(j, ',' ORDER BY encode(kind), encode(source_ip), encode(coalesce(username, path)), encode(coalesce(password, '')), first_text, rules),
    '],"schema_version":"wardlog.batch/v1","sequence":"', sequence, '","source_epoch":"{EPOCH}","source_id":"', source_id, '"}}') AS doc
  FROM jsons GROUP BY source_id, sequence, hr)"""


@add("canonical_payload", f"WITH {PAYLOAD_CTE} SELECT source_id, sequence, doc FROM docs")
def canonical_payload(fx: Fixture):
    return hour_payloads(fx).select(
        "source_id", "sequence", canonical.canonical_payload(F.col("payload")).alias("doc")
    )


@add(
    "payload_hash",
    f"WITH {PAYLOAD_CTE} SELECT source_id, sequence, sha256(concat('wardlog-batch-v1', chr(0), doc)) AS payload_hash FROM docs",
)
def payload_hash(fx: Fixture):
    return hour_payloads(fx).select(
        "source_id", "sequence", canonical.payload_hash(F.col("payload")).alias("payload_hash")
    )


@add(
    "decode_batches",
    f"""WITH {PAYLOAD_CTE} SELECT source_id, sequence, CASE WHEN CAST(sequence AS BIGINT) // 1000 % 4 = 0
      THEN sha256(concat('wardlog-batch-v1', chr(0), doc)) END AS payload_hash FROM docs""",
)
def decode_batches(fx: Fixture):
    """Envelopes written, some spoiled by a space, an unknown field or
    trailing data, and read back strictly."""
    signed = hour_payloads(fx).select(
        "source_id",
        "sequence",
        F.struct(
            "payload",
            F.struct(
                F.lit("Ed25519").alias("algorithm"), F.lit("key-1").alias("key_id"), F.lit("AA").alias("value")
            ).alias("signature"),
        ).alias("envelope"),
    )
    written = canonical.canonical_envelope(F.col("envelope"))
    kind = F.floor(F.col("sequence").cast("bigint") / 1000) % 4
    spoiled = (
        F.when(kind == 1, F.concat(F.lit(" "), written))
        .when(kind == 2, F.concat(F.regexp_replace(written, r"\}\z", ""), F.lit(',"more":1}')))
        .when(kind == 3, F.concat(written, F.lit(" true")))
        .otherwise(written)
    )
    files = signed.select(
        F.col("source_id").alias("sensor"), F.col("sequence").alias("step"), F.encode(spoiled, "UTF-8").alias("content")
    )
    decoded = canonical.decode_batches(files)
    return decoded.select(
        F.col("sensor").alias("source_id"),
        F.col("step").alias("sequence"),
        F.when(F.col("payload").isNotNull(), F.col("payload_hash")).alias("payload_hash"),
    )


@add(
    "validate_payloads",
    f"""WITH {HOURLY_CTE}, b AS (SELECT source_id, sequence, hr, count(DISTINCT concat_ws('|', kind, source_ip, coalesce(username, path),
        coalesce(password, ''), rules)) AS recs FROM batched GROUP BY ALL)
    SELECT source_id, sequence, CASE extract(hour FROM hr) % 4 WHEN 1 THEN 'previous_batch_hash' WHEN 2 THEN 'record'
      WHEN 3 THEN CASE WHEN recs > 1 THEN 'record_order' END END AS reject_reason FROM b""",
)
def validate_payloads(fx: Fixture):
    """What the builder makes must validate; faults are planted by the hour:
    a short hash, a window that ends too early, records in reverse order."""
    p = F.col("payload")
    hour = F.substring(p["observation_window"]["start"], 12, 2).cast("int") % 4
    early = F.struct(
        p["observation_window"]["start"].alias("start"),
        F.replace(p["observation_window"]["start"], F.lit(":00:00Z"), F.lit(":00:00.0000001Z")).alias("end"),
    )
    planted = p.withField(
        "previous_batch_hash", F.when(hour == 1, F.lit("abc")).otherwise(p["previous_batch_hash"])
    )
    planted = planted.withField("observation_window", F.when(hour == 2, early).otherwise(p["observation_window"]))
    planted = planted.withField("records", F.when(hour == 3, F.reverse(p["records"])).otherwise(p["records"]))
    rows = hour_payloads(fx).withColumn("payload", planted)
    return validate.validate_payloads(rows).select("source_id", "sequence", "reject_reason")


@add(
    "validate_records",
    f"""WITH {PAYLOAD_CTE} SELECT source_id, sequence, kind, source_ip, coalesce(username, path) AS val, coalesce(password, '') AS pw,
      CASE extract(hour FROM hr) % 6 WHEN 1 THEN 'bucket_total' WHEN 2 THEN 'bucket_alignment' WHEN 3 THEN 'rule_ids'
        WHEN 4 THEN 'source_ip' WHEN 5 THEN CASE WHEN kind = 'http_request' THEN 'http_fields' ELSE 'ssh_fields' END END AS reject_reason FROM recs""",
)
def validate_records(fx: Fixture):
    rows = batching.aggregate_records(hour_records(fx), BATCH)
    hour = F.hour(F.date_trunc("hour", "first_at"))
    fault = lambda n, bad, good: F.when(hour % 6 == n, bad).otherwise(good)
    shifted = F.transform(
        "hourly_buckets",
        lambda b: F.struct(F.replace(b["hour"], F.lit(":00:00Z"), F.lit(":00:01Z")).alias("hour"), b["count"].alias("count")),
    )
    floor = F.date_trunc("hour", "first_at")
    label = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    planted = rows.select(
        *BATCH,
        F.col("source_ip").alias("ip"),
        F.coalesce("username", "path").alias("val"),
        F.coalesce("password", F.lit("")).alias("pw"),
        "kind",
        fault(4, F.concat(F.lit("::ffff:"), "source_ip"), F.col("source_ip")).alias("source_ip"),
        fault(5, F.coalesce("username", F.lit("root")), F.col("username")).alias("username"),
        "password",
        fault(5, F.coalesce("path", F.lit("/x")), F.col("path")).alias("path"),
        fault(1, F.col("count") + 1, F.col("count")).alias("count"),
        "first_observed_at",
        "last_observed_at",
        fault(2, shifted, F.col("hourly_buckets")).alias("hourly_buckets"),
        fault(3, F.array(F.lit("Bad Rule")), F.col("rule_ids")).alias("rule_ids"),
        F.date_format(floor, label).alias("window_start"),
        F.date_format(floor + F.expr("INTERVAL 1 HOUR"), label).alias("window_end"),
    )
    return validate.validate_records(planted).select(
        "source_id", "sequence", "kind", F.col("ip").alias("source_ip"), "val", "pw", "reject_reason"
    )


@add(
    "validate_state",
    f"""WITH {PROMOTED_CTE}, {DIMENSIONS_CTE}, {EVIDENCE_CTE}
    SELECT 'period_total' AS check, count(*) FILTER (total < 1 OR total > 9007199254740991) AS violations FROM totals
    UNION ALL SELECT 'dimension_count', count(*) FILTER (cnt - 1 < 1) FROM counts
    UNION ALL SELECT 'dimension_value', count(*) FILTER (value = '') FROM counts
    UNION ALL SELECT 'evidence_key', count(*) FILTER (NOT contains(k, ':')) FROM facts
    UNION ALL SELECT 'evidence_source', 0 UNION ALL SELECT 'evidence_time', 0""",
)
def validate_state(fx: Fixture):
    """State with planted faults: counts one too low, IPv4 keys without length."""
    counts = period_dimensions(fx.buckets).withColumn("count", F.col("count") - 1)
    facts = merge_evidence(facts_of(fx)).withColumn("key", F.regexp_replace("key", r"/32\z", "/31"))
    return validate.state_violations(period_totals(fx.buckets), counts, facts)


@add(
    "record_order",
    f"""WITH {PAYLOAD_CTE} SELECT source_id, sequence, kind, source_ip, coalesce(username, path) AS val, coalesce(password, '') AS pw,
      row_number() OVER (PARTITION BY source_id, sequence ORDER BY encode(kind), encode(source_ip), encode(coalesce(username, path)),
        encode(coalesce(password, '')), first_text, rules) AS position FROM recs""",
)
def record_order(fx: Fixture):
    """Position of every record of a batch in byte order; a batch is bounded."""
    rows = batching.aggregate_records(hour_records(fx), BATCH)
    order = Window.partitionBy(*BATCH).orderBy(*batching.record_order())
    return rows.select(
        "source_id",
        "sequence",
        "kind",
        "source_ip",
        F.coalesce("username", "path").alias("val"),
        F.coalesce("password", F.lit("")).alias("pw"),
        F.row_number().over(order).cast("bigint").alias("position"),
    )
