"""Registered queries: classification, text, addresses, event store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlog.functions import addresses, paths, text, times
from wardlog.operators import classify, events, networks
from wardlog.plans.fixtures import (
    KEY_SQL,
    OBS_CTE,
    PROMOTED_CTE,
    REPS_CTE,
    RULES,
    Catalog,
    Fixture,
    iso,
    joined,
    shown,
)
from wardlog.session import new_folder, stage_table
from wardlog.sinks import event_index
from wardlog.sources import lines
from wardlog.sources.growing import read_logs
from wardlog.streaming.logs import hourly_windows

catalog = Catalog()
add = catalog.add


@add(
    "classify_ssh",
    f"""WITH {PROMOTED_CTE} SELECT event_id, source_ip, username, rules AS rule_ids FROM promoted
    WHERE kind = 'ssh_auth_failure'""",
)
def classify_ssh(fx: Fixture):
    out = classify.classify_ssh(fx.obs, RULES)
    return out.select("event_id", "source_ip", "username", joined("rule_ids").alias("rule_ids"))


@add(
    "http_eligible",
    f"WITH {OBS_CTE}, {REPS_CTE} SELECT event_id, path FROM ruled WHERE eligible",
)
def http_eligible(fx: Fixture):
    target = F.col("request_target")
    rows = fx.obs.where(paths.http_eligible(target, F.col("status"), RULES))
    return rows.select("event_id", paths.strip_query(target).alias("path"))


@add(
    "strip_query",
    """SELECT page_id, regexp_extract(regexp_extract(url, '^[a-z]+://[^/]+(.*)$', 1), '^[^?#]*') AS path FROM pages""",
)
def strip_query(fx: Fixture):
    target = F.regexp_extract("url", "^[a-z]+://[^/]+(.*)$", 1)
    return fx.table("pages").select("page_id", paths.strip_query(target).alias("path"))


@add(
    "path_representations",
    f"""WITH {OBS_CTE}, {REPS_CTE}
    SELECT event_id, ['raw', 'decoded_once', 'decoded_twice'][i] AS name, rep[i] AS value
    FROM (SELECT event_id, rep, unnest(range(1, len(rep) + 1)) AS i FROM reps) r""",
)
def path_representations(fx: Fixture):
    reps = paths.path_representations(paths.strip_query(F.col("request_target")))
    http = fx.obs.where(F.col("kind") == classify.HTTP)
    return http.select("event_id", F.inline(reps).alias("name", "value"))


@add("path_excluded", f"WITH {OBS_CTE}, {REPS_CTE} SELECT event_id, excluded FROM judged")
def path_excluded(fx: Fixture):
    reps = paths.path_representations(paths.strip_query(F.col("request_target")))
    http = fx.obs.where(F.col("kind") == classify.HTTP)
    return http.select(
        "event_id", paths.path_excluded(reps, (), RULES.excluded_path_prefixes).alias("excluded")
    )


@add("path_sensitive", f"WITH {OBS_CTE}, {REPS_CTE} SELECT event_id, sensitive FROM judged")
def path_sensitive(fx: Fixture):
    reps = paths.path_representations(paths.strip_query(F.col("request_target")))
    http = fx.obs.where(F.col("kind") == classify.HTTP)
    return http.select("event_id", paths.path_sensitive(reps, RULES.java_patterns()).alias("sensitive"))


@add(
    "path_sensitive_documents",
    r"""SELECT doc_id, regexp_matches(text, '(?i)[a-z0-9._%+-]+(?:@|%40)[a-z0-9.-]+\.[a-z]{2,}')
      OR regexp_matches(text, '(?i)(?:token|secret|password|api[_-]?key)[=/:%-][^/]+')
      OR regexp_matches(text, 'eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}') AS sensitive FROM documents""",
)
def path_sensitive_documents(fx: Fixture):
    """The same patterns over whole free texts, to compare regex dialects."""
    rep = F.array(F.struct(F.lit("raw").alias("name"), F.col("text").alias("value")))
    return fx.table("documents").select(
        "doc_id", paths.path_sensitive(rep, RULES.java_patterns()).alias("sensitive")
    )


@add(
    "http_rules",
    f"WITH {OBS_CTE}, {REPS_CTE} SELECT event_id, rules AS rule_ids, matched AS matched_representation FROM ruled",
)
def http_rules(fx: Fixture):
    reps = paths.path_representations(paths.strip_query(F.col("request_target")))
    http = fx.obs.where(F.col("kind") == classify.HTTP).withColumn("r", paths.http_rules(reps))
    return http.select("event_id", joined("r.rule_ids").alias("rule_ids"), "r.matched_representation")


@add(
    "classify_http",
    f"""WITH {OBS_CTE}, {REPS_CTE} SELECT event_id, path, matched AS matched_representation, rules AS rule_ids
    FROM ruled WHERE eligible AND NOT excluded AND NOT sensitive AND rules <> ''""",
)
def classify_http(fx: Fixture):
    out = classify.classify_http(fx.obs, RULES)
    return out.select("event_id", "path", "matched_representation", joined("rule_ids").alias("rule_ids"))


@add(
    "promote",
    f"""WITH {PROMOTED_CTE} SELECT event_id, kind, source_ip, username, password, path, CAST(status AS BIGINT) AS status,
    rules AS rule_ids FROM promoted""",
)
def promote(fx: Fixture):
    return fx.promoted.select(
        "event_id", "kind", "source_ip", "username", "password", "path",
        F.col("status").cast("bigint").alias("status"), joined("rule_ids").alias("rule_ids"),
    )


UPDATES = "CASE WHEN event_id % 5 = 0 THEN 'ssh/burst-v1' ELSE 'ssh/pair-v1' END"


@add(
    "merge_rules",
    f"""WITH {PROMOTED_CTE},
    stored AS (SELECT *, CASE WHEN observed_at < TIMESTAMP '2024-01-05 00:00:00' THEN '0' END AS batch FROM promoted),
    updates AS (SELECT event_id, {UPDATES} AS rule, 1 AS copies FROM obs WHERE kind = 'ssh_auth_failure' OR status = 404
      UNION ALL SELECT -1 - event_id, 'ssh/pair-v1', 1 FROM obs WHERE status = 403),
    incoming AS (SELECT event_id, rule FROM updates)
    SELECT coalesce(s.event_id, u.event_id) AS event_id,
      CASE WHEN u.rule IS NOT NULL AND s.kind = 'ssh_auth_failure' AND s.batch IS NULL
        THEN array_to_string(list_sort([s.rules, u.rule]), ',') ELSE s.rules END AS rule_ids,
      CASE WHEN u.rule IS NULL THEN NULL WHEN s.event_id IS NULL THEN 'unknown_event'
        WHEN s.kind <> 'ssh_auth_failure' THEN 'not_ssh' WHEN s.batch IS NOT NULL THEN 'already_batched' END AS update_error,
      s.event_id IS NOT NULL AS promoted
    FROM stored s FULL JOIN incoming u ON s.event_id = u.event_id""",
)
def merge_rules(fx: Fixture):
    stored = fx.promoted.withColumn("promoted", F.lit(True)).withColumn(
        "batch_sequence", F.when(F.col("observed_at") < "2024-01-05", "0")
    )
    rule = F.array(F.expr(UPDATES)).alias("rule_ids")
    updates = (
        fx.obs.where((F.col("kind") == classify.SSH) | (F.col("status") == 404))
        .select("event_id", rule)
        .unionByName(
            fx.obs.where(F.col("status") == 403).select(
                (-1 - F.col("event_id")).alias("event_id"), F.array(F.lit("ssh/pair-v1")).alias("rule_ids")
            )
        )
    )
    return classify.merge_rules(stored, updates).select(
        "event_id", joined("rule_ids").alias("rule_ids"), "update_error", "promoted"
    )


@add(
    "dedup_events",
    f"""WITH {PROMOTED_CTE},
    fresh AS (SELECT * FROM promoted
      UNION ALL SELECT * FROM promoted WHERE observed_at >= TIMESTAMP '2024-01-20 00:00:00'),
    store AS (SELECT event_id FROM promoted WHERE observed_at < TIMESTAMP '2024-01-15 00:00:00')
    SELECT DISTINCT event_id, source_ip, {iso('observed_at')} AS observed_at FROM fresh
    WHERE event_id NOT IN (SELECT event_id FROM store)""",
)
def dedup_events(fx: Fixture):
    at = F.col("observed_at")
    fresh = fx.promoted.unionByName(fx.promoted.where(at >= "2024-01-20"))
    store = fx.promoted.where(at < "2024-01-15")
    return events.dedup_events(fresh, store, F.col("observed_at")).select(
        "event_id", "source_ip", shown("observed_at").alias("observed_at")
    )


@add(
    "event_collisions",
    f"""WITH {PROMOTED_CTE},
    store AS (SELECT event_id, sha256(concat(event_id, '|', source_ip)) AS h FROM promoted WHERE observed_at < TIMESTAMP '2024-01-15 00:00:00'),
    fresh AS (SELECT event_id, sha256(concat(event_id, '|', CASE WHEN kind = 'http_request' THEN 'changed' ELSE source_ip END)) AS h
      FROM promoted)
    SELECT s.event_id, s.h AS kept_hash, f.h AS other_hash FROM store s JOIN fresh f ON s.event_id = f.event_id AND s.h <> f.h""",
)
def event_collisions(fx: Fixture):
    hashed = lambda value: F.sha2(F.concat(F.col("event_id").cast("string"), F.lit("|"), value), 256).alias("event_hash")
    changed = F.when(F.col("kind") == classify.HTTP, "changed").otherwise(F.col("source_ip"))
    store = fx.promoted.where(F.col("observed_at") < "2024-01-15").select("event_id", hashed(F.col("source_ip")))
    fresh = fx.promoted.select("event_id", "observed_at", hashed(changed))
    return events.event_collisions(fresh, store, F.col("observed_at"))


def indexed(fx: Fixture, stored: DataFrame) -> str:
    """An index over stored events: most of them folded, the rest in two later commits."""
    root = new_folder(stored.sparkSession, "index")
    rows = stored.select("event_id", "event_hash", F.pmod("event_id", F.lit(4)).alias("lot"))
    event_index.rebuild(rows.where("lot < 2").withColumn("commit", F.lit("early")), root)
    event_index.append(rows.where("lot = 2"), root, "later")
    event_index.append(rows.where("lot = 3"), root, "last")
    return root


@add("indexed_dedup_events", catalog.oracles["dedup_events"])
def indexed_dedup_events(fx: Fixture):
    """The same, with the store asked through its index."""
    at = F.col("observed_at")
    promoted = events.with_content_hash(fx.promoted).withColumn("event_id", F.col("event_id").cast("string"))
    promoted = stage_table(promoted, "promoted")
    fresh = promoted.unionByName(promoted.where(at >= "2024-01-20"))
    known = event_index.known(fresh, indexed(fx, promoted.where(at < "2024-01-15")))
    return events.dedup_events(fresh, known, at).select(
        F.col("event_id").cast("long").alias("event_id"), "source_ip", shown("observed_at").alias("observed_at")
    )


@add("indexed_event_collisions", catalog.oracles["event_collisions"])
def indexed_event_collisions(fx: Fixture):
    hashed = lambda value: F.sha2(F.concat(F.col("event_id").cast("string"), F.lit("|"), value), 256).alias("event_hash")
    changed = F.when(F.col("kind") == classify.HTTP, "changed").otherwise(F.col("source_ip"))
    promoted = stage_table(fx.promoted.select("event_id", "observed_at", "kind", "source_ip"), "promoted")
    stored = promoted.where(F.col("observed_at") < "2024-01-15").select("event_id", hashed(F.col("source_ip")))
    fresh = promoted.select(F.col("event_id").cast("string").alias("event_id"), "observed_at", hashed(changed))
    found = events.event_collisions(fresh, event_index.known(fresh, indexed(fx, stored)), F.col("observed_at"))
    return found.withColumn("event_id", F.col("event_id").cast("long"))


@add(
    "except_seen",
    f"""WITH {PROMOTED_CTE} SELECT event_id FROM obs WHERE event_id NOT IN (SELECT event_id FROM promoted)""",
)
def except_seen(fx: Fixture):
    """Observations that were not promoted, each given twice."""
    return events.dedup_events(fx.obs.unionAll(fx.obs), fx.promoted, F.col("observed_at")).select("event_id")


@add(
    "union_sources",
    f"""WITH {PROMOTED_CTE}
    SELECT kind, source_kind, count(*) AS n FROM promoted GROUP BY kind, source_kind""",
)
def union_sources(fx: Fixture):
    """The union of the classifier branches, counted per branch."""
    return fx.promoted.groupBy("kind", "source_kind").agg(F.count("*").alias("n"))


IP_NUMBER = """CASE WHEN contains(source_ip, ':') THEN NULL ELSE
  CAST(split_part(source_ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(source_ip, '.', 2) AS BIGINT) * 65536
  + CAST(split_part(source_ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(source_ip, '.', 4) AS BIGINT) END"""
# (first, last) numbers of the networks used below.
TRUSTED = ("11.3.0.0/16", "11.9.0.1/32", "10.0.64.0/18", "2a01:4f8:20::/48")


@add(
    "trusted_anti_join",
    f"""WITH {OBS_CTE}, numbered AS (SELECT *, {IP_NUMBER} AS num FROM obs)
    SELECT event_id, source_ip FROM numbered
    WHERE NOT coalesce(num BETWEEN 184745984 AND 184811519 OR num = 185139201 OR num BETWEEN 167788544 AND 167804927, false)
      AND NOT starts_with(source_ip, '2a01:4f8:20:')""",
)
def trusted_anti_join(fx: Fixture):
    return networks.trusted_anti_join(fx.obs, TRUSTED).select("event_id", "source_ip")


@add(
    "excluded_prefix_anti_join",
    f"""WITH {OBS_CTE}, numbered AS (SELECT DISTINCT source_ip, {KEY_SQL} AS key, {IP_NUMBER} AS num FROM obs)
    SELECT DISTINCT key FROM numbered WHERE NOT coalesce(num BETWEEN 167772160 AND 184549375, false)
      AND source_ip <> '11.9.0.1' AND NOT starts_with(source_ip, '2a01:4f8:20:')""",
)
def excluded_prefix_anti_join(fx: Fixture):
    keys = fx.obs.select(addresses.deny_key(F.col("source_ip")).alias("key")).distinct()
    return networks.excluded_prefix_anti_join(keys, fx.never_block)


@add(
    "cidr_anti_join",
    f"""WITH {OBS_CTE}, never AS (SELECT DISTINCT CASE WHEN l_orderkey % 5 = 0 THEN concat('11.', l_orderkey % 8, '.', l_partkey % 256, '.0/24')
        ELSE concat('11.', l_orderkey % 8, '.', l_partkey % 241, '.', (l_orderkey * 31 + l_linenumber) % 256, '/32') END AS cidr FROM lineitem)
    SELECT event_id, source_ip FROM obs WHERE contains(source_ip, ':') OR NOT (
      concat(source_ip, '/32') IN (SELECT cidr FROM never)
      OR regexp_replace(source_ip, '[0-9]+$', '0/24') IN (SELECT cidr FROM never))""",
)
def cidr_anti_join(fx: Fixture):
    """Addresses against a table of CIDRs that grows with the line items."""
    l = F.col("l_orderkey")  # noqa: E741
    text = F.when(
        l % 5 == 0, F.concat(F.lit("11."), l % 8, F.lit("."), F.col("l_partkey") % 256, F.lit(".0/24"))
    ).otherwise(
        F.concat(F.lit("11."), l % 8, F.lit("."), F.col("l_partkey") % 241, F.lit("."), (l * 31 + F.col("l_linenumber")) % 256, F.lit("/32"))
    )
    cidrs = fx.table("lineitem").select(text.alias("cidr")).distinct().select(addresses.cidr_columns(F.col("cidr")).alias("c")).select("c.*")
    kept = networks.cidr_anti_join(fx.obs, addresses.ip_number(F.col("source_ip")), cidrs, texts=["source_ip"])
    return kept.select("event_id", "source_ip")


@add("deny_key", f"WITH {OBS_CTE} SELECT event_id, {KEY_SQL} AS key FROM obs")
def deny_key(fx: Fixture):
    return fx.obs.select("event_id", addresses.deny_key(F.col("source_ip")).alias("key"))


@add(
    "canonical_ip",
    f"""WITH {OBS_CTE} SELECT event_id, source_ip AS plain, source_ip AS mapped, CAST(NULL AS VARCHAR) AS zoned, CAST(NULL AS VARCHAR) AS malformed FROM obs""",
)
def canonical_ip(fx: Fixture):
    """Canonical text from the plain, the mapped or padded upper-case, the zoned
    and a malformed spelling of each address."""
    ip = F.col("source_ip")
    v6 = F.contains(ip, F.lit(":"))
    spelled = F.when(v6, F.upper(F.replace(ip, F.lit("::"), F.lit(":0:0:0:000")))).otherwise(
        F.concat(F.lit("::FFFF:"), ip)
    )
    event = F.col("event_id")
    malformed = (
        F.when(event % 5 == 0, F.concat(ip, F.lit(".1"))).when(event % 5 == 1, F.concat(F.lit("0"), ip))
        .when(event % 5 == 2, F.concat(ip, F.lit(" "))).when(event % 5 == 3, F.lit("")).otherwise(F.concat(ip, F.lit("::g")))
    )
    return fx.obs.select(
        "event_id",
        addresses.canonical_ip(ip).alias("plain"),
        addresses.canonical_ip(spelled).alias("mapped"),
        addresses.canonical_ip(F.concat(ip, F.lit("%eth0"))).alias("zoned"),
        addresses.canonical_ip(malformed).alias("malformed"),
    )


@add(
    "ip_columns",
    f"""WITH {OBS_CTE}, numbered AS (SELECT *, {IP_NUMBER} AS num FROM obs)
    SELECT event_id, CASE WHEN num IS NULL THEN 6 ELSE 4 END AS family,
      CASE WHEN num IS NULL THEN concat('2a0104f8', lpad(split_part(source_ip, ':', 3), 4, '0'), lpad(split_part(source_ip, ':', 4), 4, '0'),
        repeat('0', 12), lpad(split_part(source_ip, '::', 2), 4, '0'))
        ELSE lower(lpad(to_hex(num), 8, '0')) END AS addr FROM numbered""",
)
def ip_columns(fx: Fixture):
    a = fx.obs.select("event_id", addresses.ip_columns(F.col("source_ip")).alias("a"))
    return a.select("event_id", "a.family", F.lower(F.hex("a.addr")).alias("addr"))


@add(
    "cidr_columns",
    f"""WITH {OBS_CTE}, numbered AS (SELECT *, {IP_NUMBER} AS num FROM obs WHERE NOT contains(source_ip, ':'))
    SELECT event_id, regexp_replace(source_ip, '::[0-9]+$', '::/96') AS prefix FROM obs WHERE contains(source_ip, ':')
    UNION ALL SELECT event_id, concat(num // 16777216, '.', num // 65536 % 256, '.', num // 256 % 256 // 16 * 16, '.0/20') AS prefix FROM numbered""",
)
def cidr_columns(fx: Fixture):
    """The /20 around each IPv4 address, half of them written as mapped IPv6, and the /96 of each IPv6 address."""
    ip = F.col("source_ip")
    cidr = F.when(F.contains(ip, F.lit(":")), F.concat(ip, F.lit("/96"))).when(F.col("event_id") % 2 == 0, F.concat(ip, F.lit("/20"))).otherwise(
        F.concat(F.lit("::ffff:"), ip, F.lit("/116"))
    )
    return fx.obs.select("event_id", addresses.cidr_columns(cidr)["prefix"].alias("prefix"))


@add(
    "event_id",
    f"""WITH {OBS_CTE} SELECT event_id AS row_id,
    concat('nginx:', sha256(concat('file-', source_id, ';offset=', event_id))) AS event_id FROM obs""",
)
def event_id(fx: Fixture):
    cursor = F.concat(F.lit("file-"), "source_id", F.lit(";offset="), F.col("event_id").cast("string"))
    return fx.obs.select(F.col("event_id").alias("row_id"), text.event_id(F.lit("nginx"), cursor).alias("event_id"))


CONTROL_SQL = "[\\x00-\\x1f\\x7f]"


@add(
    "bounded_text",
    f"""SELECT doc_id, strlen(text) BETWEEN 1 AND 2048 AND NOT regexp_matches(text, '{CONTROL_SQL}') AS usable,
      strlen(source) BETWEEN 1 AND 256 AND NOT regexp_matches(source, '{CONTROL_SQL}') AS usable_source FROM documents""",
)
def bounded_text(fx: Fixture):
    return fx.table("documents").select(
        "doc_id",
        text.bounded_text(F.col("text"), 2048).alias("usable"),
        text.bounded_text(F.col("source"), 256).alias("usable_source"),
    )


@add(
    "sanitize_password",
    f"""SELECT conv_id, turn, CASE WHEN strlen(text) BETWEEN 1 AND 256 AND NOT regexp_matches(text, '{CONTROL_SQL}')
    THEN text END AS password FROM conversations""",
)
def sanitize_password(fx: Fixture):
    return fx.table("conversations").select(
        "conv_id", "turn", text.sanitize_password(F.col("text")).alias("password")
    )


@add(
    "hex_digest",
    """SELECT page_id, regexp_full_match(sha256(url), '[0-9a-f]{64}') AS digest, regexp_full_match(url, '[0-9a-f]{64}') AS plain,
    regexp_full_match(upper(sha256(url)), '[0-9a-f]{64}') AS upper_case FROM pages""",
)
def hex_digest(fx: Fixture):
    digest = F.sha2("url", 256)
    return fx.table("pages").select(
        "page_id",
        text.hex_digest(digest, 64).alias("digest"),
        text.hex_digest(F.col("url"), 64).alias("plain"),
        text.hex_digest(F.upper(digest), 64).alias("upper_case"),
    )


@add(
    "safe_file_name",
    f"""SELECT doc_id, CASE WHEN strlen(text) BETWEEN 1 AND 512 AND NOT starts_with(text, '/') AND NOT contains(text, '..')
      AND NOT regexp_matches(text, '{CONTROL_SQL}') THEN text ELSE 'unsafe-name' END AS file FROM documents""",
)
def safe_file_name(fx: Fixture):
    return fx.table("documents").select("doc_id", text.safe_file_name(F.col("text")).alias("file"))


@add(
    "identity_rules",
    f"""WITH {PROMOTED_CTE}, spoiled AS (SELECT event_id, rules,
      CASE event_id % 7 WHEN 1 THEN upper(source_id) WHEN 2 THEN concat('-', source_id) WHEN 3 THEN concat(source_id, '.')
        WHEN 4 THEN repeat('a', 65) WHEN 5 THEN '' WHEN 6 THEN repeat('a', 64) ELSE source_id END AS source,
      CASE event_id % 5 WHEN 1 THEN concat('0', event_id) WHEN 2 THEN concat('-', event_id) WHEN 3 THEN '' WHEN 4 THEN concat(event_id, chr(10))
        ELSE CAST(event_id AS VARCHAR) END AS seq FROM promoted)
    SELECT event_id, regexp_full_match(source, '[a-z0-9](?:[a-z0-9._-]{{0,62}}[a-z0-9])?') AS source_ok,
      regexp_full_match(seq, '0|[1-9][0-9]{{0,18}}') AS sequence_ok,
      event_id % 3 <> 1 AS rules_ok, contains(rules, ',') = false AS reversed_ok FROM spoiled""",
)
def identity_rules(fx: Fixture):
    """Identity, sequence and rule-id predicates over the promoted events, most of them spoiled in some way."""
    event, source, number = F.col("event_id"), F.col("source_id"), F.col("event_id").cast("string")
    spoiled = {
        1: F.upper(source), 2: F.concat(F.lit("-"), source), 3: F.concat(source, F.lit(".")),
        4: F.lit("a" * 65), 5: F.lit(""), 6: F.lit("a" * 64),
    }
    sequences = {1: F.concat(F.lit("0"), number), 2: F.concat(F.lit("-"), number), 3: F.lit(""), 4: F.concat(number, F.lit("\n"))}
    pick = lambda n, cases, rest: F.coalesce(*[F.when(event % n == k, v) for k, v in cases.items()], rest)
    rules = F.when(event % 3 == 1, F.array_append("rule_ids", F.lit("HTTP/Upper"))).otherwise(F.col("rule_ids"))
    return fx.promoted.select(
        "event_id",
        text.valid_identity(pick(7, spoiled, source), F.col("source_epoch")).alias("source_ok"),
        text.valid_sequence(pick(5, sequences, number)).alias("sequence_ok"),
        text.valid_rule_ids(rules).alias("rules_ok"),
        text.valid_rule_ids(F.reverse("rule_ids")).alias("reversed_ok"),
    )


@add(
    "utc_timestamp",
    f"""WITH {OBS_CTE} SELECT event_id,
      regexp_replace(regexp_replace(strftime(observed_at - INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S.%f'), '0+$', ''), '\\.$', '') || 'Z' AS utc,
      true AS strict_ok, false AS offset_ok FROM obs""",
)
def utc_timestamp(fx: Fixture):
    """Local texts with an offset of +05:30 to UTC, and the strict rule."""
    local = F.concat(F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+05:30"))
    zulu = F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return fx.obs.select(
        "event_id",
        times.utc_timestamp(local).alias("utc"),
        times.strict_utc(zulu).isNotNull().alias("strict_ok"),
        times.strict_utc(local).isNotNull().alias("offset_ok"),
    )


def _line_rows(fx: Fixture, kind: str):
    at = F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return fx.obs.where(F.col("kind") == kind).withColumn("at", at).withColumn(
        "cursor", F.concat(F.lit("f;"), F.col("event_id").cast("string"))
    )


@add(
    "parse_access_log",
    f"""WITH {OBS_CTE} SELECT concat('nginx:', sha256(concat('f;', event_id))) AS event_id, source_ip,
      regexp_replace(regexp_replace(strftime(observed_at, '%Y-%m-%dT%H:%M:%S.%f'), '0+$', ''), '\\.$', '') || 'Z' AS observed_at,
      CASE WHEN status = 200 THEN NULL ELSE request_target END AS request_target,
      CASE WHEN status = 200 THEN NULL ELSE CAST(status AS BIGINT) END AS status,
      CASE WHEN status = 200 THEN 'unknown_field' END AS reject_reason
    FROM obs WHERE kind = 'http_request'""",
)
def parse_access_log(fx: Fixture):
    """Lines written from the events and parsed again. Status 200 lines carry
    an extra field and must be rejected; half use the request line."""
    target, status = F.col("request_target"), F.col("status")
    by_line = F.col("event_id") % 2 == 0
    doc = F.struct(
        F.col("at").alias("time"),
        F.col("source_ip").alias("remote_addr"),
        F.when(by_line, F.lit("")).otherwise(target).alias("request_uri"),
        F.when(by_line, F.concat(F.lit("GET  "), target, F.lit(" HTTP/1.1"))).alias("request"),
        status.alias("status"),
        F.when(status == 200, F.lit("x")).alias("body"),
    )
    parsed = lines.parse_access_log(
        _line_rows(fx, classify.HTTP).select("cursor", F.to_json(doc).alias("value"))
    )
    ok = F.col("reject_reason").isNull()
    return parsed.select(
        "event_id",
        "source_ip",
        "observed_at",
        F.when(ok, F.col("http.request_target")).alias("request_target"),
        F.when(ok, F.col("http.status").cast("bigint")).alias("status"),
        "reject_reason",
    )


@add(
    "parse_honeypot_log",
    f"""WITH {OBS_CTE} SELECT concat('cowrie:', sha256(concat('f;', event_id))) AS event_id, source_ip, username, password,
      regexp_replace(regexp_replace(strftime(observed_at, '%Y-%m-%dT%H:%M:%S.%f'), '0+$', ''), '\\.$', '') || 'Z' AS observed_at,
      CAST(NULL AS VARCHAR) AS reject_reason
    FROM obs WHERE kind = 'ssh_auth_failure' AND source_kind = 'decoy'""",
)
def parse_honeypot_log(fx: Fixture):
    """Decoy lines are failed logins, host lines another event; missing
    passwords are written as a control character and must be dropped."""
    doc = F.struct(
        F.when(F.col("source_kind") == "decoy", "cowrie.login.failed").otherwise("cowrie.session.connect").alias("eventid"),
        F.col("at").alias("timestamp"),
        F.col("source_ip").alias("src_ip"),
        "username",
        F.coalesce("password", F.lit("\x01")).alias("password"),
        F.lit("abc").alias("session"),
    )
    parsed = lines.parse_honeypot_log(
        _line_rows(fx, classify.SSH).select("cursor", F.to_json(doc).alias("value"))
    )
    return parsed.select(
        "event_id", "source_ip", F.col("ssh.username").alias("username"), F.col("ssh.password").alias("password"),
        "observed_at", "reject_reason",
    )


@add(
    "follow_logs",
    f"""WITH {OBS_CTE} SELECT source_ip, username, count(*) AS n FROM obs
    WHERE kind = 'ssh_auth_failure' AND source_kind = 'decoy' GROUP BY ALL""",
)
def follow_logs(fx: Fixture):
    """Log files written from the events, read by byte ranges that cut lines and parsed."""
    doc = F.struct(
        F.when(F.col("source_kind") == "decoy", "cowrie.login.failed").otherwise("cowrie.session.connect").alias("eventid"),
        F.col("at").alias("timestamp"),
        F.col("source_ip").alias("src_ip"),
        "username",
        F.lit("pw").alias("password"),
    )
    folder = new_folder(fx.spark, "followed-logs")
    _line_rows(fx, classify.SSH).select(F.to_json(doc).alias("value")).write.text(folder)
    read = read_logs(fx.spark, folder, pattern="part-*", splitBytes=8 << 20)
    parsed = lines.parse_honeypot_log(read.select("cursor", "value")).where(F.col("reject_reason").isNull())
    return parsed.groupBy("source_ip", F.col("ssh.username").alias("username")).agg(F.count("*").alias("n"))


@add(
    "parse_ssh_journal",
    f"""WITH {OBS_CTE} SELECT concat('openssh:', sha256(concat('s=', lower(to_hex(event_id)), ';i=1'))) AS event_id, source_ip,
      concat(username, ' from 192.0.2.1 port 22 ssh2') AS username,
      regexp_replace(regexp_replace(strftime(observed_at, '%Y-%m-%dT%H:%M:%S.%f'), '0+$', ''), '\\.$', '') || 'Z' AS observed_at,
      CAST(NULL AS VARCHAR) AS reject_reason
    FROM obs WHERE kind = 'ssh_auth_failure' AND source_kind = 'host'""",
)
def parse_ssh_journal(fx: Fixture):
    """Host failures whose usernames imitate an address; decoy lines carry a
    trailing word and must not match."""
    message = F.concat(
        F.lit("Failed password for invalid user "),
        "username",
        F.lit(" from 192.0.2.1 port 22 ssh2 from "),
        "source_ip",
        F.lit(" port 4242 ssh2"),
        F.when(F.col("source_kind") == "decoy", " trailing").otherwise(""),
    )
    doc = F.struct(
        F.concat(F.lit("s="), F.lower(F.hex("event_id")), F.lit(";i=1")).alias("__CURSOR"),
        F.unix_micros("observed_at").cast("string").alias("__REALTIME_TIMESTAMP"),
        message.alias("MESSAGE"),
        F.lit("ssh.service").alias("_SYSTEMD_UNIT"),
    )
    parsed = lines.parse_ssh_journal(
        _line_rows(fx, classify.SSH).select("cursor", F.to_json(doc).alias("value"))
    )
    return parsed.select(
        "event_id", "source_ip", F.col("ssh.username").alias("username"), "observed_at", "reject_reason"
    )


@add(
    "split_rejects",
    f"""WITH {OBS_CTE} SELECT 'nginx' AS adapter_id, CASE WHEN status = 200 THEN 'line_json' END AS reject_reason, count(*) AS n
    FROM obs WHERE kind = 'http_request' GROUP BY ALL
    UNION ALL SELECT 'cowrie', CAST(NULL AS VARCHAR), count(*) FROM obs WHERE kind = 'ssh_auth_failure' GROUP BY ALL""",
)
def split_rejects(fx: Fixture):
    """Two formats parsed together; lines with trailing data are rejected."""
    http = F.struct(
        F.col("at").alias("time"), F.col("source_ip").alias("remote_addr"),
        F.col("request_target").alias("request_uri"), "status",
    )
    ssh = F.struct(
        F.lit("cowrie.login.failed").alias("eventid"), F.col("at").alias("timestamp"),
        F.col("source_ip").alias("src_ip"), "username", "password",
    )
    trailing = F.when(F.col("status") == 200, " true").otherwise("")
    parsed = lines.parse_logs(
        {
            "nginx": _line_rows(fx, classify.HTTP).select("cursor", F.concat(F.to_json(http), trailing).alias("value")),
            "cowrie": _line_rows(fx, classify.SSH).select("cursor", F.to_json(ssh).alias("value")),
        }
    )
    good, bad = lines.split_rejects(stage_table(parsed.drop("line"), "parsed"))
    counted = good.groupBy("adapter_id").agg(F.count("*").alias("n")).withColumn("reject_reason", F.lit(None).cast("string"))
    failed = bad.groupBy("reject_reason").agg(F.count("*").alias("n")).withColumn("adapter_id", F.lit("nginx"))
    return counted.unionByName(failed).select("adapter_id", "reject_reason", "n")


@add(
    "line_cursors",
    """SELECT sha256(text) AS digest, row_number() OVER (PARTITION BY source, text) AS copy, source AS file FROM documents""",
)
def line_cursors(fx: Fixture):
    """Positions of equal lines within one file: whole documents as lines."""
    rows = fx.table("documents").select(F.col("text").alias("value"), F.col("source").alias("file"))
    part = F.split("cursor", ":")
    return lines.line_cursors(rows).select(
        F.element_at(part, -2).alias("digest"),
        F.element_at(part, -1).cast("bigint").alias("copy"),
        F.element_at(part, 1).alias("file"),
    )


@add(
    "hourly_windows",
    f"""WITH {OBS_CTE} SELECT {iso("date_trunc('hour', observed_at)")} AS hour,
      {iso("date_trunc('hour', observed_at) + INTERVAL 1 HOUR")} AS hour_end, kind, count(*) AS n FROM obs GROUP BY ALL""",
)
def hourly_windows_query(fx: Fixture):
    out = hourly_windows(fx.obs)
    return out.select(shown("hour").alias("hour"), shown("hour_end").alias("hour_end"), "kind", "n")
