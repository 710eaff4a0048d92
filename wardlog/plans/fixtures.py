"""Views in the shape of the data model, derived from the driver's tables.

``OBS`` is one text for both engines: Spark runs it over the ``events`` frame,
the oracle over the ``events`` view.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.config import RuleConfig
from wardlog.operators.batching import hourly_counts
from wardlog.operators.classify import promote
from wardlog.session import ensure_session

NOW = "2024-01-31 00:00:00"
EPOCH = "0b8f6c1e-7a52-4c39-9d41-2e6f0a9b7c53"
RULES = RuleConfig(
    excluded_usernames=("user3",), trusted_cidrs=("11.3.0.0/16",), excluded_path_prefixes=("/download/",)
)
NEVER_BLOCK = ("11.9.0.1/32", "2a01:4f8:20::/48")

OBS = """
SELECT event_id, observed_at, source_id, source_kind, kind, source_ip,
  CASE WHEN kind='ssh_auth_failure' THEN username END AS username,
  CASE WHEN kind='ssh_auth_failure' AND v % 3 = 0 THEN concat('pw', CAST(v % 13 AS VARCHAR(4))) END AS password,
  CASE WHEN kind='http_request' THEN target END AS request_target,
  CASE WHEN kind='http_request' THEN CASE v % 4 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 400 ELSE 200 END END AS status
FROM (
 SELECT event_id, ts AS observed_at, v,
  concat('sensor-', CAST(event_id % 3 AS VARCHAR(4))) AS source_id,
  CASE WHEN event_id % 3 = 0 THEN 'decoy' ELSE 'host' END AS source_kind,
  CASE WHEN event_type IN ('error','view') THEN 'http_request' ELSE 'ssh_auth_failure' END AS kind,
  CASE WHEN v % 4 = 0 THEN concat('11.9.0.', CAST(v % 3 AS VARCHAR(4)))
       WHEN n % 10 = 0 THEN concat('10.0.', CAST(n % 250 AS VARCHAR(4)), '.', CAST(n % 199 AS VARCHAR(4)))
       WHEN n % 10 = 1 THEN concat('2a01:4f8:', CAST(n % 90 + 10 AS VARCHAR(4)), ':', CAST(n % 7 + 1 AS VARCHAR(4)), '::', CAST(n % 9 + 1 AS VARCHAR(4)))
       ELSE concat('11.', CAST(n % 8 AS VARCHAR(4)), '.', CAST(n % 241 AS VARCHAR(4)), '.', CAST(n % 251 AS VARCHAR(4))) END AS source_ip,
  concat('user', CAST(v % 17 AS VARCHAR(4))) AS username,
  CASE v % 8 WHEN 0 THEN '/a/../etc/passwd?token=x' WHEN 1 THEN '/.env' WHEN 2 THEN '/x/%252e%252e%252fetc/passwd#f'
    WHEN 3 THEN '/%2e%2e/%2Egit/config' WHEN 4 THEN '/u/alice@example.com/../x' WHEN 5 THEN '/download/../report' WHEN 6 THEN 'http:evil/../etc/passwd'
    ELSE concat('/page/', CAST(v % 9 AS VARCHAR(4))) END AS target
 FROM (SELECT *, (event_id * 7919) % 4000 AS n, CAST(floor(value) AS BIGINT) AS v FROM events) e ) o
"""

# Oracle side of the classification, as common table expressions.
OBS_CTE = f"obs AS ({OBS})"
REPS_CTE = """
h0 AS (SELECT *, regexp_extract(request_target, '^[^?#]*') AS path FROM obs WHERE kind = 'http_request'),
h1 AS (SELECT *, CASE WHEN regexp_matches(path, '%($|[^0-9A-Fa-f]|[0-9A-Fa-f]($|[^0-9A-Fa-f]))') THEN NULL ELSE url_decode(path) END AS d1 FROM h0),
h2 AS (SELECT *, CASE WHEN regexp_matches(d1, '%($|[^0-9A-Fa-f]|[0-9A-Fa-f]($|[^0-9A-Fa-f]))') THEN NULL ELSE url_decode(d1) END AS d2 FROM h1),
reps AS (SELECT *, CASE WHEN d1 IS NULL OR d1 = path THEN [path] WHEN d2 IS NULL OR d2 = d1 THEN [path, d1] ELSE [path, d1, d2] END AS rep FROM h2),
folded AS (SELECT *, list_transform(rep, lambda x: lower(replace(x, '\\', '/'))) AS low FROM reps),
judged AS (SELECT *,
  list_transform(low, lambda x: contains(x, '../')) AS trav,
  list_transform(low, lambda x: contains(x, '/etc/passwd') OR contains(x, '/etc/shadow') OR contains(x, '/windows/win.ini')
    OR contains(x, '/.env') OR contains(x, '/.git/config') OR contains(x, '/proc/self/environ')) AS sens,
  len(list_filter(rep, lambda x: starts_with(x, '/download/'))) > 0 AS excluded,
  len(list_filter(rep, lambda x: regexp_matches(x, '(?i)[a-z0-9._%+-]+(?:@|%40)[a-z0-9.-]+\\.[a-z]{2,}')
    OR regexp_matches(x, '(?i)(?:token|secret|password|api[_-]?key)[=/:%-][^/]+')
    OR regexp_matches(x, 'eyJ[a-zA-Z0-9_-]{10,}\\.[a-zA-Z0-9_-]{10,}'))) > 0 AS sensitive
  FROM folded),
ruled AS (SELECT *, concat_ws(',', CASE WHEN list_contains(trav, true) THEN 'http/path-traversal-v1' END,
    CASE WHEN list_contains(sens, true) THEN 'http/sensitive-file-v1' END) AS rules,
  CASE WHEN trav[1] OR sens[1] THEN 'raw' WHEN len(rep) > 1 AND (trav[2] OR sens[2]) THEN 'decoded_once'
    WHEN len(rep) > 2 AND (trav[3] OR sens[3]) THEN 'decoded_twice' END AS matched,
  status IN (400, 403, 404) AND request_target LIKE '/%' AS eligible FROM judged)
"""
PROMOTED_CTE = f"""{OBS_CTE}, {REPS_CTE},
promoted AS (
  SELECT event_id, observed_at, source_id, source_kind, kind, source_ip, username, password, CAST(NULL AS VARCHAR) AS path,
    status, 'ssh/all-attempts-v1' AS rules FROM obs
  WHERE kind = 'ssh_auth_failure' AND username <> 'user3' AND source_ip NOT LIKE '11.3.%'
  UNION ALL
  SELECT event_id, observed_at, source_id, source_kind, kind, source_ip, username, password, path, status, rules FROM ruled
  WHERE eligible AND NOT excluded AND NOT sensitive AND rules <> ''),
buckets AS (
  SELECT source_id, source_kind, CAST(extract(day FROM observed_at) AS BIGINT) - 1 AS seq, kind, source_ip, username,
    password, path, rules, coalesce(username, path) AS val, coalesce(password, '') AS pw,
    date_trunc('hour', observed_at) AS hour, count(*) AS n, min(observed_at) AS first_at, max(observed_at) AS last_at
  FROM promoted GROUP BY ALL)"""
KEY_SQL = """CASE WHEN contains(source_ip, ':') THEN regexp_replace(source_ip, '::.*', '::/64')
  ELSE concat(source_ip, '/32') END"""
DIMENSIONS_CTE = f"""
dims AS (
  SELECT hour, seq, source_id, kind, source_ip, val, pw, 'sources' AS dimension, concat(source_id, '/{EPOCH}') AS value, n FROM buckets
  UNION ALL SELECT hour, seq, source_id, kind, source_ip, val, pw, 'source_ips', source_ip, n FROM buckets
  UNION ALL SELECT hour, seq, source_id, kind, source_ip, val, pw, 'usernames', username, n FROM buckets WHERE kind = 'ssh_auth_failure'
  UNION ALL SELECT hour, seq, source_id, kind, source_ip, val, pw, 'passwords', password, n FROM buckets
    WHERE kind = 'ssh_auth_failure' AND source_kind = 'decoy' AND password IS NOT NULL
  UNION ALL SELECT hour, seq, source_id, kind, source_ip, val, pw, 'paths', path, n FROM buckets WHERE kind = 'http_request'),
grans AS (SELECT * FROM (VALUES ('hourly', 'hour'), ('daily', 'day'), ('monthly', 'month'), ('yearly', 'year')) t(granularity, unit)),
pdims AS (
  SELECT granularity, CASE unit WHEN 'hour' THEN hour WHEN 'day' THEN date_trunc('day', hour)
    WHEN 'month' THEN date_trunc('month', hour) ELSE date_trunc('year', hour) END AS period_start, d.* FROM dims d, grans),
counts AS (SELECT granularity, period_start, dimension, value, CAST(sum(n) AS BIGINT) AS cnt FROM pdims GROUP BY ALL),
totals AS (SELECT granularity, period_start, CAST(sum(n) AS BIGINT) AS total FROM pdims WHERE dimension = 'sources' GROUP BY ALL)"""
EVIDENCE_CTE = f"""
keyed AS (SELECT *, {KEY_SQL} AS k FROM buckets),
qualifying AS (
  SELECT k, source_id, hour FROM keyed WHERE NOT (source_kind = 'host' AND kind = 'ssh_auth_failure')
  UNION ALL
  SELECT k, source_id, hour FROM keyed WHERE source_kind = 'host' AND kind = 'ssh_auth_failure'
  GROUP BY k, source_id, seq, hour HAVING count(DISTINCT username) >= 2),
facts AS (SELECT k, source_id, CAST(hour AS DATE) AS fact_day, max(hour) + INTERVAL 1 HOUR AS last_seen FROM qualifying GROUP BY ALL)"""


def iso(column: str) -> str:
    """Oracle text of a time without fraction."""
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def shown(column) -> Column:
    """The same text in Spark."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def micro(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def shown_micro(column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def joined(column) -> Column:
    return F.array_join(column, ",")


class Fixture:
    """Lazily derived views over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = ensure_session(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def now(self) -> Column:
        return F.lit(NOW).cast("timestamp")

    @cached_property
    def obs(self) -> DataFrame:
        events = self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
        return self.spark.sql(OBS.replace("FROM events)", "FROM {events})"), events=events)

    @cached_property
    def promoted(self) -> DataFrame:
        return promote(self.obs, RULES).withColumn("source_epoch", F.lit(EPOCH))

    @cached_property
    def buckets(self) -> DataFrame:
        """Accepted record rows by hour; one batch per sensor and day."""
        seq = (F.dayofmonth("observed_at") - 1).cast("bigint")
        return (
            hourly_counts(
                self.promoted.withColumn("seq", seq), ["source_id", "source_epoch", "source_kind", "seq"]
            )
            .withColumn("val", F.coalesce("username", "path"))
            .withColumn("pw", F.coalesce("password", F.lit("")))
        )

    arrival = ["source_id", "seq", "kind", "source_ip", "val", "pw", "hour"]

    @cached_property
    def never_block(self) -> DataFrame:
        from wardlog.functions.addresses import cidr_columns

        rows = self.spark.createDataFrame([(c,) for c in NEVER_BLOCK], "cidr string")
        return rows.select(cidr_columns(F.col("cidr")).alias("c")).select("c.*")


class Catalog:
    """Named queries with their oracle SQL."""

    def __init__(self):
        self.queries = {}
        self.oracles = {}

    def add(self, name: str, oracle: str | None = None):
        def register(build):
            def run(spark: SparkSession, folder: str) -> DataFrame:
                return build(Fixture(spark, folder))

            run.__doc__ = build.__doc__
            self.queries[name] = run
            if oracle is not None:
                self.oracles[name] = oracle
            return build

        return register
