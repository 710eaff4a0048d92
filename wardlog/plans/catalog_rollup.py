"""Registered queries: batching, rollups, evidence, lists, dashboard."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlog.config import LIMITS
from wardlog.functions import times
from wardlog.operators import acceptance, batching, dashboard, evidence, rollup
from wardlog.operators.canonical import payload_hash, transport_payload
from wardlog.plans import collector, sensor
from wardlog.plans.fixtures import (
    DIMENSIONS_CTE,
    EPOCH,
    EVIDENCE_CTE,
    NOW,
    PROMOTED_CTE,
    Catalog,
    Fixture,
    iso,
    joined,
    micro,
    shown,
    shown_micro,
)
from wardlog.session import stage_table
from wardlog.sinks import render

catalog = Catalog()
add = catalog.add

NOW_SQL = f"TIMESTAMP '{NOW}'"
SENSOR_DAY = ["source_id", "source_epoch", "seq"]


def by_day(fx: Fixture):
    return fx.promoted.withColumn("seq", (F.dayofmonth("observed_at") - 1).cast("bigint"))


@add(
    "aggregate_records",
    f"""WITH {PROMOTED_CTE} SELECT source_id, seq, kind, source_ip, username, password, path, rules AS rule_ids,
      CAST(sum(n) AS BIGINT) AS count, {micro('min(first_at)')} AS first_at, {micro('max(last_at)')} AS last_at,
      string_agg(concat(strftime(hour, '%Y-%m-%dT%H:%M:%SZ'), '=', n), ',' ORDER BY hour) AS hourly_buckets
    FROM buckets GROUP BY source_id, seq, kind, source_ip, username, password, path, rules""",
)
def aggregate_records(fx: Fixture):
    bucket = F.transform("hourly_buckets", lambda b: F.concat(b["hour"], F.lit("="), b["count"].cast("string")))
    return batching.aggregate_records(by_day(fx), SENSOR_DAY).select(
        "source_id", "seq", "kind", "source_ip", "username", "password", "path",
        joined("rule_ids").alias("rule_ids"), "count", shown_micro("first_at").alias("first_at"),
        shown_micro("last_at").alias("last_at"), joined(bucket).alias("hourly_buckets"),
    )


@add(
    "hourly_buckets",
    f"""WITH {PROMOTED_CTE} SELECT source_id, seq, kind, source_ip, username, password, path, rules AS rule_ids,
      {iso('hour')} AS hour, n FROM buckets""",
)
def hourly_buckets(fx: Fixture):
    return batching.hourly_buckets(by_day(fx), SENSOR_DAY).select(
        "source_id", "seq", "kind", "source_ip", "username", "password", "path",
        joined("rule_ids").alias("rule_ids"), shown("hour").alias("hour"), "n",
    )


@add(
    "observation_window",
    f"""WITH {PROMOTED_CTE} SELECT source_id, {iso("date_trunc('hour', min(observed_at))")} AS window_start,
      {iso("date_trunc('hour', max(observed_at)) + INTERVAL 1 HOUR")} AS window_end, count(*) AS observations
    FROM promoted GROUP BY source_id, CAST(extract(day FROM observed_at) AS BIGINT)""",
)
def observation_window(fx: Fixture):
    out = batching.observation_window(by_day(fx), SENSOR_DAY)
    return out.select(
        "source_id", shown("window_start").alias("window_start"), shown("window_end").alias("window_end"), "observations"
    )


CUT_CTE = f"""{PROMOTED_CTE},
ready AS (SELECT *, floor((epoch(observed_at) - epoch(date_trunc('hour', min(observed_at) OVER (PARTITION BY source_id)))) / 2678400) AS stretch
  FROM promoted WHERE observed_at < TIMESTAMP '2024-01-29 23:59:30'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id, stretch ORDER BY observed_at, CAST(event_id AS BIGINT)) - 1 AS place FROM ready),
firsts AS (SELECT source_id, stretch, coalesce(sum(k) OVER (PARTITION BY source_id ORDER BY stretch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT source_id, stretch, (count(*) + 999) // 1000 AS k FROM ready GROUP BY ALL) x),
cut AS (SELECT r.*, CAST(before + place // 1000 AS BIGINT) AS batch, place % 1000 + 1 AS position
  FROM ranked r JOIN firsts f ON r.source_id = f.source_id AND r.stretch = f.stretch)"""
WATERMARK = "2024-01-29 23:59:30"


@add(
    "batch_cut",
    f"WITH {CUT_CTE} SELECT source_id, event_id, batch, position FROM cut",
)
def batch_cut(fx: Fixture):
    cut = batching.batch_cut(fx.promoted, F.lit(WATERMARK).cast("timestamp"), 1000)
    return cut.select("source_id", "event_id", "batch", F.col("position").cast("bigint").alias("position"))


@add(
    "build_batches",
    f"""WITH {CUT_CTE},
    hourly AS (SELECT source_id, batch, kind, source_ip, username, password, path, rules, date_trunc('hour', observed_at) AS hour, count(*) AS n,
      min(observed_at) AS first_at, max(observed_at) AS last_at FROM cut GROUP BY ALL),
    records AS (SELECT source_id, batch, kind, source_ip, username, password, path, rules, CAST(sum(n) AS BIGINT) AS count,
      regexp_replace(regexp_replace(strftime(min(first_at), '%Y-%m-%dT%H:%M:%S.%f'), '0+$', ''), '\\.$', '') || 'Z' AS first_observed_at,
      string_agg(concat(strftime(hour, '%Y-%m-%dT%H:%M:%SZ'), '=', n), ',' ORDER BY hour) AS hourly_buckets FROM hourly GROUP BY ALL)
    SELECT source_id, CAST(4 + batch AS VARCHAR) AS sequence, CASE batch WHEN 0 THEN concat('hash-', source_id) ELSE 'chained' END AS previous_batch_hash,
      CAST(row_number() OVER (PARTITION BY source_id, batch ORDER BY encode(kind), encode(source_ip), encode(coalesce(username, path)),
        encode(coalesce(password, '')), first_observed_at, rules) - 1 AS BIGINT) AS record_no,
      kind, source_ip, username, password, path, rules AS rule_ids, count, first_observed_at, hourly_buckets FROM records""",
)
def build_batches(fx: Fixture):
    """All batches of every sensor, 1,000 events each, in record order. That the
    hashes chain is checked here against their own computation; the oracle has
    no canonical text to hash."""
    promoted = stage_table(fx.promoted, "promoted")
    sensors = promoted.select("source_id", "source_epoch").distinct()
    heads = sensors.withColumn("next_sequence", F.lit("4")).withColumn(
        "previous_hash", F.concat(F.lit("hash-"), "source_id")
    )
    batches = batching.build_batches(
        promoted, heads, "2024-01-30T00:00:00Z", F.lit(WATERMARK).cast("timestamp"), "rules-v1", 1000
    )
    batches = stage_table(batches, "batches")
    hashed = batches.select("source_id", (F.col("batch") + 1).alias("batch"), payload_hash(F.col("payload")).alias("before"))
    chained = (F.col("payload.previous_batch_hash") == F.col("before")) & (F.col("before") != batching.OPEN_HASH)
    previous = F.when(F.col("before").isNull(), F.col("payload.previous_batch_hash")).when(chained, "chained").otherwise("broken")
    rows = batches.join(hashed, ["source_id", "batch"], "left").select(
        "source_id", "payload.sequence", previous.alias("previous_batch_hash"), F.posexplode("payload.records").alias("record_no", "r")
    )
    bucket = F.transform("r.hourly_buckets", lambda b: F.concat(b["hour"], F.lit("="), b["count"].cast("string")))
    return rows.select(
        "source_id", "sequence", "previous_batch_hash", F.col("record_no").cast("bigint").alias("record_no"),
        "r.kind", "r.source_ip", "r.username", "r.password", "r.path", joined("r.rule_ids").alias("rule_ids"),
        "r.count", "r.first_observed_at", joined(bucket).alias("hourly_buckets"),
    )


@add(
    "size_split",
    f"""WITH {CUT_CTE} SELECT source_id, count(*) AS events, CAST(0 AS BIGINT) AS too_large, true AS gapless, true AS divided
    FROM cut GROUP BY source_id""",
)
def size_split(fx: Fixture):
    """Batches of 1,000 events under a limit of 16 KiB: all events stay, no
    payload is larger, batches and positions are numbered without gaps, and
    every sensor has more batches than before."""
    cut = stage_table(batching.batch_cut(fx.promoted, F.lit(WATERMARK).cast("timestamp"), 1000), "cut")
    small = replace(LIMITS, batch_bytes=16_384)
    split = stage_table(batching.size_split(cut, "2024-01-30T00:00:00Z", "rules-v1", limits=small), "split")
    by = ["source_id", "source_epoch", "batch"]
    headers = batching.batch_headers(split, None, "2024-01-30T00:00:00Z")
    payloads = batching.assemble_payloads(split, headers, by, "rules-v1")
    sizes = payloads.select(*by, F.octet_length(transport_payload(F.col("payload"))).alias("bytes"))
    events = split.groupBy(*by).agg(F.count("*").alias("n"), F.max("position").alias("top"), F.min("position").alias("low"))
    before = cut.groupBy("source_id").agg((F.max("batch") + 1).alias("was"))
    return (
        events.join(sizes, by)
        .groupBy("source_id")
        .agg(
            F.sum("n").alias("events"),
            F.sum((F.col("bytes") > small.batch_bytes).cast("bigint")).alias("too_large"),
            (F.every((F.col("top") == F.col("n")) & (F.col("low") == 1)) & (F.count("*") == F.max("batch") + 1)).alias("gapless"),
            F.count("*").alias("is_now"),
        )
        .join(before, "source_id")
        .select("source_id", "events", "too_large", "gapless", (F.col("is_now") > F.col("was")).alias("divided"))
    )


@add(
    "next_pending",
    f"""WITH {PROMOTED_CTE}, batches AS (SELECT source_id, seq, CAST(sum(n) AS BIGINT) AS events FROM buckets GROUP BY ALL)
    SELECT source_id, CAST(seq AS VARCHAR) AS sequence, events FROM batches b
    WHERE seq = (SELECT min(seq) FROM batches x WHERE x.source_id = b.source_id AND x.seq >= 9)""",
)
def next_pending(fx: Fixture):
    batches = (
        fx.buckets.groupBy("source_id", "source_epoch", "seq")
        .agg(F.sum("n").alias("events"))
        .select(
            "source_id", "source_epoch", F.col("seq").cast("string").alias("sequence"), "events",
            F.when(F.col("seq") < 9, "receipt").alias("published_receipt"),
        )
    )
    return batching.next_pending(batches).select("source_id", "sequence", "events")


ROUNDS_CTE = f"""{PROMOTED_CTE},
in_rounds AS (SELECT *, CASE WHEN observed_at < TIMESTAMP '2024-01-14 23:59:30' THEN 1 ELSE 2 END AS round FROM promoted WHERE observed_at < TIMESTAMP '2024-01-29 23:59:30'),
placed AS (SELECT *, floor((epoch(observed_at) - epoch(date_trunc('hour', min(observed_at) OVER (PARTITION BY source_id, round)))) / 2678400) AS stretch FROM in_rounds),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source_id, round, stretch ORDER BY observed_at, CAST(event_id AS BIGINT)) - 1 AS place FROM placed),
starts AS (SELECT source_id, round, stretch, coalesce(sum(k) OVER (PARTITION BY source_id ORDER BY round, stretch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT source_id, round, stretch, (count(*) + 999) // 1000 AS k FROM numbered GROUP BY ALL) x)"""


@add(
    "cut_rounds",
    f"""WITH {ROUNDS_CTE} SELECT n.source_id, CAST(CAST(before + place // 1000 AS BIGINT) AS VARCHAR) AS sequence, CAST(round AS BIGINT) AS round,
      count(*) AS events, CAST(sum(CAST(event_id AS BIGINT)) AS BIGINT) AS ids, true AS linked
    FROM numbered n JOIN starts s USING (source_id, round, stretch) GROUP BY ALL""",
)
def cut_rounds(fx: Fixture):
    """Two rounds of the sensor side, 1,000 events a batch: what the first leaves
    waits for the second, whose chains go on from the first's heads."""
    waiting, heads, rounds = fx.promoted, None, []
    for number, now in enumerate((datetime(2024, 1, 15, 0, 5), datetime(2024, 1, 30, 0, 5)), 1):
        batches, assigned = collector.cut_round(waiting, heads, now, "rules-v1", max_observations=1000)
        keys = batches.select("source_id", "source_epoch", "payload.sequence", "payload.previous_batch_hash", "payload_hash")
        keys = stage_table(keys, "batches")
        moved = acceptance.chain_heads(keys)
        before = F.lag("payload_hash").over(Window.partitionBy("source_id").orderBy(F.col("sequence").cast("long")))
        first = F.lit(None).cast("string") if heads is None else F.col("previous_hash")
        chained = keys if heads is None else keys.join(heads.drop("next_sequence"), ["source_id", "source_epoch"], "left")
        linked = chained.select(
            "source_id", "sequence", F.col("previous_batch_hash").eqNullSafe(F.coalesce(before, first)).alias("linked")
        )
        events = assigned.groupBy("source_id", "sequence").agg(F.count("*").alias("events"), F.sum(F.col("event_id").cast("long")).alias("ids"))
        rounds.append(events.join(linked, ["source_id", "sequence"]).withColumn("round", F.lit(number).cast("long")))
        heads = moved if heads is None else sensor.next_heads(heads, keys)
        waiting = collector.still_waiting(waiting, now)
    return rounds[0].unionByName(rounds[1])


# --- Rollups ---


@add(
    "explode_periods",
    f"""WITH {PROMOTED_CTE}, {DIMENSIONS_CTE}
    SELECT granularity, {iso('period_start')} AS period_start, source_id, seq, source_ip, count(*) AS rows, CAST(sum(n) AS BIGINT) AS n
    FROM pdims WHERE dimension = 'sources' GROUP BY ALL""",
)
def explode_periods(fx: Fixture):
    exploded = rollup.explode_periods(fx.buckets)
    return (
        exploded.groupBy("granularity", "period_start", "source_id", "seq", "source_ip")
        .agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
        .withColumn("period_start", shown("period_start"))
    )


@add(
    "period_totals",
    f"""WITH {PROMOTED_CTE}, {DIMENSIONS_CTE} SELECT granularity, {iso('period_start')} AS period_start, total FROM totals""",
)
def period_totals(fx: Fixture):
    return rollup.period_totals(fx.buckets).withColumn("period_start", shown("period_start"))


@add(
    "period_dimensions",
    f"""WITH {PROMOTED_CTE}, {DIMENSIONS_CTE}
    SELECT granularity, {iso('period_start')} AS period_start, dimension, value, cnt AS count FROM counts""",
)
def period_dimensions(fx: Fixture):
    return rollup.period_dimensions(fx.buckets).withColumn("period_start", shown("period_start"))


@add(
    "daily_top_values",
    f"""WITH {PROMOTED_CTE}, {DIMENSIONS_CTE},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY granularity, period_start, dimension ORDER BY cnt DESC, encode(value)) AS rank
      FROM counts WHERE dimension <> 'sources')
    SELECT {iso('period_start')} AS day, dimension, value, cnt AS count, rank FROM ranked WHERE granularity = 'daily' AND rank <= 5""",
)
def daily_top_values(fx: Fixture):
    """Flagship: the five most probed values of every day and dimension."""
    top = rollup.top_n(rollup.period_dimensions(fx.buckets, granularities=("daily",)), 5)
    return top.select(
        shown("period_start").alias("day"), "dimension", "value", "count", F.col("rank").cast("bigint").alias("rank")
    )


@add(
    "top_n",
    f"""WITH {PROMOTED_CTE}, {DIMENSIONS_CTE},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY granularity, period_start, dimension ORDER BY cnt DESC, encode(value)) AS rank
      FROM counts WHERE dimension <> 'sources')
    SELECT granularity, {iso('period_start')} AS period_start, dimension, value, cnt AS count, rank FROM ranked WHERE rank <= 100""",
)
def top_n(fx: Fixture):
    top = rollup.top_n(rollup.period_dimensions(fx.buckets))
    return top.withColumn("period_start", shown("period_start")).withColumn("rank", F.col("rank").cast("bigint"))


@add(
    "published_overflow",
    f"""WITH {PROMOTED_CTE}, {DIMENSIONS_CTE},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY granularity, period_start, dimension ORDER BY cnt DESC, encode(value)) AS rank
      FROM counts WHERE dimension <> 'sources')
    SELECT granularity, {iso('period_start')} AS period_start, dimension, CAST(sum(CASE WHEN rank <= 5 THEN cnt ELSE 0 END) AS BIGINT) AS shown,
      CAST(sum(CASE WHEN rank > 5 THEN cnt ELSE 0 END) AS BIGINT) AS overflow, CAST(sum(cnt) AS BIGINT) AS total FROM ranked GROUP BY ALL""",
)
def published_overflow(fx: Fixture):
    """Of each period and dimension: what a top five shows, what it does not, and their sum."""
    top, rest = rollup.published_values(rollup.period_dimensions(fx.buckets), 5)
    sums = top.groupBy(*rollup.DIMENSION).agg(F.sum("count").alias("shown")).join(rest, rollup.DIMENSION, "left")
    spilled = F.coalesce("overflow", F.lit(0)).alias("overflow")
    return sums.select(
        "granularity", shown("period_start").alias("period_start"), "dimension", "shown", spilled, (F.col("shown") + spilled).alias("total")
    )


CAP_CTE = f"""{PROMOTED_CTE}, {DIMENSIONS_CTE},
firsts AS (SELECT granularity, period_start, dimension, value, CAST(sum(n) AS BIGINT) AS cnt,
  min(struct_pack(a := source_id, b := seq, c := kind, d := source_ip, e := val, f := pw, g := hour)) AS arrival FROM pdims GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY granularity, period_start, dimension ORDER BY arrival, value) AS place FROM firsts)"""


@add(
    "cap_dimension",
    f"""WITH {CAP_CTE}
    SELECT granularity, {iso('period_start')} AS period_start, dimension, value, cnt AS count FROM placed WHERE place <= 20
    UNION ALL
    SELECT granularity, {iso('period_start')}, dimension, '(overflow)', CAST(sum(cnt) AS BIGINT) FROM placed WHERE place > 20 GROUP BY ALL""",
)
def cap_dimension(fx: Fixture):
    """First twenty values of each dimension to arrive, the rest as overflow."""
    counts = rollup.period_dimensions(fx.buckets, arrival=fx.arrival)
    kept, overflow = rollup.cap_dimension(counts, 20)
    spilled = overflow.select(
        *rollup.DIMENSION, F.lit("(overflow)").alias("value"), F.col("overflow").alias("count")
    )
    return kept.unionByName(spilled).withColumn("period_start", shown("period_start"))


@add(
    "cap_dimension_with_state",
    f"""WITH {PROMOTED_CTE}, {DIMENSIONS_CTE},
    before AS (SELECT granularity, period_start, dimension, value, CAST(sum(n) AS BIGINT) AS cnt,
      min(struct_pack(b := seq, a := source_id, c := kind, d := source_ip, e := val, f := pw, g := hour)) AS arrival
      FROM pdims WHERE seq < 12 GROUP BY ALL),
    held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY granularity, period_start, dimension ORDER BY arrival, value) AS place FROM before) x
      WHERE place <= 20),
    after AS (SELECT granularity, period_start, dimension, value, CAST(sum(n) AS BIGINT) AS cnt,
      min(struct_pack(b := seq, a := source_id, c := kind, d := source_ip, e := val, f := pw, g := hour)) AS arrival
      FROM pdims WHERE seq >= 12 GROUP BY ALL),
    both_ AS (SELECT granularity, period_start, dimension, value, sum(cnt) AS cnt, min(fresh) AS fresh, min(arrival) AS arrival FROM
      (SELECT granularity, period_start, dimension, value, cnt, 0 AS fresh, NULL AS arrival FROM held
       UNION ALL SELECT granularity, period_start, dimension, value, cnt, 1, arrival FROM after) u GROUP BY ALL),
    settled AS (SELECT *, row_number() OVER (PARTITION BY granularity, period_start, dimension ORDER BY fresh, arrival, value) AS place FROM both_)
    SELECT granularity, {iso('period_start')} AS period_start, dimension, value, CAST(cnt AS BIGINT) AS count FROM settled WHERE place <= 20
    UNION ALL SELECT granularity, {iso('period_start')}, dimension, '(overflow)', CAST(sum(cnt) AS BIGINT) FROM
      (SELECT granularity, period_start, dimension, cnt FROM settled WHERE place > 20 UNION ALL SELECT granularity, period_start, dimension, cnt FROM
        (SELECT *, row_number() OVER (PARTITION BY granularity, period_start, dimension ORDER BY arrival, value) AS place FROM before) y WHERE place > 20) z
    GROUP BY ALL""",
)
def cap_dimension_with_state(fx: Fixture):
    """Two runs: what the first twelve days hold keeps its place in the second.
    The overflow of both runs is added, so every period and dimension sums to its total."""
    order = ["seq", "source_id", "kind", "source_ip", "val", "pw", "hour"]
    before = rollup.period_dimensions(fx.buckets.where("seq < 12"), arrival=order)
    after = rollup.period_dimensions(fx.buckets.where("seq >= 12"), arrival=order)
    held, spilled = rollup.cap_dimension(before, 20)
    kept, more = rollup.cap_dimension(after, 20, held)
    rest = rollup.merge_state(spilled, more).select(
        *rollup.DIMENSION, F.lit("(overflow)").alias("value"), F.col("overflow").alias("count")
    )
    return kept.unionByName(rest).withColumn("period_start", shown("period_start"))


TRIM_CTE = f"""{PROMOTED_CTE}, {DIMENSIONS_CTE},
ended AS (SELECT *, CASE granularity WHEN 'hourly' THEN period_start + INTERVAL 1 HOUR WHEN 'daily' THEN period_start + INTERVAL 1 DAY
  WHEN 'monthly' THEN period_start + INTERVAL 1 MONTH ELSE period_start + INTERVAL 1 YEAR END < {NOW_SQL} - INTERVAL 240 HOUR AS old,
  row_number() OVER (PARTITION BY granularity, period_start, dimension ORDER BY cnt DESC, encode(value)) AS rank FROM counts)"""


@add(
    "trim_periods",
    f"""WITH {TRIM_CTE}
    SELECT granularity, {iso('period_start')} AS period_start, dimension, value, cnt AS count FROM ended
    WHERE NOT old OR (granularity <> 'hourly' AND rank <= 5)
    UNION ALL SELECT granularity, {iso('period_start')}, dimension, '(overflow)', CAST(sum(cnt) AS BIGINT) FROM ended
    WHERE old AND granularity <> 'hourly' AND rank > 5 GROUP BY ALL""",
)
def trim_periods(fx: Fixture):
    """Retention of ten days, top five kept beyond it."""
    counts, overflow = rollup.trim_periods(rollup.period_dimensions(fx.buckets), fx.now, 5, 10)
    spilled = overflow.select(
        *rollup.DIMENSION, F.lit("(overflow)").alias("value"), F.col("overflow").alias("count")
    )
    return counts.unionByName(spilled).withColumn("period_start", shown("period_start"))


@add(
    "merge_state",
    f"""WITH {PROMOTED_CTE}, {DIMENSIONS_CTE}
    SELECT granularity, {iso('period_start')} AS period_start, dimension, value, cnt AS count FROM counts""",
)
def merge_state(fx: Fixture):
    """Folding two halves gives the same counts as one pass."""
    first = rollup.period_dimensions(fx.buckets.where("seq < 15"))
    second = rollup.period_dimensions(fx.buckets.where("seq >= 15"))
    merged = rollup.count_guard(rollup.merge_state(first, second), "count")
    return merged.withColumn("period_start", shown("period_start"))


@add(
    "period_bounds",
    f"""WITH {PROMOTED_CTE}, {DIMENSIONS_CTE}
    SELECT granularity, label, {iso('period_start')} AS period_start, {iso('''CASE granularity WHEN 'hourly' THEN period_start + INTERVAL 1 HOUR
      WHEN 'daily' THEN period_start + INTERVAL 1 DAY WHEN 'monthly' THEN period_start + INTERVAL 1 MONTH
      ELSE period_start + INTERVAL 1 YEAR END''')} AS period_end
    FROM (SELECT *, CASE granularity WHEN 'hourly' THEN strftime(period_start, '%Y-%m-%dT%H:%M:%SZ') WHEN 'daily' THEN strftime(period_start, '%Y-%m-%d')
      WHEN 'monthly' THEN strftime(period_start, '%Y-%m') ELSE strftime(period_start, '%Y') END AS label FROM totals) t""",
)
def period_bounds(fx: Fixture):
    """Labels written and parsed again."""
    totals = rollup.period_totals(fx.buckets)
    labelled = totals.withColumn("label", times.period_label(F.col("granularity"), F.col("period_start")))
    bounds = labelled.withColumn("b", times.period_bounds(F.col("granularity"), F.col("label")))
    return bounds.select(
        "granularity", "label", shown("b.start").alias("period_start"), shown("b.end").alias("period_end")
    )


def heads_of(fx: Fixture):
    """Heads of all sensors but one, so that one has no recorded kind."""
    return (
        fx.obs.where("source_id <> 'sensor-2'")
        .groupBy("source_id")
        .agg(F.max("source_kind").alias("kind"))
        .withColumn("source_epoch", F.lit(EPOCH))
    )


@add(
    "label_sources",
    f"""WITH {PROMOTED_CTE}, {DIMENSIONS_CTE}
    SELECT granularity, {iso('period_start')} AS period_start, split_part(value, '/', 1) AS source_id, split_part(value, '/', 2) AS source_epoch,
      CASE WHEN value LIKE 'sensor-0/%' THEN 'decoy' ELSE 'host' END AS kind, cnt AS count,
      row_number() OVER (PARTITION BY granularity, period_start ORDER BY cnt DESC, encode(value)) AS rank
    FROM counts WHERE dimension = 'sources'""",
)
def label_sources(fx: Fixture):
    """Sensor totals with their kinds, in published order."""
    ordered = rollup.order_sources(rollup.label_sources(rollup.period_dimensions(fx.buckets), heads_of(fx)))
    return ordered.withColumn("period_start", shown("period_start")).withColumn("rank", F.col("rank").cast("bigint"))


# --- Evidence ---


@add(
    "host_multi_username",
    f"""WITH {PROMOTED_CTE}, {EVIDENCE_CTE}
    SELECT k AS key, source_id, {iso('hour')} AS hour FROM keyed WHERE source_kind = 'host' AND kind = 'ssh_auth_failure'
    GROUP BY k, source_id, seq, hour HAVING count(DISTINCT username) >= 2""",
)
def host_multi_username(fx: Fixture):
    out = evidence.host_multi_username(evidence.with_deny_key(fx.buckets), ["source_epoch", "seq"])
    return out.withColumn("hour", shown("hour"))


def facts_of(fx: Fixture, rows=None):
    buckets = fx.buckets if rows is None else rows
    events = evidence.qualifying_events(evidence.with_deny_key(buckets), ["source_epoch", "seq"])
    return evidence.evidence_facts(events)


@add(
    "qualifying_events",
    f"""WITH {PROMOTED_CTE}, {EVIDENCE_CTE} SELECT DISTINCT k AS key, source_id, {iso('hour')} AS hour FROM qualifying""",
)
def qualifying_events(fx: Fixture):
    out = evidence.qualifying_events(evidence.with_deny_key(fx.buckets), ["source_epoch", "seq"])
    return out.withColumn("hour", shown("hour")).distinct()


@add(
    "deny_evidence",
    f"""WITH {PROMOTED_CTE}, {EVIDENCE_CTE},
    latest AS (SELECT k, source_id, max(fact_day) AS d FROM facts GROUP BY ALL)
    SELECT f.k AS key, {iso('max(last_seen)')} AS last_seen,
      string_agg(DISTINCT CAST(fact_day AS VARCHAR), ',' ORDER BY CAST(fact_day AS VARCHAR)) AS day_list,
      (SELECT string_agg(concat(source_id, '=', d), ',' ORDER BY source_id) FROM latest l WHERE l.k = f.k) AS source_list
    FROM facts f GROUP BY f.k""",
)
def deny_evidence(fx: Fixture):
    nested = evidence.nest_evidence(facts_of(fx))
    pair = F.transform(
        F.array_sort(F.map_entries("sources")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return nested.select(
        "key", shown("last_seen").alias("last_seen"),
        joined(F.transform("days", lambda d: d.cast("string"))).alias("day_list"), joined(pair).alias("source_list"),
    )


FACT_ROWS = f"SELECT k AS key, source_id, CAST(fact_day AS VARCHAR) AS fact_day, {iso('last_seen')} AS last_seen FROM"


def fact_rows(facts):
    return facts.select(
        "key", "source_id", F.col("day").cast("string").alias("fact_day"), shown("last_seen").alias("last_seen")
    )


@add("merge_evidence", f"WITH {PROMOTED_CTE}, {EVIDENCE_CTE} {FACT_ROWS} facts")
def merge_evidence(fx: Fixture):
    """Evidence of two halves folded equals the evidence of the whole."""
    return fact_rows(
        evidence.merge_evidence(facts_of(fx, fx.buckets.where("seq < 15")), facts_of(fx, fx.buckets.where("seq >= 15")))
    )


@add(
    "prune_evidence",
    f"""WITH {PROMOTED_CTE}, {EVIDENCE_CTE} {FACT_ROWS} facts
    WHERE k IN (SELECT k FROM facts GROUP BY k HAVING max(last_seen) > TIMESTAMP '2024-02-15 12:30:00' - INTERVAL 720 HOUR)
      AND fact_day >= CAST(TIMESTAMP '2024-02-15 12:30:00' - INTERVAL 720 HOUR AS DATE)""",
)
def prune_evidence(fx: Fixture):
    return fact_rows(evidence.prune_evidence(facts_of(fx), F.lit("2024-02-15 12:30:00").cast("timestamp")))


@add(
    "cap_evidence",
    f"""WITH {PROMOTED_CTE}, {EVIDENCE_CTE},
    ranked AS (SELECT k, row_number() OVER (ORDER BY max(last_seen) DESC, encode(k) DESC) AS r FROM facts GROUP BY k)
    {FACT_ROWS} facts WHERE k IN (SELECT k FROM ranked WHERE r <= 500)""",
)
def cap_evidence(fx: Fixture):
    return fact_rows(evidence.cap_evidence(facts_of(fx), 500))


LISTS_CTE = f"""{PROMOTED_CTE}, {EVIDENCE_CTE},
records AS (SELECT k, max(last_seen) AS last_seen,
  count(DISTINCT CASE WHEN fact_day >= CAST({NOW_SQL} - INTERVAL 720 HOUR AS DATE) THEN fact_day END) AS ndays,
  count(DISTINCT CASE WHEN fact_day >= CAST({NOW_SQL} - INTERVAL 720 HOUR AS DATE) THEN source_id END) AS nsources FROM facts GROUP BY k),
allowed AS (SELECT * FROM records WHERE NOT starts_with(k, '10.') AND k <> '11.9.0.1/32' AND NOT starts_with(k, '2a01:4f8:20:')),
lists AS (
  SELECT 'recent' AS list, k, last_seen + INTERVAL 72 HOUR AS expiry FROM allowed WHERE last_seen + INTERVAL 72 HOUR > {NOW_SQL}
  UNION ALL SELECT 'persistent', k, last_seen + INTERVAL 720 HOUR FROM allowed
  WHERE last_seen + INTERVAL 720 HOUR > {NOW_SQL} AND (ndays >= 3 OR nsources >= 2)),
entries AS (SELECT list, k, CAST(epoch(expiry) - epoch({NOW_SQL}) AS BIGINT) AS timeout_s,
  CASE WHEN contains(k, ':') THEN 6 ELSE 4 END AS family,
  CASE WHEN contains(k, ':') THEN concat('2a0104f8', lpad(split_part(k, ':', 3), 4, '0'), lpad(split_part(k, ':', 4), 4, '0'))
    ELSE concat(lpad(split_part(k, '.', 1), 3, '0'), lpad(split_part(k, '.', 2), 3, '0'), lpad(split_part(k, '.', 3), 3, '0'),
      lpad(split_part(split_part(k, '.', 4), '/', 1), 3, '0')) END AS num,
  CASE WHEN contains(k, ':') THEN k ELSE replace(k, '/32', '') END AS element FROM lists)"""


def lists_of(fx: Fixture):
    return evidence.build_deny_lists(facts_of(fx), fx.now, fx.never_block)


@add("build_deny_lists", f"WITH {LISTS_CTE} SELECT list, k AS key, timeout_s FROM entries")
def build_deny_lists(fx: Fixture):
    return lists_of(fx).select("list", "key", "timeout_s")


@add(
    "deny_order",
    f"""WITH {LISTS_CTE} SELECT list, k AS key, family, CASE WHEN family = 6 THEN concat(num, repeat('0', 16))
      ELSE concat(lower(lpad(to_hex(CAST(num[1:3] AS BIGINT)), 2, '0')), lower(lpad(to_hex(CAST(num[4:6] AS BIGINT)), 2, '0')),
        lower(lpad(to_hex(CAST(num[7:9] AS BIGINT)), 2, '0')), lower(lpad(to_hex(CAST(num[10:12] AS BIGINT)), 2, '0'))) END AS sort_key FROM entries""",
)
def deny_order(fx: Fixture):
    """The sort key of every entry: family, then the address bytes."""
    family, addr = evidence.deny_order()
    return lists_of(fx).select("list", "key", family, F.lower(F.hex(addr)).alias("sort_key"))


HEAD_SQL = """SELECT '# wardlog deny list: {name}' AS line UNION ALL SELECT '# self-reported suspected probes'
UNION ALL SELECT '# generated 2024-01-31T00:00:00Z' UNION ALL SELECT '# https://example.org/deny-list'"""


@add(
    "render_text",
    f"""WITH {LISTS_CTE} SELECT line FROM ({HEAD_SQL.format(name='recent')}) h
    UNION ALL SELECT element FROM entries WHERE list = 'recent'""",
)
def render_text(fx: Fixture):
    return render.render_text(lists_of(fx), "recent", fx.now).select("line")


@add(
    "render_nft",
    f"""WITH {LISTS_CTE}, mine AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY num DESC) AS back FROM entries WHERE list = 'persistent')
    SELECT line FROM ({HEAD_SQL.format(name='persistent')}) h
    UNION ALL SELECT unnest(['table inet wardlog {{', chr(9) || 'set persistent_v4 {{ type ipv4_addr; flags timeout; }}',
      chr(9) || 'set persistent_v6 {{ type ipv6_addr; flags interval, timeout; }}', '}}',
      'flush set inet wardlog persistent_v4', 'flush set inet wardlog persistent_v6'])
    UNION ALL SELECT concat('add element inet wardlog persistent_v', family, ' {{') FROM mine GROUP BY family
    UNION ALL SELECT concat(chr(9), element, ' timeout ', timeout_s, 's', CASE WHEN back = 1 THEN '' ELSE ',' END) FROM mine
    UNION ALL SELECT '}}' FROM mine GROUP BY family""",
)
def render_nft(fx: Fixture):
    return render.render_nft(lists_of(fx), "persistent", fx.now).select("line")


@add(
    "render_ipset",
    f"""WITH {LISTS_CTE} SELECT line FROM ({HEAD_SQL.format(name='persistent')}) h
    UNION ALL SELECT unnest([concat('create wardlog-persistent-', f, ' ', o), concat('create wardlog-persistent-', f, '-new ', o),
      concat('flush wardlog-persistent-', f, '-new'), concat('swap wardlog-persistent-', f, '-new wardlog-persistent-', f),
      concat('destroy wardlog-persistent-', f, '-new')])
    FROM (VALUES ('v4', 'hash:ip family inet timeout 2147483'), ('v6', 'hash:net family inet6 timeout 2147483')) t(f, o)
    UNION ALL SELECT concat('add wardlog-persistent-v', family, '-new ', element, ' timeout ', least(timeout_s, 2147483))
    FROM entries WHERE list = 'persistent'""",
)
def render_ipset(fx: Fixture):
    return render.render_ipset(lists_of(fx), "persistent", 2_592_000, fx.now).select("line")


# --- Dashboard ---


@add(
    "dashboard_total",
    f"WITH {PROMOTED_CTE}, {DIMENSIONS_CTE} SELECT CAST(sum(total) AS BIGINT) AS total FROM totals WHERE granularity = 'yearly'",
)
def dashboard_total(fx: Fixture):
    return dashboard.dashboard_total(rollup.period_totals(fx.buckets))


@add(
    "dashboard_source_kinds",
    f"""WITH {PROMOTED_CTE}, {DIMENSIONS_CTE} SELECT count(*) AS sensors, count(*) FILTER (value LIKE 'sensor-0/%') AS decoys,
      count(*) FILTER (value NOT LIKE 'sensor-0/%') AS hosts FROM counts WHERE granularity = 'yearly' AND dimension = 'sources'""",
)
def dashboard_source_kinds(fx: Fixture):
    return dashboard.dashboard_source_kinds(
        rollup.label_sources(rollup.period_dimensions(fx.buckets), heads_of(fx))
    )


@add(
    "dashboard_ip_versions",
    f"""WITH {PROMOTED_CTE}, {DIMENSIONS_CTE}, sums AS (SELECT CAST(sum(CASE WHEN contains(value, ':') THEN 0 ELSE cnt END) AS BIGINT) AS v4,
      CAST(sum(CASE WHEN contains(value, ':') THEN cnt ELSE 0 END) AS BIGINT) AS v6 FROM counts
      WHERE granularity = 'yearly' AND dimension = 'source_ips')
    SELECT 'ipv4' AS family, v4 AS count, CAST(CAST(round(v4 * 1000.0 / (v4 + v6)) AS BIGINT) AS VARCHAR) AS permille FROM sums
    UNION ALL SELECT 'ipv6', v6, CAST(CAST(round(v6 * 1000.0 / (v4 + v6)) AS BIGINT) AS VARCHAR) FROM sums""",
)
def dashboard_ip_versions(fx: Fixture):
    out = dashboard.dashboard_ip_versions(rollup.period_dimensions(fx.buckets))
    return out.select(
        "family", "count", F.round(F.col("percent") * 10).cast("bigint").cast("string").alias("permille")
    )


@add(
    "dashboard_top_values",
    f"""WITH {PROMOTED_CTE}, {DIMENSIONS_CTE}, added AS (SELECT dimension, value, CAST(sum(cnt) AS BIGINT) AS count FROM counts
      WHERE granularity = 'yearly' AND dimension <> 'sources' GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY count DESC, encode(value)) AS rank FROM added)
    SELECT dimension, value, count, rank FROM ranked WHERE rank <= 20""",
)
def dashboard_top_values(fx: Fixture):
    out = dashboard.dashboard_top_values(rollup.period_dimensions(fx.buckets))
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@add(
    "dashboard_freshness",
    f"""WITH {PROMOTED_CTE}, newest AS (SELECT source_id, date_trunc('hour', max(observed_at)) + INTERVAL 1 HOUR AS latest FROM promoted GROUP BY source_id)
    SELECT {iso('max(latest)')} AS updated_at, CASE WHEN max(latest) > {NOW_SQL} + INTERVAL 1 HOUR THEN 'unavailable'
      WHEN max(latest) < {NOW_SQL} - INTERVAL 3 HOUR THEN 'stale' ELSE 'current' END AS freshness FROM newest""",
)
def dashboard_freshness(fx: Fixture):
    accepted = batching.observation_window(fx.promoted, ["source_id"])
    return dashboard.dashboard_freshness(accepted, fx.now, F.col("window_end")).withColumn(
        "updated_at", shown("updated_at")
    )


@add(
    "recent_hours",
    f"""WITH {PROMOTED_CTE}, {DIMENSIONS_CTE}, hourly AS (SELECT period_start, period_start + INTERVAL 1 HOUR AS period_end, total FROM totals WHERE granularity = 'hourly'),
    marked AS (SELECT *, period_end > (SELECT max(period_end) FROM hourly) - INTERVAL 168 HOUR AS recent, row_number() OVER (ORDER BY period_start DESC) AS back FROM hourly)
    SELECT {iso('period_start')} AS period_start, {iso('period_end')} AS period_end, total FROM marked
    WHERE recent OR ((SELECT count(*) FROM marked WHERE recent) < 2 AND back <= 2)""",
)
def recent_hours(fx: Fixture):
    out = dashboard.recent_hours(rollup.period_totals(fx.buckets), 168)
    return out.select(
        shown("period_start").alias("period_start"), shown("period_end").alias("period_end"), "total"
    )

