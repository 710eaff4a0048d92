"""Registered queries: folds of the central state, published documents, outbox."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlog import schemas
from wardlog.functions.times import GRANULARITIES
from wardlog.operators import rollup
from wardlog.plans.catalog_rollup import FACT_ROWS, facts_of, fact_rows, heads_of
from wardlog.plans.central import fold_evidence, fold_rollups
from wardlog.plans.fixtures import DIMENSIONS_CTE, EVIDENCE_CTE, NOW, PROMOTED_CTE, Catalog, Fixture, iso, shown
from wardlog.session import new_folder
from wardlog.sinks.documents import (
    SENSORS,
    VALUES,
    envelope_conflicts,
    parts_folder,
    read_index,
    rollup_periods,
    write_manifest,
    write_rollups,
)
from wardlog.sinks.state import State

catalog = Catalog()
add = catalog.add


def folded_half(fx: Fixture) -> State:
    """A state that holds the first half of the month."""
    first = fx.buckets.where("seq < 15")
    empty = fx.spark.createDataFrame([], schemas.PERIOD_OVERFLOW)
    return State(
        1, None, None, empty,
        {"totals": rollup.period_totals(first), "counts": rollup.period_dimensions(first), "overflow": empty, "evidence": facts_of(fx, first)},
    )


@add(
    "fold_rollups",
    f"""WITH {PROMOTED_CTE}, {DIMENSIONS_CTE}
    SELECT granularity, {iso('period_start')} AS period_start, dimension, value, cnt AS count FROM counts
    UNION ALL SELECT granularity, {iso('period_start')}, '(total)', '', total FROM totals""",
)
def fold_rollups_query(fx: Fixture):
    """A run over the second half on a state with the first: every value and total of the month."""
    totals, counts, _ = fold_rollups(folded_half(fx), fx.buckets.where("seq >= 15"), fx.now)
    sums = totals.select("granularity", "period_start", F.lit("(total)").alias("dimension"), F.lit("").alias("value"), F.col("total").alias("count"))
    return counts.unionByName(sums).withColumn("period_start", shown("period_start"))


@add(
    "fold_evidence",
    f"""WITH {PROMOTED_CTE}, {EVIDENCE_CTE} {FACT_ROWS} facts
    WHERE k IN (SELECT k FROM facts GROUP BY k HAVING max(last_seen) > TIMESTAMP '{NOW}' - INTERVAL 720 HOUR)
      AND fact_day >= CAST(TIMESTAMP '{NOW}' - INTERVAL 720 HOUR AS DATE)""",
)
def fold_evidence_query(fx: Fixture):
    """The same for the evidence of addresses."""
    return fact_rows(fold_evidence(folded_half(fx), fx.buckets.where("seq >= 15"), fx.now))


@add(
    "rollup_periods",
    f"""WITH {PROMOTED_CTE}, {DIMENSIONS_CTE},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY granularity, period_start, dimension ORDER BY cnt DESC, encode(value)) AS rank FROM counts)
    SELECT t.granularity, strftime(t.period_start, '%Y-%m-%dT%H:%M:%SZ') AS start, t.total, r.dimension, r.rank, r.value, r.cnt AS count
    FROM totals t JOIN ranked r ON t.granularity = r.granularity AND t.period_start = r.period_start
    WHERE r.dimension <> 'sources' AND r.rank <= 100""",
)
def rollup_periods_query(fx: Fixture):
    """The published documents, taken apart again."""
    periods = rollup_periods(rollup.period_totals(fx.buckets), rollup.period_dimensions(fx.buckets), heads_of(fx))
    names = [d for d in rollup.DIMENSIONS if d != "sources"]
    lists = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"period.{d}").alias("shown")) for d in names]))
    each = periods.select("granularity", F.col("period.start").alias("start"), F.col("period.total").alias("total"), lists.alias("l"))
    return each.select("granularity", "start", "total", "l.dimension", F.posexplode("l.shown").alias("rank", "v")).select(
        "granularity", "start", "total", "dimension", (F.col("rank") + 1).cast("bigint").alias("rank"), "v.value", "v.count"
    )


@add(
    "write_envelopes",
    """SELECT concat(source, '/', lang, '/', doc_id % 50) AS blob_name FROM documents GROUP BY ALL HAVING count(DISTINCT text) > 1""",
)
def write_envelopes_query(fx: Fixture):
    """Names for which the outbox would get two contents, half of them stored before."""
    name = F.concat_ws("/", "source", "lang", (F.col("doc_id") % 50).cast("string")).alias("blob_name")
    rows = fx.table("documents").select("doc_id", name, F.col("text").cast("binary").alias("content"))
    stored = rows.where("doc_id % 2 = 0").select("blob_name", F.sha2("content", 256).alias("sha256"))
    return envelope_conflicts(rows.where("doc_id % 2 = 1"), stored)




@add(
    "published_rollups",
    f"""WITH {PROMOTED_CTE}, {DIMENSIONS_CTE},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY granularity, period_start, dimension ORDER BY cnt DESC, encode(value)) AS rank FROM counts),
    placed AS (SELECT *, row_number() OVER (PARTITION BY granularity ORDER BY period_start) AS place FROM totals)
    SELECT t.granularity, t.place, strftime(t.period_start, '%Y-%m-%dT%H:%M:%SZ') AS start, t.total, r.dimension, r.rank, r.value, r.cnt AS count
    FROM placed t JOIN ranked r ON t.granularity = r.granularity AND t.period_start = r.period_start
    WHERE r.dimension <> 'sources' AND r.rank <= 100""",
)
def published_rollups_query(fx: Fixture):
    """The documents written in parts, read back from their files as JSON."""
    folder = new_folder(fx.spark, "rollups")
    write_rollups(rollup.period_totals(fx.buckets), rollup.period_dimensions(fx.buckets), heads_of(fx), NOW, folder)
    names = [d for d in rollup.DIMENSIONS if d != "sources"]
    period = f"struct<start:string,total:bigint,sources:{SENSORS},{','.join(f'{d}:{VALUES}' for d in names)}>"
    files = [f"{folder}/{g}.json" for g in GRANULARITIES]
    read = fx.spark.read.text(files, wholetext=True).select(F.from_json("value", f"granularity string, periods array<{period}>").alias("d"))
    each = read.select("d.granularity", F.posexplode("d.periods").alias("place", "period"))
    lists = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"period.{d}").alias("shown")) for d in names]))
    rows = each.select("granularity", "place", "period.start", "period.total", lists.alias("l"))
    rows = rows.select("granularity", "place", "start", "total", "l.dimension", F.posexplode("l.shown").alias("rank", "v"))
    one_based = {c: (F.col(c) + 1).cast("bigint") for c in ("place", "rank")}
    return rows.withColumns(one_based).select("granularity", "place", "start", "total", "dimension", "rank", "v.value", "v.count")


@add(
    "published_manifest",
    """SELECT DISTINCT concat(source, '/', lang, '/', doc_id // 2) AS blob_name FROM documents WHERE doc_id % 5 <> 0""",
)
def published_manifest_query(fx: Fixture):
    """The manifest of a run over all documents, read back from its parts."""
    status = F.when(F.col("doc_id") % 5 == 0, "sequence_gap").when(F.col("doc_id") % 5 == 1, "replay").otherwise("accepted")
    name = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 2).cast("string"))
    path = f"{new_folder(fx.spark, 'manifest')}/manifest.json"
    write_manifest(fx.table("documents").select(name.alias("blob_name"), status.alias("status")), path, single_file=False)
    parts = [f"{parts_folder(path)}/{p['name']}" for p in read_index(fx.spark, path) if "/part-" in p["name"]]
    # quotes end the rows; between two names stands a comma
    return fx.spark.read.option("lineSep", '"').text(parts).where("value LIKE '%/%'").select(F.col("value").alias("blob_name"))
