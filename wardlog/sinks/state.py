"""Versioned central state on plain Parquet.

Layout below the root: ``accepted/run=N`` and ``rejects/run=N`` grow by one folder per run;
``versions/N/<table>`` holds the small tables of run N; ``CURRENT`` names the
last complete run. Readers follow CURRENT, so a run that dies half-way leaves
nothing visible, and its folders are overwritten by the retry. One writer.

The large tables are cut into parts: a period (counts also by a slice of their
values' hash), or a day of evidence. A run writes what it adds to a part as a
delta, ``tables/<table>/v=N/part=P``, and the pointer maps each part to the
deltas in force; readers add them up. A part of more than ``DELTAS`` is folded
into one by the run that touches it, and an expired part leaves the map. So what
a run writes follows the run, not the state.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlog import schemas
from wardlog.config import LIMITS
from wardlog.operators.evidence import merge_evidence
from wardlog.operators.rollup import merge_state
from wardlog.sinks.storage import file_system, replace_file
from wardlog.sources.files import path_exists

HEADS = (
    T.StructType()
    .add("source_id", "string")
    .add("source_epoch", "string")
    .add("kind", "string")
    .add("next_sequence", "string")
    .add("previous_hash", "string")
    .add("digest_a", "decimal(38,0)")
    .add("digest_b", "decimal(38,0)")
)
#: What the last run did to the chains, checked by the next one.
MOVED = (
    T.StructType()
    .add("source_id", "string")
    .add("source_epoch", "string")
    .add("first_sequence", "string")
    .add("steps", "long")
    .add("digest_a", "decimal(38,0)")
    .add("digest_b", "decimal(38,0)")
)
FILES = T.StructType().add("file", "string").add("bytes", "long").add("content", "binary")
PARKED = T.StructType(list(FILES.fields)).add("since", "timestamp")

TABLES: dict[str, T.StructType] = {
    "heads": HEADS,
    "totals": schemas.PERIOD_TOTALS,
    "counts": schemas.PERIOD_COUNTS,
    "overflow": schemas.PERIOD_OVERFLOW,
    "evidence": schemas.EVIDENCE,
    "parked": PARKED,
}
SCHEMAS = TABLES | {"moved": MOVED}

#: Tables in parts, and how their deltas add up.
PARTED = {"totals": merge_state, "counts": merge_state, "overflow": merge_state, "evidence": merge_evidence}
SLICES = 8
DELTAS = 8
Parts = dict[str, dict[str, list[str]]]


@dataclass
class State:
    version: int
    run_key: str | None
    updated_at: str | None
    accepted: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    #: Deltas in force of each part; None for a state of whole tables.
    parts: Parts | None = None
    #: Of the last run alone: accepted rows, what they did to the chains, rows of
    #: tables in parts. None or empty for a state written without them.
    last: DataFrame | None = None
    moved: DataFrame | None = None
    fresh: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None


def _read_pointer(spark: SparkSession, root: str) -> dict:
    path = f"{root}/CURRENT"
    if not path_exists(spark, path):
        return {"version": 0, "run_key": None, "updated_at": None}
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def _write_pointer(spark: SparkSession, root: str, pointer: dict) -> None:
    """Write beside, then rename over: readers see the old or the new one."""
    system, beside = file_system(spark, f"{root}/CURRENT.next")
    out = system.create(beside, True)
    out.write(bytearray(json.dumps(pointer).encode()))
    out.close()
    replace_file(spark, f"{root}/CURRENT.next", f"{root}/CURRENT")


def load_state(spark: SparkSession, root: str) -> State:
    """The last committed state; empty tables before the first run."""
    pointer = _read_pointer(spark, root)
    version = pointer["version"]
    if version == 0:
        empty = lambda schema: spark.createDataFrame([], schema)
        return State(0, None, None, empty(schemas.ACCEPTED), {n: empty(s) for n, s in TABLES.items()})
    runs = spark.read.schema(T.StructType(list(schemas.ACCEPTED.fields)).add("run", "integer")).parquet(f"{root}/accepted")
    accepted = runs.where(F.col("run") <= version).drop("run")
    parts = pointer.get("parts")
    whole = [n for n in TABLES if parts is None or n not in PARTED]
    tables = {n: spark.read.schema(TABLES[n]).parquet(f"{root}/versions/{version}/{n}") for n in whole}
    tables |= read_parts(spark, root, parts) if parts is not None else {}
    state = State(version, pointer["run_key"], pointer["updated_at"], accepted, tables, parts)
    if pointer.get("chains"):
        state.last = runs.where(F.col("run") == version).drop("run")
        state.moved = spark.read.schema(MOVED).parquet(f"{root}/versions/{version}/moved")
    if parts is not None:
        own = (str(version), f"{version}-folded")
        newest = {n: {p: [v for v in held if v in own] for p, held in parts.get(n, {}).items()} for n in PARTED}
        state.fresh = {n: read_part(spark, root, n, {p: v for p, v in held.items() if v}) for n, held in newest.items()}
    return state


def part_of(name: str) -> Column:
    if name == "evidence":
        return F.concat(F.lit("day-"), F.unix_date("day").cast("string"))
    period = [F.col("granularity"), F.lit("-"), F.unix_seconds("period_start").cast("string")]
    if name == "counts":
        period += [F.lit("-"), F.pmod(F.xxhash64("dimension", "value"), F.lit(SLICES)).cast("string")]
    return F.concat(*period)


def expired(part: str, now: datetime) -> bool:
    """Whether the retention of a part is over: days of evidence and hourly periods have one."""
    kind, number = part.split("-")[:2]
    if kind == "day":
        return int(number) < (now - timedelta(days=LIMITS.persistent_days) - datetime(1970, 1, 1, tzinfo=timezone.utc)).days
    return kind == "hourly" and int(number) + 3600 < (now - timedelta(days=LIMITS.period_retention_days)).timestamp()


def _delta_path(root: str, name: str, version: str, part: str) -> str:
    return f"{root}/tables/{name}/v={version}/part={part}"


def read_part(spark: SparkSession, root: str, name: str, parts: dict[str, list[str]]) -> DataFrame:
    """The rows of these parts of a table, deltas added up."""
    paths = [_delta_path(root, name, v, p) for p, versions in sorted(parts.items()) for v in versions]
    if not paths:
        return spark.createDataFrame([], TABLES[name])
    rows = spark.read.schema(TABLES[name]).parquet(*paths)
    return rows if all(len(v) == 1 for v in parts.values()) else PARTED[name](rows).select(*TABLES[name].fieldNames())


def read_parts(spark: SparkSession, root: str, parts: Parts) -> dict[str, DataFrame]:
    return {name: read_part(spark, root, name, parts.get(name, {})) for name in PARTED}


def write_delta(df: DataFrame, root: str, version: str, name: str) -> list[str]:
    """Write rows of a table by parts; the parts written."""
    folder = f"{root}/tables/{name}/v={version}"
    rows = df.select(*TABLES[name].fieldNames()).withColumn("part", part_of(name)).repartition("part")
    rows.write.mode("overwrite").partitionBy("part").parquet(folder)
    system, path = file_system(df.sparkSession, folder)
    names = [status.getPath().getName() for status in system.listStatus(path)]
    return sorted(n.removeprefix("part=") for n in names if n.startswith("part="))


def fold_parts(state: State, deltas: dict[str, DataFrame], root: str, version: int, now: datetime) -> Parts:
    """Write what a run adds (rows of each table) and give the new map of parts."""
    spark = state.accepted.sparkSession
    out: Parts = {}
    for name, merge in PARTED.items():
        held = {p: list(v) for p, v in (state.parts or {}).get(name, {}).items() if not expired(p, now)}
        added = deltas.get(name)
        if state.parts is None and state.version:  # a state of whole tables moves over as one delta
            added = state.tables[name] if added is None else merge(state.tables[name], added)
        written = write_delta(added, root, str(version), name) if added is not None else []
        for part in written:
            if not expired(part, now):
                held.setdefault(part, []).append(str(version))
        full = {p: v for p, v in held.items() if len(v) > DELTAS}
        if full:
            for part in write_delta(read_part(spark, root, name, full), root, f"{version}-folded", name):
                held[part] = [f"{version}-folded"]
        out[name] = held
    return out


def stage(df: DataFrame, root: str, version: int, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: cuts
    lineage, and later steps read only the columns they need."""
    path = f"{root}/staging/{version}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_version(df: DataFrame, root: str, version: int, name: str) -> DataFrame:
    """Write one whole table of a version and read it back."""
    path = f"{root}/versions/{version}/{name}"
    df.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS[name].fields]).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(SCHEMAS[name]).parquet(path)


def append_accepted(df: DataFrame, root: str, version: int) -> None:
    df.select(*schemas.ACCEPTED.fieldNames()).write.mode("overwrite").parquet(f"{root}/accepted/run={version}")


REJECTS = ("file", "sha256", "bytes", "reason")


def append_rejects(df: DataFrame, root: str, version: int) -> None:
    """All refused files of a run with their reasons."""
    df.select(*REJECTS).write.mode("overwrite").parquet(f"{root}/rejects/run={version}")


def load_rejects(spark: SparkSession, root: str) -> DataFrame:
    """Refused files of the committed runs."""
    version = _read_pointer(spark, root)["version"]
    if version == 0:
        return spark.createDataFrame([], "file string, sha256 string, bytes bigint, reason string, run int")
    return spark.read.parquet(f"{root}/rejects").where(F.col("run") <= version)


def reject_counts(rejects: DataFrame) -> DataFrame:
    """Refused files per run and reason."""
    return rejects.groupBy("run", "reason").agg(F.count("*").alias("files"))


def commit_state(
    spark: SparkSession, root: str, version: int, run_key: str, updated_at: str | None, parts: Parts, chains: bool = False
) -> None:
    """Make a fully written version current: the last step of a run. ``chains``
    says that the heads carry digests and the version has a table ``moved``."""
    pointer = {"version": version, "run_key": run_key, "updated_at": updated_at, "parts": parts, "chains": chains}
    _write_pointer(spark, root, pointer)
