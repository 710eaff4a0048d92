"""The sensor's own state: what waits for a batch, chain heads, unpublished batches.

``batches/run=N``, ``assigned/run=N`` and ``receipts/run=N`` grow by one folder a
run; ``versions/N/<table>`` holds the small tables; ``CURRENT`` names the last
complete run and, per collector stream, the last commit of the event store that
was taken in. Every stored event is read once: by the first run after its
commit. Until it is old enough it is a row of ``waiting``, so no run asks the
history which events are in a batch already. ``pending`` has only the keys of
unpublished batches. One writer; a run that dies leaves nothing visible.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from wardlog.sinks.storage import file_system, replace_file, write_bytes
from wardlog.sources.files import path_exists

HEADS = "source_id string, source_epoch string, next_sequence string, previous_hash string"
PENDING = "source_id string, source_epoch string, sequence string, payload_hash string, blob_name string, run int"


@dataclass
class SensorState:
    version: int
    run_key: str | None
    heads: DataFrame
    pending: DataFrame
    #: Events that were too young for the last cut; None before the first event.
    waiting: DataFrame | None = None
    #: Last commit taken in, per stream.
    taken: dict[str, int] = field(default_factory=dict)


def load_sensor(spark: SparkSession, root: str) -> SensorState:
    """The last committed state; empty before the first run."""
    if not path_exists(spark, f"{root}/CURRENT"):
        return SensorState(0, None, spark.createDataFrame([], HEADS), spark.createDataFrame([], PENDING))
    pointer = json.loads(spark.read.text(f"{root}/CURRENT", wholetext=True).first().value)
    folder = f"{root}/versions/{pointer['version']}"
    waiting = spark.read.parquet(f"{folder}/waiting") if pointer["waits"] else None
    heads, pending = (spark.read.schema(s).parquet(f"{folder}/{n}") for n, s in (("heads", HEADS), ("pending", PENDING)))
    return SensorState(pointer["version"], pointer["run_key"], heads, pending, waiting, pointer["taken"])


def split_commit(name: str) -> tuple[str, int]:
    """Stream and number of a commit's name."""
    stream, dash, number = name.rpartition("-")
    if not dash or not number.isdigit():
        raise ValueError(f"commit {name!r} has no number: a later one could not be told from it")
    return stream, int(number)


def new_commits(spark: SparkSession, store: str, taken: dict[str, int]) -> list[str]:
    """Complete commits of the event store beyond those taken. A stream numbers
    its commits upwards, and its table of collisions is written after its events."""
    if not path_exists(spark, f"{store}/collisions"):
        return []
    system, path = file_system(spark, f"{store}/collisions")
    folders = [s.getPath().getName() for s in system.listStatus(path)]
    names = [n.removeprefix("commit=") for n in folders if n.startswith("commit=")]
    beyond = [n for n in names if split_commit(n)[1] > taken.get(split_commit(n)[0], -1)]
    return sorted((n for n in beyond if path_exists(spark, f"{store}/collisions/commit={n}/_SUCCESS")), key=split_commit)


def take(spark: SparkSession, store: str, commits: list[str]) -> DataFrame | None:
    """The events of these commits, nothing else of the store is opened."""
    folders = [f"{store}/events/commit={c}" for c in commits]
    folders = [f for f in folders if path_exists(spark, f)]  # a commit may have no event
    if not folders:
        return None
    return spark.read.option("basePath", f"{store}/events").parquet(*folders).drop("commit", "day")


def taken_after(taken: dict[str, int], commits: list[str]) -> dict[str, int]:
    out = dict(taken)
    for stream, number in map(split_commit, commits):
        out[stream] = max(number, out.get(stream, -1))
    return out


def write_table(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def commit_sensor(spark: SparkSession, root: str, version: int, run_key: str, taken: dict[str, int], waits: bool) -> None:
    """The last step of a run: beside, then renamed over."""
    pointer = {"version": version, "run_key": run_key, "taken": taken, "waits": waits}
    write_bytes(spark, f"{root}/CURRENT.next", json.dumps(pointer).encode())
    replace_file(spark, f"{root}/CURRENT.next", f"{root}/CURRENT")
