"""The event store: content hashes, insert-if-absent, collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTENT = ("event_id", "kind", "observed_at", "source_ip", "username", "password", "path", "status")


def content_hash(columns: list[str]) -> Column:
    """Hash of what an event says. The cursor and the query string are not
    part of it, so the same event read again from elsewhere hashes the same."""
    return F.sha2(F.to_json(F.struct(*[c for c in CONTENT if c in columns])), 256)


def with_content_hash(events: DataFrame) -> DataFrame:
    return events.withColumn("event_hash", content_hash(events.columns))


def first_copies(events: DataFrame, arrival: Column) -> DataFrame:
    """One row per event id, the earliest to arrive. A grouped aggregation, so
    copies of a hot event collapse before the shuffle."""
    whole = F.struct(*events.columns)
    return (
        events.groupBy("event_id")
        .agg(F.min_by(whole, arrival).alias("_e"))
        .select("_e.*")
    )


def stored_copies(new: DataFrame, store: DataFrame, *columns: str) -> DataFrame:
    """The store's rows for the ids in ``new``. Joining from the new ids lets a
    small batch be broadcast over the store's scan at run time; only the id
    and the named columns of the store are read."""
    return store.select("event_id", *columns).join(new.select("event_id").distinct(), "event_id", "left_semi")


def dedup_events(new: DataFrame, store: DataFrame, arrival: Column) -> DataFrame:
    """Events of ``new`` whose id the store lacks, one row per id."""
    return first_copies(new, arrival).join(stored_copies(new, store), "event_id", "left_anti")


def event_collisions(new: DataFrame, store: DataFrame, arrival: Column) -> DataFrame:
    """Event ids seen with different contents: (event_id, kept_hash, other_hash).

    ``kept_hash`` is the stored content, or the first to arrive when the id is
    new. One aggregation over the union; ids with one content produce nothing.
    """
    first = F.struct(F.lit(1).alias("fresh"), arrival.alias("at"))
    fresh = new.select("event_id", "event_hash", first.alias("_order"))
    stored = stored_copies(new, store, "event_hash").select(
        "event_id",
        "event_hash",
        F.struct(F.lit(0).alias("fresh"), F.lit(None).cast(fresh.schema["_order"].dataType["at"].dataType).alias("at")).alias("_order"),
    )
    contents = fresh.unionByName(stored).groupBy("event_id", "event_hash").agg(F.min("_order").alias("_order"))
    kept = contents.groupBy("event_id").agg(
        F.min_by("event_hash", "_order").alias("kept_hash"), F.count("*").alias("_n")
    )
    return (
        contents.join(kept.where(F.col("_n") > 1), "event_id")
        .where(F.col("event_hash") != F.col("kept_hash"))
        .select("event_id", "kept_hash", F.col("event_hash").alias("other_hash"))
    )
