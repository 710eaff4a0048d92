"""The numbers of the public dashboard, from the full counts of the state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlog.functions.times import hours, period_end
from wardlog.operators.ranking import bounded_top


def dashboard_total(totals: DataFrame) -> DataFrame:
    return totals.where(F.col("granularity") == "yearly").agg(
        F.coalesce(F.sum("total"), F.lit(0)).cast("bigint").alias("total")
    )


def dashboard_source_kinds(labelled: DataFrame) -> DataFrame:
    """Distinct sensors by kind over the yearly periods; a sensor listed with
    several kinds counts under the one of its latest period."""
    sensors = (
        labelled.where(F.col("granularity") == "yearly")
        .groupBy("source_id", "source_epoch")
        .agg(F.max_by("kind", "period_start").alias("kind"))
    )
    decoy = F.col("kind") == "decoy"
    return sensors.agg(
        F.count("*").alias("sensors"),
        F.count(F.when(decoy, 1)).alias("decoys"),
        F.count(F.when(~decoy, 1)).alias("hosts"),
    )


def dashboard_ip_versions(counts: DataFrame) -> DataFrame:
    """Count and share of each family over all addresses of the yearly periods."""
    v6 = F.contains(F.col("value"), F.lit(":"))
    sums = counts.where((F.col("granularity") == "yearly") & (F.col("dimension") == "source_ips")).agg(
        F.coalesce(F.sum(F.when(v6, 0).otherwise(F.col("count"))), F.lit(0)).alias("ipv4"),
        F.coalesce(F.sum(F.when(v6, F.col("count")).otherwise(0)), F.lit(0)).alias("ipv6"),
    )
    share = lambda n: F.when(
        F.col("ipv4") + F.col("ipv6") > 0, F.round(n * 100.0 / (F.col("ipv4") + F.col("ipv6")), 1)
    )
    pair = F.array(
        F.struct(F.lit("ipv4").alias("family"), F.col("ipv4").alias("count"), share(F.col("ipv4")).alias("percent")),
        F.struct(F.lit("ipv6").alias("family"), F.col("ipv6").alias("count"), share(F.col("ipv6")).alias("percent")),
    )
    return sums.select(F.inline(pair))


def dashboard_top_values(counts: DataFrame, n: int = 20) -> DataFrame:
    """Top values per dimension after adding up all yearly values."""
    totals = (
        counts.where((F.col("granularity") == "yearly") & (F.col("dimension") != "sources"))
        .groupBy("dimension", "value")
        .agg(F.sum("count").alias("count"))
    )
    order = [F.col("count").desc(), F.col("value").asc()]
    return bounded_top(totals, ["dimension"], order, n, salt_on=["dimension", "value"], rank="rank")


def dashboard_freshness(accepted: DataFrame, now: Column, updated: Column) -> DataFrame:
    """Age of the newest accepted batch and its verdict."""
    newest = accepted.agg(F.max(updated).alias("updated_at"))
    age = F.col("updated_at")
    return newest.withColumn(
        "freshness",
        F.when(age.isNull() | (age > now + hours(1)), "unavailable")
        .when(age < now - hours(3), "stale")
        .otherwise("current"),
    )


def recent_hours(totals: DataFrame, n: int) -> DataFrame:
    """Hourly periods ending within ``n`` hours of the latest one; the last two
    periods when fewer than two qualify. Hourly periods are bounded by their
    retention, so the closing window covers a few hundred rows."""
    end = period_end(F.col("granularity"), F.col("period_start"))
    hourly = totals.where(F.col("granularity") == "hourly").withColumn("period_end", end)
    everything = Window.partitionBy("granularity")
    marked = (
        hourly.withColumn("_latest", F.max("period_end").over(everything))
        .withColumn("_rank", F.row_number().over(everything.orderBy(F.col("period_start").desc())))
        .withColumn("_recent", F.col("period_end") > F.col("_latest") - hours(n))
        .withColumn("_count", F.sum(F.col("_recent").cast("int")).over(everything))
    )
    chosen = F.when(F.col("_count") < 2, F.col("_rank") <= 2).otherwise(F.col("_recent"))
    return marked.where(chosen).select("period_start", "period_end", "total")
