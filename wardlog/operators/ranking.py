"""Exact top-n per group that never puts a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounded_top(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    n: int,
    salt_on: list[str],
    rank: str | None = None,
) -> DataFrame:
    """The first ``n`` rows of each group in a total order.

    A group is first cut within slices, as many as the session's shuffle
    partitions, so that a hot group is ranked by the whole cluster; the last
    step sees at most ``n`` rows of each slice. The plan is the same for any n.
    """
    column = rank or "_rank"
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = Window.partitionBy(*keys, "_slice").orderBy(*order)
    cut = (
        df.withColumn("_slice", F.pmod(F.xxhash64(*salt_on), F.lit(slices)))
        .withColumn("_rank", F.row_number().over(sliced))
        .where(F.col("_rank") <= n)
        .drop("_rank", "_slice")
    )
    whole = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(*order)
    ranked = cut.withColumn(column, F.row_number().over(whole)).where(F.col(column) <= n)
    return ranked if rank else ranked.drop(column)


def narrowed(df: DataFrame, digits: list[Column], n: int) -> tuple[list[DataFrame], DataFrame, Column]:
    """(parts that surely belong to the first ``n``, rows of the edge, how many
    of these still belong). Each digit is counted, the counts summed from the
    highest digit down: digits above the one that reaches ``n`` are settled, the
    next digit cuts the rows of that one. Digits take few values by contract
    (an hour, four bytes of an address), so a histogram is small; the edge reaches
    the filters as scalar subqueries, so no row moves and no job runs while
    planning. Each level nests those before it: three are enough, four too many."""
    names = [f"_digit{i}" for i in range(len(digits))]
    edge = df.select("*", *[F.coalesce(d.cast("bigint"), F.lit(-(1 << 63))).alias(name) for d, name in zip(digits, names)])
    settled, left = [], F.lit(n).cast("bigint")
    for name in names:
        before = Window.orderBy(F.col(name).desc()).rowsBetween(Window.unboundedPreceding, -1)
        histogram = edge.groupBy(name).agg(F.count("*").alias("_n"))
        reached = (
            histogram.select(name, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_above"))
            .where(F.col("_above") < left)
            .agg(F.min_by(F.struct(F.col(name).alias("digit"), (left - F.col("_above")).alias("left")), name).alias("_e"))
        )
        found = reached.scalar()
        settled.append(edge.where(F.col(name) > found["digit"]).drop(*names))
        edge, left = edge.where(F.col(name) == found["digit"]), found["left"]
    return settled, edge.drop(*names), left


def threshold_top(df: DataFrame, digits: list[Column], order: list[Column], n: int, salt_on: list[str]) -> DataFrame:
    """The first ``n`` rows of a whole table in a total order that begins with
    descending ``digits``. Only the rows of the last digit's edge are ranked;
    what they tie on is the whole chain of digits. Null digits come last."""
    settled, edge, left = narrowed(df, digits, n)
    top = bounded_top(edge, [], order, n, salt_on, rank="_place").where(F.col("_place") <= left).drop("_place")
    for part in settled:
        top = top.unionByName(part)
    return top


def text_digits(column: Column, count: int) -> list[Column]:
    """The first ``4 * count`` bytes of a text as digits of four bytes each. A
    text that ends early counts as followed by zero bytes, as texts are ordered."""
    data = F.rpad(F.hex(F.substring(column.cast("binary"), 1, 4 * count)), 8 * count, "0")
    return [F.conv(F.substring(data, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(count)]
