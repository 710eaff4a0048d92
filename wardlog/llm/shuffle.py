"""Operator 8 [native]: a uniform shuffle with exact shard sizes.

Law ``rows``: shard counts at most one apart. How many rows each input part
sends to each shard is drawn from the multivariate hypergeometric law, exactly
as a uniform permutation of all rows would deal them. The matrix is drawn down a
binary tree over the parts: a node's counts per shard are split between its two
halves by conditional hypergeometric draws, so a level is one DataFrame and the
number of levels is the logarithm of the number of parts. Then the rows of each
part are permuted and cut by its row of the matrix, exchanged, and permuted
again inside their shard to get their slot.

Only DataFrame functions run. No group is a whole shard: slots are numbered
inside (shard, range of the random key) and shifted by the counts before. Parts
and key ranges are hashed from a row and its number among rows alike, so neither
keys nor repeated rows are hot.

Defined cases: a null text has 16 bytes and crc32 zero; rows that repeat a
doc_id and text are dealt one by one, apart from each other; very long texts count
by their bytes alone; fewer rows than shards leave shards
empty; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlog.session import stage_table

SHARDS = 40
SEED = 20240607
#: Weights are computed this many standard deviations around the mode; less than 1e-30 lies beyond.
SPREAD = 12
#: Repeated rows are dealt out again by so many.
CHUNK = 4096
#: From this level of the tree on its nodes are drawn by as many tasks as it has nodes.
SPREAD_LEVEL = 4


def uniform(*columns: Column | int | str) -> Column:
    """A number in (0, 1) that depends on the arguments alone."""
    parts = [F.lit(c) if isinstance(c, int) else c for c in columns]
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def log_factorial(x: Column) -> Column:
    """ln x!, by table up to 20 and by Stirling's series above."""
    y = F.greatest(x, F.lit(1)).cast("double")
    series = y * F.log(y) - y + F.log(y * 6.283185307179586) / 2 + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0)))
    return F.when(x <= 20, F.log(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def let(value: Column, body) -> Column:
    """``body`` over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(whole: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Marked balls among ``drawn`` of ``whole`` without replacement, by inversion at ``u``."""
    least = F.greatest(F.lit(0).cast("long"), drawn + marked - whole)
    most = F.least(drawn, marked)
    size = F.greatest(whole, F.lit(1)).cast("double")
    mean = drawn * marked / size
    sd = F.sqrt(F.greatest(F.lit(0.0), mean * (1 - marked / size) * (1 - drawn / size)))
    around = F.ceil(sd * SPREAD) + SPREAD
    low = F.greatest(least, F.floor(mean) - around)
    high = F.least(most, F.floor(mean) + around)

    def weight(k: Column) -> Column:
        return -(
            log_factorial(k)
            + log_factorial(marked - k)
            + log_factorial(drawn - k)
            + log_factorial(whole - marked - drawn + k)
        )

    def pick(rows: Column) -> Column:
        top = F.array_max(F.transform(rows, lambda r: r["w"]))
        shares = F.transform(rows, lambda r: F.struct(r["k"].alias("k"), F.exp(r["w"] - top).alias("w")))

        def choose(scaled: Column) -> Column:
            total = F.aggregate(scaled, F.lit(0.0), lambda a, r: a + r["w"])
            start = F.struct(total * u, F.lit(None).cast("long"))

            def step(acc: Column, r: Column) -> Column:
                left = acc["col1"] - r["w"]
                return F.struct(left.alias("col1"), F.coalesce(acc["col2"], F.when(left <= 0, r["k"])).alias("col2"))

            found = F.aggregate(scaled, start, step)["col2"]
            return F.coalesce(found, F.element_at(scaled, -1)["k"])

        return let(shares, choose)

    candidates = F.transform(F.sequence(low, high), lambda k: F.struct(k.alias("k"), weight(k).alias("w")))
    return F.when(most <= least, least).otherwise(let(candidates, pick))


def split(counts: Column, drawn: Column, *salt: Column | int) -> Column:
    """Of ``counts`` per shard, those that a draw of ``drawn`` rows takes."""
    start = F.struct(
        F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c).alias("whole"),
        drawn.alias("drawn"),
        F.array().cast("array<bigint>").alias("taken"),
    )

    def step(acc: Column, shard: Column) -> Column:
        marked = F.get(counts, shard)
        k = hypergeometric(acc["whole"], marked, acc["drawn"], uniform(*salt, shard))
        return let(
            k,
            lambda n: F.struct(
                (acc["whole"] - marked).alias("whole"),
                (acc["drawn"] - n).alias("drawn"),
                F.concat(acc["taken"], F.array(n)).alias("taken"),
            ),
        )

    return F.aggregate(F.sequence(F.lit(0), F.size(counts) - 1), start, step)["taken"]


def communication_matrix(sizes: DataFrame, parts: int, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(part, row array<long>): rows that each part sends to each shard.
    ``sizes`` is (part, n) with parts 0 to ``parts`` - 1; missing ones are empty."""
    levels = max(0, (parts - 1).bit_length())
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    even = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.floor(F.col("n") / shards) + F.when(s < F.col("n") % shards, 1).otherwise(0),
    )
    nodes = total.select(F.lit(0).cast("long").alias("node"), even.alias("row"))
    for level in range(levels):
        if level == SPREAD_LEVEL:
            nodes = nodes.repartition(1 << SPREAD_LEVEL, "node")
        own = sizes.groupBy(F.shiftright("part", levels - level - 1).cast("long").alias("child")).agg(F.sum("n").alias("n"))
        left = own.where("child % 2 = 0").select(F.shiftright("child", 1).alias("node"), F.col("n").alias("left_n"))
        halved = nodes.join(left, "node", "left").withColumn(
            "taken", split(F.col("row"), F.coalesce("left_n", F.lit(0)).cast("long"), seed, level, F.col("node"))
        )
        rest = F.zip_with("row", "taken", lambda a, b: a - b)
        both = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("taken").alias("row")), F.struct(F.lit(1).alias("k"), rest.alias("row"))))
        nodes = halved.select("node", both.alias("half")).select(
            (F.col("node") * 2 + F.col("half.k")).alias("node"), F.col("half.row").alias("row")
        )
    return nodes.where(F.col("node") < parts).select(F.col("node").cast("int").alias("part"), "row")


def shuffle(docs: DataFrame, shards: int = SHARDS, parts: int | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.
    ``parts`` defaults to the session's shuffle partitions, which follow the data."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    octets = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(octets) + 16).cast("long").alias("size"),
        F.crc32(octets).alias("text_crc32"),
    )
    # Rows that repeat are counted and dealt out again in chunks with a number each, so that they part.
    alike = ["doc_id", "size", "text_crc32"]
    counted = rows.groupBy(*alike).agg(F.count("*").alias("n"))
    chunks = counted.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (n - 1) div {CHUNK})"))).repartition(parts, *alike, "chunk")
    copies = F.sequence(F.col("chunk") * CHUNK, F.least("n", (F.col("chunk") + 1) * CHUNK) - 1)
    rows = chunks.select(*alike, F.explode(copies).alias("copy"))
    own = [F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("copy")]
    part = F.pmod(F.xxhash64(F.lit(seed), *own), F.lit(parts)).cast("int")
    rows = stage_table(rows.withColumn("part", part), "shuffle")
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    matrix = communication_matrix(sizes, parts, shards, seed)

    def permuted(by: list[str], salt: int) -> Column:
        return F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(salt), *own), *own))

    ends = F.transform(
        F.sequence(F.lit(1), F.size("row")), lambda s: F.aggregate(F.slice("row", 1, s), F.lit(0).cast("long"), lambda a, x: a + x)
    )
    shard = F.size(F.filter("ends", lambda e: e < F.col("place")))
    sent = (
        rows.withColumn("place", permuted(["part"], seed + 1))
        .join(matrix.select("part", ends.alias("ends")), "part")
        .withColumn("shard", shard.cast("int"))
        .withColumn("bin", F.floor(uniform(F.lit(seed + 2), *own) * parts).cast("int"))
        .select(*alike, "copy", "shard", "bin")
    )
    sent = stage_table(sent, "shuffle")
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = sent.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    bases = bins.select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = sent.withColumn("place", permuted(["shard", "bin"], seed + 3)).join(bases, ["shard", "bin"])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("base") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
