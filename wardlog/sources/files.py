"""File sources: envelopes, registry, never-block list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlog import schemas
from wardlog.config import LIMITS, NAMES, WireNames
from wardlog.functions.addresses import cidr_columns
from wardlog.functions.text import first_reason, holds, valid_identity, valid_key_id, valid_repository
from wardlog.operators.canonical import base64url
from wardlog.sources.empty import empty_files


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def qualified(spark: SparkSession, path: str) -> str:
    """Path with scheme, as ``_metadata`` and the binary reader report it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(hadoop).toString().rstrip("/")


def scan_envelopes(spark: SparkSession, root: str) -> DataFrame:
    """Every ``*.json`` below ``root``: file (relative), bytes, content. Empty
    files come from a listing of their own, since Spark's reader leaves them out.

    Content is kept only for files of a legal size; the reader prunes it for
    plans that need the listing alone.
    """
    base = qualified(spark, root)
    # Both sides in one spelling: the reader writes file:/x and file:///x.
    plain = F.regexp_replace(F.regexp_replace("path", r"\A[a-z0-9]+:/+", "/"), r"/+", "/")
    prefix = "/" + base.split(":", 1)[-1].strip("/") + "/"
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .load(root)
    )
    filled = files.select(
        F.substring(plain, len(prefix) + 1, 2**31 - 1).alias("file"),
        F.col("length").alias("bytes"),
        F.when(F.col("length").between(1, LIMITS.envelope_bytes), F.col("content")).alias("content"),
    ).where(F.col("bytes") > 0)
    empty = empty_files(spark, root, "*.json").select("file", F.lit(0).cast("bigint").alias("bytes"))
    return filled.unionByName(empty, allowMissingColumns=True)


def _document(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], item: str, item_keys: list[str]) -> DataFrame:
    """A strict JSON document as one row ``doc``: one value, no unknown keys at
    the top or in its list."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\s+\z", "").alias("value"))
    digest = F.sha2(F.col("value").cast("binary"), 256)
    wrapped = F.json_object_keys(F.concat(F.lit('{"x":'), "value", F.lit(',"'), digest, F.lit('":1}')))
    loose = F.from_json("value", f"`{item}` ARRAY<VARIANT>")[item]
    item_unknown = F.exists(
        F.transform(loose, lambda v: F.json_object_keys(F.to_json(v))),
        lambda names: names.isNull() | (F.size(F.array_except(names, F.array(*[F.lit(k) for k in item_keys]))) > 0),
    )
    problem = first_reason(
        (~holds(F.octet_length("value") > 0), "is empty"),
        (~holds(F.is_valid_utf8(F.col("value"))), "is not valid UTF-8"),
        (~holds(wrapped == F.array(F.lit("x"), digest)), "is not one JSON value"),
        (
            ~holds(F.size(F.array_except(F.json_object_keys("value"), F.array(*[F.lit(k) for k in keys]))) == 0),
            "has unknown fields",
        ),
        (F.coalesce(item_unknown, F.lit(False)), "has unknown fields in its entries"),
    )
    return text.select(F.from_json("value", schema).alias("doc"), problem.alias("problem"))


def _insist(df: DataFrame, what: str, problem: str = "problem") -> DataFrame:
    """Raise inside the job when any row has a problem."""
    failure = F.raise_error(F.concat(F.lit(f"{what} "), F.col(problem)))
    return df.where(F.when(F.col(problem).isNull(), F.lit(True)).otherwise(failure.cast("boolean"))).drop(problem)


def read_registry(spark: SparkSession, path: str, repository: str, names: WireNames = NAMES) -> DataFrame:
    """Sensor dimension table, validated; any violation fails the read."""
    fields = [f.name for f in schemas.REGISTRATION.fields]
    wire = ["github_repository" if f == "repository" else f for f in fields]
    entry = T.StructType()
    for field, written in zip(schemas.REGISTRATION.fields, wire):
        entry = entry.add(written, field.dataType)
    schema = (
        T.StructType().add("schema_version", "string").add("repository", "string").add("sources", T.ArrayType(entry))
    )
    document = _insist(
        _document(spark, path, schema, ["schema_version", "repository", "sources"], "sources", wire)
        .withColumn(
            "problem",
            F.coalesce(
                "problem",
                first_reason(
                    (~holds(F.col("doc.schema_version") == names.schema("registry")), "has another schema"),
                    (~holds(F.col("doc.repository") == repository), "belongs to another repository"),
                    (
                        F.size("doc.sources")
                        > F.size(
                            F.array_distinct(
                                F.transform("doc.sources", lambda s: F.concat_ws("/", s["source_id"], s["source_epoch"]))
                            )
                        ),
                        "repeats a source epoch",
                    ),
                ),
            ),
        ),
        "source registry",
    )
    sources = document.select(F.explode("doc.sources").alias("s")).select("s.*")
    sources = (
        sources.withColumnRenamed("github_repository", "repository")
        .withColumn("kind", F.coalesce(F.nullif("kind", F.lit("")), F.lit("host")))
        .withColumn("repository", F.nullif("repository", F.lit("")))
        .withColumn("enabled", F.coalesce("enabled", F.lit(False)))
    )
    problem = first_reason(
        (~valid_identity(F.col("source_id"), F.col("source_epoch")), "has an invalid identity"),
        (~valid_key_id(F.col("key_id")), "has an invalid key id"),
        (~F.col("kind").isin("host", "decoy"), "has an unknown kind"),
        (F.col("repository").isNotNull() & ~valid_repository(F.col("repository")), "has an invalid repository name"),
        (
            ~holds(F.col("blob_prefix") == F.concat("source_id", F.lit("/"), "source_epoch", F.lit("/"))),
            "has a non-deterministic blob prefix",
        ),
        (~holds(F.octet_length(base64url(F.col("public_key"))) == 32), "has an invalid public key"),
    )
    return _insist(sources.withColumn("problem", problem), "source registry")


def read_never_block(spark: SparkSession, path: str, names: WireNames = NAMES) -> DataFrame:
    """Masked CIDRs (prefix, family, hi, lo, bits, reason); a missing file
    means no entries."""
    out = "prefix string, family int, hi bigint, lo bigint, bits int, reason string"
    if not path_exists(spark, path):
        return spark.createDataFrame([], out)
    entry = T.StructType().add("cidr", "string").add("reason", "string")
    schema = T.StructType().add("schema_version", "string").add("entries", T.ArrayType(entry))
    document = _insist(
        _document(spark, path, schema, ["schema_version", "entries"], "entries", ["cidr", "reason"])
        .withColumn(
            "problem",
            F.coalesce(
                "problem",
                first_reason(
                    (~holds(F.col("doc.schema_version") == names.schema("never-block")), "has another schema"),
                ),
            ),
        ),
        "never-block list",
    )
    entries = (
        document.select(F.explode("doc.entries").alias("e"))
        .select("e.reason", cidr_columns(F.col("e.cidr")).alias("c"))
        .withColumn(
            "problem",
            first_reason(
                (F.col("c").isNull(), "has an invalid cidr"),
                (
                    ~holds(F.octet_length("reason").between(1, LIMITS.reason_bytes) & F.is_valid_utf8(F.col("reason"))),
                    "needs a reason of at most 200 bytes",
                ),
            ),
        )
    )
    return _insist(entries, "never-block list").select("c.*", "reason")
