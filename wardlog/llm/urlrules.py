"""Operator 13: URL rules by host suffixes and path prefixes.

A rule (host, path, verdict) fits its host and all subdomains where the url's
path starts with the rule's. Urls are expanded to the suffixes of their hosts;
those join the hosts of the rules on the first ``SHORT`` hex digits of their
SHA-256, and the whole digests confirm. Only for hosts that have rules the path
is expanded, to the lengths these rules have; host and path prefix join the
rules in the same way. The longest rule (host and path) wins, then the longer
host, then block before allow. Only DataFrame functions, no Python.

Rules are dealt out ``SALTS`` times with a salt, urls draw one by their hash, so
that a host with a third of all urls is spread. No side is broadcast by hand.

Defined cases: a null url, or one without ``://``, has an empty host and path; a
port or user name is part of the host; no fitting rule gives a null rule and the
``default`` verdict; rules alike in host and path are one, which blocks if any
does; rules with a null host or path fit nothing; repeated rows (page_id, host,
path) come back as often; hosts and paths of any length are matched whole, hosts
being cut no deeper than the rules' hosts are; an empty table, or empty rules,
work; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHORT = 8
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host up to the first of / ? #, path up to the first of ? #.
PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Rules as literals, whose size the planner sees."""
    quoted = [tuple("'" + part.replace("\\", "\\\\").replace("'", "\\'") + "'" for part in rule) for rule in rules]
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(q) + ')' for q in quoted)} AS rules(host, path, verdict)")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lowered, path)."""
    plain = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(plain, PARTS, 1), UPPER, LOWER), F.regexp_extract(plain, PARTS, 2)


def _keyed(rows: DataFrame, name: str, expression: Column) -> DataFrame:
    """Digest of an expression and its short form."""
    digest = F.sha2(expression.cast("binary"), 256)
    return rows.withColumn(name, digest).withColumn("short", F.substring(name, 1, SHORT))


def _salted(rules: DataFrame) -> DataFrame:
    return rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _pair(host: Column, path: Column) -> Column:
    """A host holds no slash, so the two parts stay apart."""
    return F.concat(host, F.lit("/"), path)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row (page_id, url)."""
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = rules.where("host is not null and path is not null").select(
        F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict"
    )
    known = known.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))  # block sorts after allow
    depth = known.agg(F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(0))).scalar()
    hosts = known.groupBy("rule_host").agg(F.collect_set(F.char_length("rule_path")).alias("lengths"))
    hosts = _salted(_keyed(hosts, "host_digest", F.col("rule_host")).drop("rule_host"))
    paths = _salted(_keyed(known, "rule_digest", _pair(F.col("rule_host"), F.col("rule_path"))))

    labels = F.size(F.split("host", r"\."))
    deep = F.filter(F.sequence(F.lit(1), F.greatest(F.least(labels, F.col("depth")), F.lit(1))), lambda k: k <= F.col("depth"))
    suffixes = urls.withColumn("depth", depth).withColumn("k", F.explode(deep)).withColumn("suffix", F.expr("substring_index(host, '.', -k)"))
    salt = F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")
    asked = _keyed(suffixes.withColumn("salt", salt), "asked", F.col("suffix"))
    listed = asked.join(hosts, ["short", "salt"]).where("asked = host_digest")
    fitting = listed.withColumn("length", F.explode("lengths")).where("length <= char_length(path)")
    fitting = fitting.select("page_id", "host", "path", "suffix", "salt", F.expr("left(path, length)").alias("prefix"))
    asked = _keyed(fitting, "asked", _pair(F.col("suffix"), F.col("prefix")))
    order = F.struct(
        F.char_length(F.concat("rule_host", "rule_path")).alias("length"),
        F.char_length("rule_host").alias("host_length"),
        "verdict",
        F.concat("rule_host", "rule_path").alias("rule"),
    )
    found = asked.join(paths, ["short", "salt"]).where("asked = rule_digest").select("page_id", "host", "path", F.lit(0).alias("n"), order.alias("best"))
    # every url itself counts once, what fits it only brings a rule
    rows = urls.withColumn("n", F.lit(1)).withColumn("best", F.lit(None).cast(found.schema["best"].dataType)).unionByName(found)
    whole = rows.groupBy("page_id", "host", "path").agg(F.sum("n").alias("n"), F.max("best").alias("best"))
    each = whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return each.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
