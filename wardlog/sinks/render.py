"""Deny lists and published documents as text.

Renderers return (ord, line) rows: every line of a document and a
sortable position, so a list of any length is written from parallel tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.config import LIMITS, NAMES, WireNames
from wardlog.functions.times import utc_stamp

ORDER_TYPE = "struct<section:int,family:int,addr:binary,tail:int>"


def _at(section: int, family: Column | None = None, addr: Column | None = None, tail: int = 0) -> Column:
    return F.struct(
        F.lit(section).alias("section"),
        (F.lit(0) if family is None else family).alias("family"),
        (F.lit(b"") if addr is None else addr).alias("addr"),
        F.lit(tail).alias("tail"),
    ).cast(ORDER_TYPE)


def _fixed(entries: DataFrame, lines: list[tuple[Column, Column]]) -> DataFrame:
    """Literal lines; one row source, independent of the entries."""
    rows = F.array(*[F.struct(order.alias("ord"), line.alias("line")) for order, line in lines])
    return entries.sparkSession.range(1).select(F.inline(rows))


def _header(name: str, now: Column, names: WireNames) -> list[Column]:
    return [
        F.lit(f"# {names.namespace} deny list: {name}"),
        F.lit(f"# {names.label}"),
        F.concat(F.lit("# generated "), utc_stamp(now)),
        F.lit(f"# {names.documentation_url}"),
    ]


def element(family: Column, key: Column) -> Column:
    """An IPv4 entry without its length, an IPv6 /64 with it."""
    return F.when(family == 4, F.substring_index(key, "/", 1)).otherwise(key)


def _entries(lists: DataFrame, name: str) -> DataFrame:
    return lists.where(F.col("list") == name).withColumn("element", element(F.col("family"), F.col("key")))


def render_text(lists: DataFrame, name: str, now: Column, names: WireNames = NAMES) -> DataFrame:
    entries = _entries(lists, name)
    head = [(_at(0, F.lit(i)), line) for i, line in enumerate(_header(name, now, names))]
    body = entries.select(_at(1, F.col("family"), F.col("addr")).alias("ord"), F.col("element").alias("line"))
    return _fixed(entries, head).unionByName(body)


def render_nft(lists: DataFrame, name: str, now: Column, names: WireNames = NAMES) -> DataFrame:
    """nftables script: declare both sets, then empty and refill them."""
    entries, ns = _entries(lists, name), names.namespace
    head = _header(name, now, names) + [
        F.lit(f"table inet {ns} {{"),
        F.lit(f"\tset {name}_v4 {{ type ipv4_addr; flags timeout; }}"),
        F.lit(f"\tset {name}_v6 {{ type ipv6_addr; flags interval, timeout; }}"),
        F.lit("}"),
        F.lit(f"flush set inet {ns} {name}_v4"),
        F.lit(f"flush set inet {ns} {name}_v6"),
    ]
    # The last entry of a family has no comma: its address is the maximum, one
    # row per family, joined instead of a window over the whole list.
    last = entries.groupBy("family").agg(F.max("addr").alias("_last"))
    suffix = F.when(F.col("family") == 4, "v4").otherwise("v6")
    body = entries.join(F.broadcast(last), "family").select(
        _at(1, F.col("family"), F.col("addr"), 1).alias("ord"),
        F.concat(
            F.lit("\t"),
            "element",
            F.lit(" timeout "),
            F.col("timeout_s").cast("string"),
            F.lit("s"),
            F.when(F.col("addr") == F.col("_last"), "").otherwise(","),
        ).alias("line"),
    )
    opening = last.select(
        _at(1, F.col("family"), None, 0).alias("ord"),
        F.concat(F.lit(f"add element inet {ns} {name}_"), suffix, F.lit(" {")).alias("line"),
    )
    closing = last.select(_at(1, F.col("family"), F.lit(b"\xff" * 17), 2).alias("ord"), F.lit("}").alias("line"))
    fixed = _fixed(entries, [(_at(0, F.lit(i)), line) for i, line in enumerate(head)])
    return fixed.unionByName(opening).unionByName(body).unionByName(closing)


def ipset_seconds(seconds: Column) -> Column:
    return F.least(seconds, F.lit(LIMITS.ipset_timeout_seconds).cast("bigint"))


def render_ipset(lists: DataFrame, name: str, window_s: int, now: Column, names: WireNames = NAMES) -> DataFrame:
    """Restore script: fill temporary sets and swap them in. Timeouts are
    capped at the kernel's maximum."""
    entries, ns = _entries(lists, name), names.namespace
    cap = min(window_s, LIMITS.ipset_timeout_seconds)
    lines = [(_at(0, F.lit(i)), line) for i, line in enumerate(_header(name, now, names))]
    for family, suffix, kind, net in ((4, "v4", "hash:ip", "inet"), (6, "v6", "hash:net", "inet6")):
        target = f"{ns}-{name}-{suffix}"
        options = f"{kind} family {net} timeout {cap}"
        before = [f"create {target} {options}", f"create {target}-new {options}", f"flush {target}-new"]
        after = [f"swap {target}-new {target}", f"destroy {target}-new"]
        at = F.lit(family)
        lines += [(_at(1, at, F.lit(b""), i), F.lit(text)) for i, text in enumerate(before)]
        lines += [(_at(1, at, F.lit(b"\xff" * 17), i), F.lit(text)) for i, text in enumerate(after)]
    body = entries.select(
        _at(1, F.col("family"), F.col("addr"), 9).alias("ord"),
        F.concat(
            F.lit(f"add {ns}-{name}-"),
            F.when(F.col("family") == 4, "v4").otherwise("v6"),
            F.lit("-new "),
            "element",
            F.lit(" timeout "),
            ipset_seconds(F.col("timeout_s")).cast("string"),
        ).alias("line"),
    )
    return _fixed(entries, lines).unionByName(body)


def document_text(lines: DataFrame) -> DataFrame:
    """One row ``text``. Only for lists under the evidence cap."""
    return lines.agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("_l")).select(
        F.concat(F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("text")
    )
