"""Containment of addresses in CIDR sets, without range joins.

CIDRs given as texts in the rules become hash-set literals of masked prefixes,
one set per (family, length): a narrow, code-generated filter. A CIDR table of
any size is met by equality of prefixes of every fourth length.
"""

from __future__ import annotations

import ipaddress
from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.functions.addresses import ip_number, mask_hi, mask_lo

# Special-purpose ranges that are never listed. IPv6 outside
# 2000::/3 is excluded wholesale.
SPECIAL_PURPOSE = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "100.64.0.0/10",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.88.99.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "224.0.0.0/4",
    "240.0.0.0/4",
    "2001::/23",
    "2001:db8::/32",
    "2002::/16",
    "3fff::/20",
)
GLOBAL_UNICAST_6 = "2000::/3"


@dataclass(frozen=True)
class Prefix:
    family: int
    hi: int
    lo: int
    bits: int


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def literal_prefixes(cidrs: Iterable[str]) -> list[Prefix]:
    found = []
    for cidr in cidrs:
        network = ipaddress.ip_network(cidr)
        value = int(network.network_address) << (96 if network.version == 4 else 0)
        found.append(
            Prefix(network.version, _signed(value >> 64), _signed(value & (1 << 64) - 1), network.prefixlen)
        )
    return found


def covering(prefixes: Iterable[Prefix]) -> Callable[[Column], Column]:
    """Test of an address struct against a set of prefixes, one hash-set
    lookup per prefix length in use."""
    by_length: dict[tuple[int, int], list[Prefix]] = defaultdict(list)
    for prefix in prefixes:
        by_length[prefix.family, prefix.bits].append(prefix)

    def test(a: Column) -> Column:
        found = F.lit(False)
        for (family, bits), group in sorted(by_length.items()):
            hit = mask_hi(a["hi"], bits).isin([p.hi for p in group])
            if bits > 64:
                key = F.concat_ws(":", a["hi"], mask_lo(a["lo"], bits))
                hit = key.isin([f"{p.hi}:{p.lo}" for p in group])
            found = found | ((a["family"] == family) & hit)
        return found

    return test


def holds_for(address: Column, test: Callable[[Column], Column]) -> Column:
    """Apply a test to a parsed address, parsing it once; false when null."""
    return F.coalesce(F.exists(F.array(address), test), F.lit(False))


def contained(address: Column, prefixes: Iterable[Prefix]) -> Column:
    """True where the address struct lies in any of the prefixes."""
    return holds_for(address, covering(prefixes))


#: Prefixes are compared at every fourth length, so that one CIDR becomes at most 16 of them.
STEP = 4
#: Copies of prefixes this short, of which one may hold most addresses.
COPIES = 16


def _short(family: Column, bits: Column) -> Column:
    return bits <= F.when(family == 4, 16).otherwise(32)


def stepped_prefixes(cidrs: DataFrame) -> DataFrame:
    """Disjoint cover of a CIDR table (family, hi, lo, bits) by prefixes of
    stepped lengths, short ones once for each ``copy``."""
    steps = F.greatest(F.lit(STEP), (F.ceil(F.col("bits") / STEP) * STEP).cast("int"))
    last = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_to") - F.col("bits")) - 1
    rest = lambda end: F.call_function("shiftleft", F.col("_j"), F.lit(end) - F.col("_to"))
    cut = (
        cidrs.select("family", "hi", "lo", "bits")
        .withColumn("_to", steps)
        .withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .select(
            "family",
            F.when(F.col("_to") <= 64, F.col("hi").bitwiseOR(rest(64))).otherwise(F.col("hi")).alias("hi"),
            F.when(F.col("_to") > 64, F.col("lo").bitwiseOR(rest(128))).otherwise(F.col("lo")).alias("lo"),
            F.col("_to").alias("bits"),
        )
        .distinct()
    )
    copies = F.when(_short(F.col("family"), F.col("bits")), F.lit(COPIES)).otherwise(F.lit(1))
    return cut.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))


def _stepped_masks(address: str, longest: int) -> Column:
    """The prefixes of an address at every stepped length, as an array."""

    def masks(top: int) -> Column:
        return F.array(
            *[
                F.struct(
                    mask_hi(F.col(f"{address}.hi"), bits).alias("hi"),
                    mask_lo(F.col(f"{address}.lo"), bits).alias("lo"),
                    F.lit(bits).alias("bits"),
                )
                for bits in range(STEP, top + 1, STEP)
            ]
        )

    return F.when(F.col(f"{address}.family") == 4, masks(32)).otherwise(masks(longest))


def cidr_anti_join(rows: DataFrame, address: Column, cidrs: DataFrame, longest: int = 128, texts: list[str] | None = None) -> DataFrame:
    """Rows whose address struct lies in none of the CIDRs, of which none is
    longer than ``longest``. One plan for tables of any size: distinct addresses
    meet prefixes of equal stepped length by equality. A prefix that may hold
    most addresses is short and is there in copies, over which they are spread.
    With the columns ``texts`` that the address is made of, each text is parsed
    once and rows are met by text; else each row's address is parsed."""
    by = texts or ["_a"]
    keyed = rows.select(*texts).distinct().withColumn("_a", address) if texts else rows.withColumn("_a", address)
    copy = F.when(_short(F.col("family"), F.col("bits")), F.pmod(F.xxhash64("_a"), F.lit(COPIES))).otherwise(0)
    hits = (
        keyed.where(F.col("_a").isNotNull())
        .select(*dict.fromkeys([*by, "_a"]))
        .distinct()
        .withColumn("_m", F.explode(_stepped_masks("_a", longest)))
        .select(*dict.fromkeys([*by, "_a"]), F.col("_a.family").alias("family"), "_m.hi", "_m.lo", "_m.bits")
        .withColumn("copy", copy.cast("int"))
        .join(stepped_prefixes(cidrs), ["family", "hi", "lo", "bits", "copy"], "left_semi")
        .select(*by)
        .distinct()
    )
    return rows.join(hits, by, "left_anti").select(*rows.columns) if texts else keyed.join(hits, "_a", "left_anti").drop("_a")


def trusted_anti_join(observations: DataFrame, cidrs: Iterable[str], column: str = "source_ip") -> DataFrame:
    """Drop observations from trusted networks given in the rules."""
    prefixes = literal_prefixes(cidrs)
    if not prefixes:
        return observations
    return observations.where(~contained(ip_number(F.col(column)), prefixes))


def excluded_prefix_anti_join(keys: DataFrame, never: DataFrame | None = None, column: str = "key") -> DataFrame:
    """Drop list keys (a.b.c.d/32 or an IPv6 /64) that overlap a special-purpose
    range or a never-block CIDR. A CIDR longer than the key overlaps it when
    the key contains it, so such CIDRs are first cut to the key's length."""
    address = ip_number(F.substring_index(F.col(column), "/", 1))
    allowed = covering([Prefix(4, 0, 0, 0), *literal_prefixes([GLOBAL_UNICAST_6])])
    special = covering(literal_prefixes(SPECIAL_PURPOSE))
    if never is None:
        return keys.where(holds_for(address, lambda a: allowed(a) & ~special(a)))
    length = F.when(F.col("family") == 4, F.least("bits", F.lit(32))).otherwise(F.least("bits", F.lit(64)))
    clipped = never.select(
        "family",
        "hi",
        F.when(F.col("bits") > 64, F.lit(0).cast("bigint")).otherwise(F.col("lo")).alias("lo"),
        length.alias("bits"),
    )
    listed = keys.where(holds_for(address, lambda a: allowed(a) & ~special(a)))
    return cidr_anti_join(listed, address, clipped, longest=64, texts=[column])
