"""IP addresses and prefixes as native column expressions.

An address is STRUCT<text, family, hi, lo, addr>: canonical text, 4 or 6, the
bits left-aligned in two BIGINTs (so one mask formula serves both families)
and the big-endian bytes for numeric ordering. Nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlog.functions.binding import bind

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"\A{OCTET}(?:\.{OCTET}){{3}}\z"
FULL6 = r"\A[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}\z"
SHORT6 = r"\A(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?\z"
MAPPED = "0" * 20 + "ffff"
NUMBER_TYPE = "struct<family:int,hi:bigint,lo:bigint,addr:binary>"
ADDRESS_TYPE = "struct<text:string,family:int,hi:bigint,lo:bigint,addr:binary>"


def _ipv4_hex(text: Column) -> Column:
    octets = F.split(text, r"\.")
    return F.array_join(
        F.transform(octets, lambda o: F.lower(F.lpad(F.hex(o.cast("bigint")), 2, "0"))), ""
    )


def _ipv6_hex(col: Column) -> Column:
    """32 hex digits of an IPv6 text, or null. Accepts a dotted tail."""
    def undotted(text: Column) -> Column:
        return bind(
            F.regexp_extract(text, r":([0-9.]*\.[0-9.]*)\z", 1),
            lambda quad: F.when(quad == "", text).when(
                quad.rlike(IPV4),
                bind(
                    _ipv4_hex(quad),
                    lambda h: F.concat(
                        F.substring(text, F.lit(1), F.length(text) - F.length(quad)),
                        F.substring(h, 1, 4),
                        F.lit(":"),
                        F.substring(h, 5, 4),
                    ),
                ),
            ),
        )

    def expanded(text: Column) -> Column:
        groups = lambda side: F.when(side == "", F.array().cast("array<string>")).otherwise(
            F.split(side, ":")
        )
        padded = lambda side: F.transform(side, lambda g: F.lpad(g, 4, "0"))
        sides = F.struct(
            padded(groups(F.substring_index(text, "::", 1))).alias("left"),
            padded(groups(F.element_at(F.split(text, "::"), -1))).alias("right"),
        )

        def filled(s: Column) -> Column:
            missing = F.lit(8) - F.size(s["left"]) - F.size(s["right"])
            return F.when(
                missing >= 1,
                F.array_join(F.concat(s["left"], F.array_repeat(F.lit("0000"), missing), s["right"]), ""),
            )

        return F.when(text.rlike(FULL6), F.array_join(padded(F.split(text, ":")), "")).when(
            text.rlike(SHORT6), bind(sides, filled)
        )

    return bind(undotted(F.lower(col)), expanded)


def _half(digits: Column, start: int) -> Column:
    return F.conv(F.substring(digits, start, 16), 16, -10).cast("bigint")


def _ipv6_text(digits: Column) -> Column:
    """RFC 5952 text: the longest run of two or more zero groups, leftmost
    on a tie, becomes the double colon."""
    groups = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.regexp_replace(F.substring(digits, i * 4 + 1, F.lit(4)), r"\A0{1,3}", ""),
    )

    def squeezed(plain: Column) -> Column:
        text = None
        for run in range(8, 1, -1):
            pattern = rf"\A(.*?)(?:\A|:)0(?::0){{{run - 1}}}(?:\z|:)(.*)\z"
            done = F.regexp_replace(plain, pattern, "$1::$2")
            found = plain.rlike(rf"(?:\A|:)0(?::0){{{run - 1}}}(?:\z|:)")
            text = F.when(found, done) if text is None else text.when(found, done)
        return text.otherwise(plain)

    return bind(F.array_join(groups, ":"), squeezed)


def _ipv4_text(digits: Column) -> Column:
    octet = lambda i: F.conv(F.substring(digits, i, 2), 16, 10)
    return F.concat_ws(".", octet(1), octet(3), octet(5), octet(7))


def _struct(family: int, digits: Column, text: bool) -> Column:
    """Address struct from 8 or 32 hex digits."""
    if family == 4:
        hi, lo = F.shiftleft(F.conv(digits, 16, 10).cast("bigint"), 32), F.lit(0).cast("bigint")
        shown = _ipv4_text(digits)
    else:
        hi, lo, shown = _half(digits, 1), _half(digits, 17), _ipv6_text(digits)
    fields = [F.lit(family).alias("family"), hi.alias("hi"), lo.alias("lo"), F.unhex(digits).alias("addr")]
    return F.struct(*([shown.alias("text")] if text else []), *fields).cast(ADDRESS_TYPE if text else NUMBER_TYPE)


def _parse(col: Column, text: bool) -> Column:
    from_v6 = bind(
        bind(col, _ipv6_hex),
        lambda digits: F.when(digits == "0" * 32, F.lit(None))
        .when(
            digits.startswith(MAPPED),
            bind(F.substring(digits, 25, 8), lambda d: _struct(4, d, text)),
        )
        .when(digits.isNotNull(), _struct(6, digits, text)),
    )
    return F.when(
        col.rlike(IPV4),
        F.when(col != "0.0.0.0", bind(_ipv4_hex(col), lambda d: _struct(4, d, text))),
    ).when(F.contains(col, F.lit(":")), from_v6)


def ip_columns(col: Column) -> Column:
    """Parse an address and unmap v4-in-v6. Null when it does not parse, has a
    zone or is unspecified."""
    return _parse(col, text=True)


def ip_number(col: Column) -> Column:
    """:func:`ip_columns` without the text, which costs most of the work."""
    return _parse(col, text=False)


def canonical_ip(col: Column) -> Column:
    """Canonical text. IPv4 needs no rewriting, so it skips the full parse."""
    return F.when(col.rlike(IPV4), F.when(col != "0.0.0.0", col)).when(
        F.contains(col, F.lit(":")), ip_columns(col)["text"]
    )


def is_canonical_ip(col: Column) -> Column:
    """Specified, unmapped, zone-free and in canonical notation."""
    return F.coalesce((canonical_ip(col) == col) & (col != "0.0.0.0"), F.lit(False))


def _hex_of(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def mask_hi(hi: Column, bits: int) -> Column:
    """The first ``bits`` (at most 64) of the upper half. A JVM shift by 64
    is a shift by zero, hence the special cases."""
    if bits <= 0:
        return F.lit(0).cast("bigint")
    if bits >= 64:
        return hi
    return F.shiftleft(F.shiftrightunsigned(hi, 64 - bits), 64 - bits)


def mask_lo(lo: Column, bits: int) -> Column:
    return mask_hi(lo, bits - 64)


def _masked(value: Column, kept: Column) -> Column:
    drop = F.lit(64) - kept
    return (
        F.when(kept <= 0, F.lit(0).cast("bigint"))
        .when(kept >= 64, value)
        .otherwise(F.call_function("shiftleft", F.call_function("shiftrightunsigned", value, drop), drop))
    )


def cidr_columns(col: Column) -> Column:
    """STRUCT<prefix, family, hi, lo, bits> of a CIDR, masked; v4-in-v6 is
    rebased to IPv4. Null when it does not parse."""
    written = F.element_at(F.split(col, "/"), 1)
    length = F.regexp_extract(col, r"\A[^/%]+/(0|[1-9][0-9]{0,2})\z", 1).try_cast("int")

    def build(family, hi, lo, bits):
        masked = F.struct(
            F.lit(family).alias("family"),
            _masked(hi, bits).alias("hi"),
            _masked(lo, bits - 64).alias("lo"),
            bits.alias("bits"),
        )

        def named(m):
            digits = _hex_of(m["hi"], m["lo"])
            plain = (
                _ipv4_text(F.substring(digits, 1, 8)) if family == 4 else _ipv6_text(digits)
            )
            return F.struct(
                F.concat(plain, F.lit("/"), m["bits"].cast("string")).alias("prefix"),
                m["family"].alias("family"),
                m["hi"].alias("hi"),
                m["lo"].alias("lo"),
                m["bits"].alias("bits"),
            )

        return bind(masked, named)

    v4 = bind(
        _ipv4_hex(written),
        lambda d: build(4, F.shiftleft(F.conv(d, 16, 10).cast("bigint"), 32), F.lit(0).cast("bigint"), length),
    )
    v6 = bind(
        bind(written, _ipv6_hex),
        lambda d: F.when(
            d.startswith(MAPPED) & (length >= 96),
            build(
                4,
                F.shiftleft(F.conv(F.substring(d, 25, 8), 16, 10).cast("bigint"), 32),
                F.lit(0).cast("bigint"),
                length - 96,
            ),
        ).when(d.isNotNull(), build(6, _half(d, 1), _half(d, 17), length)),
    )
    return F.when(written.rlike(IPV4) & (length <= 32), v4).when(
        F.contains(written, F.lit(":")) & (length <= 128), v6
    )


def deny_key(col: Column) -> Column:
    """List key of a canonical address: IPv4 itself, IPv6 its /64."""
    v6 = bind(
        ip_number(col),
        lambda a: F.when(a["family"] == 4, F.concat(_ipv4_text(F.hex(a["addr"])), F.lit("/32"))).when(
            a["family"] == 6,
            F.concat(_ipv6_text(F.lower(F.concat(F.substring(F.hex(a["addr"]), 1, 16), F.lit("0" * 16)))), F.lit("/64")),
        ),
    )
    return F.when(col.rlike(IPV4), F.concat(col, F.lit("/32"))).when(F.contains(col, F.lit(":")), v6)
