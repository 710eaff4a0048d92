"""Column functions against literal cases and against the standard library."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from wardlog.functions import addresses, paths, text, times
from wardlog.operators.networks import covering, excluded_prefix_anti_join, holds_for, literal_prefixes


def column(spark, values, build):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", build(F.col("x")).alias("y"))
    return [r.y for r in sorted(rows.collect(), key=lambda r: r.i)]


def plain_ip(value):
    if "%" in value:
        return None
    try:
        found = ipaddress.ip_address(value)
    except ValueError:
        return None
    if found.is_unspecified:
        return None
    return found.ipv4_mapped or found if found.version == 6 else found


def test_addresses_agree_with_the_standard_library(spark):
    random.seed(7)
    cases = [
        "11.0.0.7", "::ffff:11.0.0.7", "2a01:4f8:1:2:ffff:ffff::", "fe80::1%eth0", "::", "0.0.0.0", "01.2.3.4", "1.2.3",
        "2001:0DB8::1", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", "64:ff9b::1.2.3.4",
        "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "1:0:0:2:0:0:3:4", "g::1", "12345::1", "::1.2.3.04", "1.2.3.4\n", "",
    ]
    for _ in range(400):
        groups = [random.choice([0, 0, 0, 1, 16, 0xABCD, random.getrandbits(16)]) for _ in range(8)]
        cases.append(random.choice([":".join(f"{g:04x}" for g in groups), ":".join(f"{g:X}" for g in groups)]))
    got = column(spark, cases, addresses.ip_columns)
    texts = column(spark, cases, addresses.canonical_ip)
    for case, parsed, shown in zip(cases, got, texts):
        want = plain_ip(case)
        if want is None:
            assert parsed is None and shown is None, case
        else:
            assert parsed.addr == want.packed and parsed.text == shown, case
            assert ipaddress.ip_address(shown) == want and shown == shown.lower(), case


@pytest.fixture(params=["UTC", "America/New_York", "Asia/Kathmandu"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def test_times_do_not_depend_on_the_session_zone(spark, zone):
    cases = {
        "2026-09-10T19:01:02Z": (1789066862, "2026-09-10T19:01:02Z"),
        "2026-03-08T02:30:00.25Z": (1772937000, "2026-03-08T02:30:00.25Z"),  # an hour New York skips
        "2026-11-01T01:30:00-04:00": (1793511000, "2026-11-01T05:30:00Z"),
        "2024-12-31T23:59:59+05:45": (1735668899, "2024-12-31T18:14:59Z"),
        "2024-02-30T00:00:00Z": None,
    }
    rows = column(spark, list(cases), times.parse_rfc3339)
    seconds = column(spark, list(cases), lambda c: F.unix_seconds(times.parse_rfc3339(c)["ts"]))
    texts = column(spark, list(cases), lambda c: times.utc_text(times.parse_rfc3339(c)["ts"]))
    for row, second, text, want in zip(rows, seconds, texts, cases.values()):
        assert (row is None and second is None and text is None) if want is None else (second, text) == want and row.text == want[1]


def test_periods_do_not_depend_on_the_session_zone(spark, zone):
    at = lambda c: times.parse_rfc3339(c)["ts"]
    stamp = "2024-02-29T23:30:00Z"
    wanted = {
        "hourly": ("2024-02-29T23:00:00Z", "2024-02-29T23:00:00Z", "2024-03-01T00:00:00Z"),
        "daily": ("2024-02-29", "2024-02-29T00:00:00Z", "2024-03-01T00:00:00Z"),
        "monthly": ("2024-02", "2024-02-01T00:00:00Z", "2024-03-01T00:00:00Z"),
        "yearly": ("2024", "2024-01-01T00:00:00Z", "2025-01-01T00:00:00Z"),
    }
    for name, (label, start, end) in wanted.items():
        kind = F.lit(name)
        assert column(spark, [stamp], lambda c: times.period_label(kind, times.period_start(name, at(c)))) == [label]
        bounds = lambda c: times.period_bounds(kind, c)
        assert column(spark, [label], lambda c: times.utc_text(bounds(c)["start"])) == [start]
        assert column(spark, [label], lambda c: times.utc_text(bounds(c)["end"])) == [end]
        assert column(spark, ["x", "2024-02-31T00"], bounds) == [(None, None)] * 2
    assert [str(d) for d in column(spark, [stamp], lambda c: times.utc_date(at(c)))] == ["2024-02-29"]


def test_deny_keys(spark):
    cases = {
        "11.0.0.7": "11.0.0.7/32",
        "::ffff:11.0.0.7": "11.0.0.7/32",
        "2a01:4f8:1:2:aaaa::1": "2a01:4f8:1:2::/64",
        "2a01:4f8:1:2:ffff:ffff::": "2a01:4f8:1:2::/64",
    }
    assert column(spark, list(cases), addresses.deny_key) == list(cases.values())


def test_cidrs(spark):
    cases = {
        "1.1.1.7/24": "1.1.1.0/24",
        "::ffff:8.8.8.8/128": "8.8.8.8/32",
        "2001:db8::ffff/127": "2001:db8::fffe/127",
        "::/0": "::/0",
        "1.1.1.1": None,
        "1.1.1.1/33": None,
        "1.1.1.1/032": None,
        "fe80::%1/64": None,
    }
    got = column(spark, list(cases), lambda c: addresses.cidr_columns(c)["prefix"])
    assert got == list(cases.values())


def test_exclusions(spark):
    keys = [
        "10.1.2.3/32", "100.64.0.1/32", "192.0.2.1/32", "203.0.113.9/32", "127.0.0.1/32", "fe80::/64", "fd00::/64",
        "2001:db8::/64", "::/64", "11.0.0.1/32", "1.1.1.1/32", "2a01:4f8:1:2::/64", "2a01:4f8:9:9::/64",
    ]
    never = spark.createDataFrame([("1.1.1.1/32",), ("2a01:4f8:9:9::5/128",)], "c string").select(
        addresses.cidr_columns(F.col("c")).alias("p")
    ).select("p.*")
    kept = excluded_prefix_anti_join(spark.createDataFrame([(k,) for k in keys], "key string"), never)
    assert sorted(r.key for r in kept.collect()) == ["11.0.0.1/32", "2a01:4f8:1:2::/64"]


def test_literal_and_joined_containment_agree(spark):
    from wardlog.operators import networks

    random.seed(3)
    ips = [f"11.{random.randint(0, 9)}.{random.randint(0, 255)}.{random.randint(0, 255)}" for _ in range(300)]
    ips += [f"2a01:4f8:{random.randint(0, 9)}::{random.randint(1, 99)}" for _ in range(300)] + ["11.9.0.1", "ffff::1"]
    sets = [
        ["11.3.0.0/16", "11.4.128.0/17", "11.9.0.1/32", "2a01:4f8:2::/48", "2a01:4f8:3::10/124"],
        # every length, nested and repeated ones, and the ends of the range of addresses
        [f"{ips[i]}/{i + 1}" for i in range(24, 32)] + [f"{ips[400 + i]}/{i + 1}" for i in range(40, 128)],
        ["11.0.0.0/9", "11.0.0.0/31", "8000::/1"],
        ["::/0"],
        ["0.0.0.0/0"],
    ]
    rows = spark.createDataFrame([(i,) for i in [*ips, "no address"]], "ip string")
    address = addresses.ip_number(F.col("ip"))
    for texts in sets:
        nets = [ipaddress.ip_network(c, strict=False) for c in texts]
        want = [i for i in ips if not any(ipaddress.ip_address(i) in n for n in nets)] + ["no address"]
        literal = rows.where(~holds_for(address, covering(literal_prefixes(map(str, nets)))))
        table = spark.createDataFrame([(c,) for c in [*texts, *texts]], "c string").select(addresses.cidr_columns(F.col("c")).alias("p")).select("p.*")
        assert sorted(r.ip for r in literal.collect()) == sorted(want)
        assert sorted(r.ip for r in networks.cidr_anti_join(rows, address, table).collect()) == sorted(want)



def test_times(spark):
    cases = {
        "2026-09-10T21:01:02+02:00": "2026-09-10T19:01:02Z",
        "2026-09-10T19:01:02.123456789Z": "2026-09-10T19:01:02.123456789Z",
        "2026-09-10T19:01:02.1200Z": "2026-09-10T19:01:02.12Z",
        "2026-02-30T00:00:00Z": None,
        "2026-09-10": None,
        "2026-09-10T19:01:60Z": None,
        "2026-09-10T00:30:00-05:30": "2026-09-10T06:00:00Z",
    }
    assert column(spark, list(cases), times.utc_timestamp) == list(cases.values())
    strict = column(spark, list(cases), lambda c: times.strict_utc(c).isNotNull())
    assert strict == [False, True, True, False, False, False, False]


def test_percent_decoding(spark):
    cases = {"/a+b": "/a+b", "%2e%2E": "..", "%zz": None, "%2": None, "%": None, "%+1": None, "%252e": "%2e"}
    assert column(spark, list(cases), paths.percent_decode) == list(cases.values())


def test_text_bounds_count_bytes(spark):
    cases = ["é" * 128, "é" * 129, "", "a\tb", "a\x7fb", "ok"]
    got = column(spark, cases, lambda c: text.bounded_text(c, 256))
    assert got == [True, False, False, False, False, True]


def test_period_bounds(spark):
    cases = [("hourly", "2026-02-28T23:00:00Z"), ("daily", "2026-02-28"), ("monthly", "2026-02"), ("yearly", "2026"), ("daily", "x")]
    rows = spark.createDataFrame(cases, "g string, l string")
    ends = [str(r.b.end) for r in rows.select(times.period_bounds(F.col("g"), F.col("l")).alias("b")).collect()]
    assert ends == ["2026-03-01 00:00:00", "2026-03-01 00:00:00", "2026-03-01 00:00:00", "2027-01-01 00:00:00", "None"]
