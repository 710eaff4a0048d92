"""Log parsers with literal lines."""

import json

import pytest
from pyspark.sql import functions as F

from wardlog.sources import lines


def parse(spark, parser, *docs):
    rows = [(d if isinstance(d, str) else json.dumps(d), f"pos={i}") for i, d in enumerate(docs)]
    out = parser(spark.createDataFrame(rows, "value string, cursor string"))
    return out.collect()


ACCESS = {"time": "2026-09-10T21:01:02+02:00", "remote_addr": "2001:0db8::1", "request_uri": "/%252e?x=1", "status": 404}


def test_access_log(spark):
    row = parse(spark, lines.parse_access_log, ACCESS)[0]
    assert (row.source_ip, row.observed_at, row.http.request_target) == ("2001:db8::1", "2026-09-10T19:01:02Z", "/%252e?x=1")
    assert row.reject_reason is None and row.event_id.startswith("nginx:")


@pytest.mark.parametrize(
    "change, reason",
    [
        ({"body": "x"}, "unknown_field"),
        ({"status": "404"}, "field_type"),
        ({"status": 404.5}, "field_type"),
        ({"request_uri": "", "request": ""}, "request_line"),
        ({"remote_addr": "nowhere"}, "source_ip"),
        ({"time": "yesterday"}, "observed_at"),
        ({"status": 99}, "status"),
        ({"request_uri": "/" + "a" * 2048}, "request_target"),
    ],
)
def test_access_log_rejects(spark, change, reason):
    assert parse(spark, lines.parse_access_log, {**ACCESS, **change})[0].reject_reason == reason


def test_access_log_falls_back_to_the_request_line(spark):
    row = parse(spark, lines.parse_access_log, {**ACCESS, "request_uri": "", "request": "GET /%2e%2e/x?y HTTP/1.1"})[0]
    assert row.http.request_target == "/%2e%2e/x?y"


def test_lines_must_be_one_object(spark):
    good = json.dumps(ACCESS)
    bad = [good + " true", good + good, "[1]", "{", "x" * 70_000, "null", good[:-1] + ',"x":1},{"y":2}']
    reasons = [r.reject_reason for r in parse(spark, lines.parse_access_log, *bad)]
    assert None not in reasons and "line_size" in reasons


def test_honeypot_log(spark):
    attempt = {"eventid": "cowrie.login.failed", "timestamp": "2025-02-03T04:05:06.7Z", "src_ip": "11.22.33.44"}
    rows = parse(
        spark,
        lines.parse_honeypot_log,
        {**attempt, "username": "backup", "password": "hunter2", "sensor": "pot-7"},
        {**attempt, "username": "backup", "password": "ä" * 129},
        {**attempt, "username": "backup"},
        {**attempt, "eventid": "cowrie.command.input", "username": "backup"},
        {**attempt, "password": "no name"},
        {**attempt, "username": "backup", "src_ip": "11.22.33"},
        {**attempt, "username": ["backup"]},
    )
    good = [r for r in rows if r.reject_reason is None]
    assert [(r.ssh.username, r.ssh.password, r.observed_at) for r in good] == [
        ("backup", p, "2025-02-03T04:05:06.7Z") for p in ("hunter2", None, None)
    ]
    assert sorted(r.reject_reason for r in rows if r.reject_reason) == ["field_type", "source_ip", "username"]


POSITION = "s=00ff;i=7a;b=b0b0;m=1;t=2;x=3"


def journal(message, cursor=POSITION, at="1738555506700000"):
    return {"__CURSOR": cursor, "__REALTIME_TIMESTAMP": at, "MESSAGE": message, "PRIORITY": "6"}


@pytest.mark.parametrize(
    "message, username, address",
    [
        ("Failed password for deploy from 11.22.33.44 port 50001 ssh2", "deploy", "11.22.33.44"),
        ("Failed keyboard-interactive/pam for invalid user o'neil from 2a01:4f8:aa::9 port 1 ssh2", "o'neil", "2a01:4f8:aa::9"),
        ("Failed password for invalid user a from b port 1 ssh2 from 11.22.33.44 port 2 ssh2", "a from b port 1 ssh2", "11.22.33.44"),
        ("Failed publickey for git from ::ffff:11.22.33.44 port 9 ssh2: RSA SHA256:q83vEjRWeJCrze8SNFZ4", "git", "11.22.33.44"),
        ("Failed none for git from 11.22.33.44 port 9 ssh2", None, None),
    ],
)
def test_ssh_journal(spark, message, username, address):
    found = parse(spark, lines.parse_ssh_journal, journal(message))
    if username is None:
        assert found == []
        return
    assert [(r.ssh.username, r.source_ip, r.observed_at) for r in found] == [(username, address, "2025-02-03T04:05:06.7Z")]
    assert found[0].cursor == POSITION and found[0].reject_reason is None


def test_ssh_journal_skips_and_rejects(spark):
    failed = "Failed password for deploy from 11.22.33.44 port 50001 ssh2"
    skipped = ("Accepted" + failed[6:], "x " + failed, failed + " (later)", failed + "\n", failed + ": RSA-CERT SHA256:aa ID y (serial 2) CA RSA SHA256:bb")
    rows = parse(
        spark,
        lines.parse_ssh_journal,
        *(journal(text) for text in skipped),
        journal(failed, cursor=""),
        journal(failed, cursor="i=1;" + "s" * 40),
        journal(failed, at="soon"),
        journal(failed, at="17385555067000001738555506"),
    )
    assert sorted(r.reject_reason for r in rows) == ["journal_cursor", "journal_cursor", "journal_time", "journal_time"]


def test_registry_of_parsers_and_rejects(spark):
    table = spark.createDataFrame([(json.dumps(ACCESS), "a"), ("{", "b")], "value string, cursor string")
    good, bad = lines.split_rejects(lines.parse_logs({"nginx": table}))
    assert [r.adapter_id for r in good.collect()] == ["nginx"]
    assert [tuple(r) for r in bad.collect()] == [("b", "line_json")] and "line" not in bad.columns
    with pytest.raises(ValueError):
        lines.parse_logs({"other": table})


def test_files_of_two_folders_may_share_a_name(spark):
    table = spark.createDataFrame([("a", "host1/access.log"), ("a", "host2/access.log")], "value string, file string")
    assert len({r.cursor for r in lines.line_cursors(table).collect()}) == 2


def test_paths_below_the_root(spark):
    cases = [
        ("file:///logs/host1/a%20b.log", "/logs", "host1/a%20b.log"), ("file:/logs/x.log", "file:///logs/", "x.log"),
        ("hdfs://node:9/logs/x.log", "hdfs://node:9/logs", "x.log"), ("file:///other/x.log", "/logs", "/other/x.log"),
        ("file:///my%20logs/x.log", "/my logs", "x.log"), ("file:///logs2/x.log", "/logs", "/logs2/x.log"),
    ]
    for file, root, want in cases:
        row = spark.createDataFrame([(file,)], "file string").select(lines.relative_path(F.col("file"), root).alias("p")).first()
        assert row.p == want


def test_equal_lines_get_distinct_stable_cursors(spark):
    table = spark.createDataFrame([("a", "/x/f1"), ("a", "/x/f1"), ("a", "/x/f2"), ("b", "/x/f1")], "value string, file string")
    first = sorted(r.cursor for r in lines.line_cursors(table).collect())
    assert len(set(first)) == 4
    assert first == sorted(r.cursor for r in lines.line_cursors(table.repartition(5)).collect())
