"""Operator 13 against a plain loop over the rules; the plan has no Python in it."""

import re

from wardlog.llm import urlrules
from wardlog.llm.catalog import op13_url_rules

FOLDER = "/root/testdata/sf0.001"


def plain_verdict(url, rules, default="allow"):
    _, found, rest = (url or "").partition("://")
    host = re.split("[/?#]", rest)[0] if found else ""
    path = re.split("[?#]", rest[len(host) :])[0] if found else ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h + p), len(h), v, h + p)
        for h, p, v in rules
        if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, default, None))
    return host, path, best[3], best[2]


def judged(frame):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in frame.collect()), key=repr)


def wanted(rows, rules):
    return sorted(((i, *plain_verdict(u, rules)) for i, u in rows), key=repr)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url").collect()]
    got = op13_url_rules(spark, FOLDER)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert judged(got) == wanted(rows, urlrules.RULES)


def edge_urls():
    return [
        (1, "http://a.example.org/en/1"),
        (1, "http://a.example.org/en/1"),  # a row twice
        (1, "https://EXAMPLE.org/en/19/x?y=://"),
        (2, "http://notexample.org/en/1"),
        (3, "http://org/"),
        (4, "http://org"),
        (5, "http://example.org:80/es/"),
        (6, "ftp://x.com/de/a?b#c"),
        (6, "x://y.com/fr/#z"),
        (7, None),
        (None, None),
        (None, "no scheme com/de/"),
        (8, ""),
        (9, "http:///de/"),
        (10, "http://a\nb.com/de/\n"),
        (11, "http://" + "a." * 5_000 + "com/de/" + "x" * 50_000),
        (12, "http://ÄÖ.org/é/1"),
        (13, "http://.com/de/"),
        (14, "a://b://c.com/de/"),
    ]


def test_edge_cases(spark):
    frame = spark.createDataFrame(edge_urls(), "page_id long, url string").repartition(3)
    frame = frame.selectExpr("*", "'clash' AS host", "1 AS path", "'x' AS rule", "0 AS n", "'s' AS salt", "array(1) AS best")
    assert judged(urlrules.judge(frame, urlrules.rule_table(spark))) == wanted(edge_urls(), urlrules.RULES)
    assert urlrules.judge(frame.limit(0), urlrules.rule_table(spark)).count() == 0


def test_precedence_and_odd_rules(spark):
    rules = [
        ("b.c", "/", "allow"),
        ("c", "/x/", "block"),  # as long as b.c/
        ("c", "/", "block"),
        ("c", "/", "allow"),  # the same rule twice: block
        ("C", "/yy", "allow"),
        (None, "/", "block"),
        ("c", None, "block"),
        ("d", "", "block"),
        ("", "/", "block"),
        ("it's\\", "/", "block"),
    ]
    urls = [(k, u) for k, u in enumerate(["h://b.c/x/", "h://c/x/1", "h://c/q", "h://a.b.c/yyy", "h://d", "h://e.d?x", "h:///p", "h://it's\\/"])]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    frame = spark.createDataFrame(urls, "page_id long, url string")
    plain = [(h if h is None else h.lower(), p, v) for h, p, v in rules]
    assert judged(urlrules.judge(frame, table, "block")) == sorted(((i, *plain_verdict(u, plain, "block")) for i, u in urls), key=repr)
    none = urlrules.judge(frame, table.limit(0))
    assert judged(none) == wanted(urls, [])
    quoted = urlrules.rule_table(spark, (("it's\\", "/", "block"),)).first()
    assert tuple(quoted) == ("it's\\", "/", "block")


def test_plan_is_native(spark):
    plan = op13_url_rules(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop|ExistingRDD", plan)
