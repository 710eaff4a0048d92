"""Lists in parts: order over parts, index, the file they make up."""

import json

from pyspark.sql import functions as F

from wardlog import schemas
from wardlog.sinks.documents import publish_array, publish_lines, read_index, write_manifest, write_rollups


def test_parts_in_order_make_up_the_document(spark, tmp_path):
    path = tmp_path / "lists" / "recent.txt"
    order = F.struct((F.col("id") % 7).cast("int").alias("section"), F.col("id").alias("at"))
    lines = spark.range(20_000).repartition(6).select(order.alias("ord"), F.concat(F.lit("line "), "id").alias("line"))
    want = [f"line {i}" for i in sorted(range(20_000), key=lambda i: (i % 7, i))]
    # small parts, so that there are several
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        publish_lines(lines, str(path))
        first = read_index(spark, str(path))
        publish_lines(lines, str(path), single_file=False)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert path.read_text().splitlines() == want
    for parts in (first, read_index(spark, str(path))):
        texts = [(tmp_path / "lists/parts/recent.txt" / p["name"]).read_bytes() for p in parts]
        assert len(parts) >= 5 and [len(t) for t in texts] == [p["bytes"] for p in parts]
        assert b"".join(texts).decode().splitlines() == want
    assert first != read_index(spark, str(path))
    # The third makes the first superfluous.
    publish_lines(lines.where("id < 10"), str(path))
    versions = {p.name for p in (tmp_path / "lists/parts/recent.txt").iterdir()}
    assert len(versions) == 2 and first[0]["name"].split("/")[0] not in versions
    assert path.read_text().splitlines() == [f"line {i}" for i in (0, 7, 1, 8, 2, 9, 3, 4, 5, 6)]
    assert set(json.loads((tmp_path / "lists/parts/recent.txt.index").read_text())) == {"parts"}
    assert not [p for p in (tmp_path / "lists").rglob("*") if "staging" in p.name]


def test_empty_list(spark, tmp_path):
    lines = spark.createDataFrame([], "ord int, line string")
    publish_lines(lines, str(tmp_path / "x.txt"))
    assert (tmp_path / "x.txt").read_text() == "" and read_index(spark, str(tmp_path / "x.txt")) == []


def test_a_json_document_in_parts(spark, tmp_path):
    path = tmp_path / "docs" / "m.json"
    items = spark.range(5_000).repartition(6).selectExpr("id AS ord", """concat('{"id":', id, ',"t":"a,}"}') AS text""")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        publish_array(items, str(path), '{"head":1,"items":[', "]}\n", "}")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    index = read_index(spark, str(path))
    assert len(index) >= 7 and index[0]["name"].endswith("/head") and index[-1]["name"].endswith("/tail")
    want = json.dumps({"head": 1, "items": [{"id": i, "t": "a,}"} for i in range(5_000)]}, separators=(",", ":")) + "\n"
    assert path.read_text() == want
    assert b"".join((tmp_path / "docs/parts/m.json" / p["name"]).read_bytes() for p in index).decode() == want
    publish_array(items.limit(0), str(path), '{"items":[', "]}\n", "}")
    assert path.read_text() == '{"items":[]}\n'


def test_manifest_lists_each_object_once_in_byte_order(spark, tmp_path):
    rows = [("b", "accepted"), ("a\"\\é", "replay"), ("a", "sequence_gap"), ("Z", "replay"), ("b", "replay")]
    write_manifest(spark.createDataFrame(rows, "blob_name string, status string"), str(tmp_path / "m.json"))
    text = (tmp_path / "m.json").read_text()
    assert text.startswith('{"schema_version":"wardlog.accepted-manifest/v1","blobs":["Z",')
    assert json.loads(text)["blobs"] == ["Z", 'a"\\é', "b"]


def test_rollup_documents_hold_all_periods_in_order(spark, tmp_path):
    hours = spark.range(300).selectExpr("'hourly' AS granularity", "timestamp_seconds(1780000000 - 1780000000 % 3600 + 3600 * id) AS period_start", "id + 1 AS total")
    totals = spark.createDataFrame(hours.collect(), schemas.PERIOD_TOTALS).repartition(5)
    counts = hours.selectExpr("granularity", "period_start", "'paths' AS dimension", "'/<a>' AS value", "total AS count")
    heads = spark.createDataFrame([], "source_id string, source_epoch string, kind string")
    write_rollups(totals, counts, heads, "2026-09-10T20:00:00Z", str(tmp_path))
    text = (tmp_path / "hourly.json").read_text()
    document = json.loads(text)
    assert [p["total"] for p in document["periods"]] == list(range(1, 301)) and "\\u003ca\\u003e" in text
    assert list(document) == ["schema_version", "label", "granularity", "updated_at", "periods"]
    assert json.dumps(document, separators=(",", ":")).replace("<", "\\u003c").replace(">", "\\u003e") + "\n" == text
    assert json.loads((tmp_path / "yearly.json").read_text())["periods"] == []
