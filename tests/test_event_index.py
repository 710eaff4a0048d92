"""The index of stored ids: what it opens, and that it changes no result."""

import pytest
from pyspark.sql import functions as F

from wardlog.sinks import event_index


def batch(spark, ids, content="a"):
    frame = spark.createDataFrame([(f"id-{i}",) for i in ids], "event_id string")
    return frame.withColumn("event_hash", F.sha2(F.concat("event_id", F.lit(content)), 256))


def opened(frame):
    """(bucket, commit) folders whose files a result reads."""
    parts = [f.split("/ids/")[1].split("/") for f in frame.inputFiles() if "/ids/" in f]
    return {(int(p[0].removeprefix("bucket=")), p[1].removeprefix("commit=")) for p in parts}


def bucket(spark, i):
    return batch(spark, [i]).select(event_index.bucket_of(F.col("event_id"))).first()[0]


@pytest.fixture()
def root(spark, tmp_path):
    root = str(tmp_path / "index")
    event_index.append(batch(spark, range(2_000)), root, "one")
    event_index.append(batch(spark, range(2_000, 2_400)), root, "two")
    return root


def test_a_batch_opens_only_the_folders_it_touches(spark, root):
    found = event_index.known(batch(spark, [5, 2_100, 9_001]), root)
    assert opened(found) == {(bucket(spark, 5), "one"), (bucket(spark, 2_100), "two")}
    assert {r.event_id for r in found.collect()} == {"id-5", "id-2100"}
    news = event_index.known(batch(spark, range(50_000, 51_000)), root)
    assert len(opened(news)) <= 1 and news.isEmpty()  # all buckets asked, nothing opened but by a chance mark
    assert event_index.known(batch(spark, []), root).isEmpty()


def test_results_equal_a_scan(spark, root):
    asked = batch(spark, range(1_900, 2_600), "b")
    stored = batch(spark, range(2_400))
    wanted = sorted(map(tuple, stored.join(asked.select("event_id"), "event_id", "left_semi").collect()))
    assert sorted(map(tuple, event_index.known(asked, root).collect())) == wanted
    event_index.compact(spark, root)
    found = event_index.known(asked, root)
    assert sorted(map(tuple, found.collect())) == wanted
    assert {c for _, c in opened(found)} == {event_index.FOLDED}
    # a commit does not see itself, folded or not
    assert {r.event_id for r in event_index.known(asked, root, "two").collect()} == {f"id-{i}" for i in range(1_900, 2_000)}
    event_index.append(batch(spark, [3_000]), root, "three")
    event_index.append(batch(spark, [3_000]), root, "three")
    assert event_index.known(batch(spark, [3_000]), root).count() == 1
    assert event_index.known(batch(spark, [3_000]), root, "three").isEmpty()


def test_buckets_grow_with_the_index(spark, root, monkeypatch):
    monkeypatch.setattr(event_index, "BUCKET_IDS", 100)
    event_index.compact(spark, root)
    assert event_index._generation(spark, root) == (1, 32)
    event_index.append(batch(spark, [3_000]), root, "three")
    found = event_index.known(batch(spark, [5, 3_000]), root)
    assert {r.event_id for r in found.collect()} == {"id-5", "id-3000"}
    assert {c for _, c in opened(found)} == {event_index.FOLDED, "three"}


def test_a_compaction_or_append_that_died_changes_nothing(spark, root, monkeypatch):
    real = event_index._point
    monkeypatch.setattr(event_index, "_point", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        event_index.compact(spark, root)
    monkeypatch.setattr(event_index, "_point", real)
    asked = batch(spark, [1, 2_001])
    assert event_index.known(asked, root).count() == 2
    event_index.compact(spark, root)  # writes over what the first left
    assert event_index.known(asked, root).count() == 2
    # marks without ids open nothing
    marks = batch(spark, [7_000]).select(
        event_index.mark_of(F.col("event_id")).alias("mark"), event_index.bucket_of(F.col("event_id")).alias("bucket"), F.lit("dead").alias("commit")
    )
    marks.write.mode("append").partitionBy("bucket", "commit").parquet(f"{root}/gen=1/marks")
    assert event_index.known(batch(spark, [7_000]), root).isEmpty()
