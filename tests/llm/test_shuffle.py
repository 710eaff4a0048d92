"""Operator 8: exact sizes, gapless slots and the law of its draws."""

import zlib
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlog.llm import shuffle


def check(rows, docs, shards):
    source = sorted((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == source
    slots = {}
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1


@pytest.mark.parametrize("shards", [3, 40])
@pytest.mark.parametrize("parts", [1, 5, 8])
def test_edge_cases(docs, shards, parts):
    check(shuffle.shuffle(docs, shards=shards, parts=parts).collect(), docs, shards)


def test_many_rows_and_determinism(spark):
    docs = spark.range(5_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = shuffle.shuffle(docs, shards=7, parts=11).collect()
    check(rows, docs, 7)
    place = {r.doc_id: (r.shard, r.slot) for r in rows}
    again = shuffle.shuffle(docs.repartition(3), shards=7, parts=11).collect()
    assert place == {r.doc_id: (r.shard, r.slot) for r in again}
    # neighbours do not stay together
    same = sum(place[i][0] == place[i + 1][0] for i in range(4_999))
    assert 550 < same < 900


def test_repeated_rows_part(spark):
    """Ten thousand rows alike go to all shards alike, among others, and never stay together."""
    docs = spark.range(12_000).select(F.when(F.col("id") < 10_000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    rows = shuffle.shuffle(docs, parts=16).collect()
    check(rows, docs, 40)
    twins = np.bincount([r.shard for r in rows if r.doc_id == 7], minlength=40)
    assert twins.sum() == 10_000 and 200 < twins.min() and twins.max() < 300


def test_no_rows(no_docs):
    assert shuffle.shuffle(no_docs).count() == 0


def test_matrix_has_the_exact_sums(spark):
    sizes = [0, 17, 400, 3, 1, 90, 12]
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(sizes) if n], "part int, n long")
    rows = {r.part: r.row for r in shuffle.communication_matrix(frame, len(sizes), 6).collect()}
    assert [sum(rows[i]) for i in range(len(sizes))] == sizes
    columns = np.array([rows[i] for i in range(len(sizes))]).sum(axis=0)
    assert columns.max() - columns.min() <= 1 and (np.array(list(rows.values())) >= 0).all()


@pytest.mark.parametrize(("whole", "marked", "drawn"), [(50, 20, 12), (30, 25, 20), (1000, 300, 40)])
def test_draws_follow_the_hypergeometric_law(spark, whole, marked, drawn):
    n = 20_000
    long = lambda x: F.lit(x).cast("long")
    u = (F.col("id") + 0.5) / n
    draw = shuffle.hypergeometric(long(whole), long(marked), long(drawn), u)
    found = {r.k: r["count"] for r in spark.range(n).select(draw.alias("k")).groupBy("k").count().collect()}
    for k in range(drawn + 1):
        exact = comb(marked, k) * comb(whole - marked, drawn - k) / comb(whole, drawn) if k <= marked else 0
        assert abs(found.get(k, 0) / n - exact) < 2e-4


def test_native():
    import inspect

    source = inspect.getsource(shuffle)
    assert not any(word in source for word in ("mapIn", "udf", "applyIn", ".rdd", "pandas"))
