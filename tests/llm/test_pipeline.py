"""The pipeline stage by stage against brute force, and on edge cases."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_shingles import plain_groups

FOLDER = "/root/testdata/sf0.001"


def run_stages(spark, docs):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage_table(stage(spark, docs, FOLDER), name)
        out.append(docs)
    return out


def test_stages_on_small_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    clean, known, exact, near, packed = run_stages(spark, docs)
    for stage in (clean, known, exact, near):
        assert stage.schema.simpleString() == docs.schema.simpleString()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    good = labels.where("toxic = 0").join(docs, "doc_id", "left_semi").select("doc_id")
    # some eighty labelled rows teach little; the operator has its own held-out test
    assert clean.join(good, "doc_id", "left_semi").count() >= 0.85 * good.count()
    assert known.count() == sum(any(c.isalpha() for c in r.text or "") for r in clean.collect())
    best = {}
    for r in known.collect():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in exact.collect()) == sorted(best.values())
    items = sorted((r.doc_id, r.text) for r in exact.collect())
    first = set(plain_groups([t for _, t in items]).values())
    assert sorted(r.doc_id for r in near.collect()) == [items[k][0] for k in sorted(first)]
    lengths = {}
    for r in packed.collect():
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
        assert r.offset + r.length <= 4096
    assert lengths == {r.doc_id: r.doc_tokens for r in packed.collect()}
    assert set(lengths) == {r.doc_id for r in near.collect()}


@pytest.mark.parametrize("empty", [False, True])
def test_edge_cases(spark, docs, no_docs, empty):
    stages = run_stages(spark, no_docs if empty else docs)
    if empty:
        assert all(s.count() == 0 for s in stages)
        return
    assert all(s.columns == docs.columns for s in stages[:-1])
    kept = {r.doc_id for r in stages[3].collect()}
    assert {12, 15, 16} <= kept and not kept & {7, 8, 9, 10}


def test_columns_of_any_name_and_type_come_back(spark, docs):
    """Names that stages use for themselves, and a MAP column, which has no order."""
    clash = {c: F.lit("mine") for c in ("key_of_text", "fingerprint_of_text", "Key_Of_Text_", "in_source")}
    named = docs.withColumns(clash).withColumn("tags", F.create_map(F.lit("k"), F.col("doc_id")))
    exact = corpus_pipeline.drop_exact_copies(spark, named, FOLDER)
    near = corpus_pipeline.drop_near_copies(spark, exact, FOLDER)
    assert near.schema.simpleString() == named.schema.simpleString()
    rows = near.collect()
    assert rows and all(r.key_of_text == r.fingerprint_of_text == "mine" and r.tags == {"k": r.doc_id} for r in rows)
    assert any(r.text is None for r in exact.where("doc_id = 7").collect()) or exact.where("doc_id = 8").count()
    nulls = docs.where("doc_id = 7").unionAll(docs.where("doc_id = 7"))
    assert [r.text for r in corpus_pipeline.drop_exact_copies(spark, nulls, FOLDER).collect()] == [None]


def test_run_equals_query(spark):
    import __spark_entry__

    rows = __spark_entry__.queries()["pipeline"](spark, FOLDER)
    assert rows.columns[:3] == ["doc_id", "start", "length"] and rows.count() > 0
