"""Registered queries of the thirteen operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.llm import (
    byte_bpe,
    conversations,
    crossparse,
    outliers,
    packing,
    planes,
    quotient,
    segments,
    shuffle,
    simhash,
    spelling,
    toxicity,
    urlrules,
)
from wardlog.llm.common import remainder
from wardlog.session import new_folder

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_bit_planes(spark: SparkSession, folder: str) -> DataFrame:
    files = new_folder(spark, "planes")
    planes.write_planes(table(spark, folder, "documents"), files, public_tokenizers.path(WORD_BPE))
    return planes.with_starts(spark, files, planes.digests(planes.read_planes(spark, files)))


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    ids = byte_bpe.encode(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    return byte_bpe.digests(ids, path, public_tokenizers.PATTERN)


def op3_robust_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return outliers.judge(table(spark, folder, "documents"))


def op4_cross_parsing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = crossparse.identify(docs, crossparse.training_samples(docs))
    return found.withColumn("held_out", remainder("doc_id", 4) == 2)


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, folder, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.select("doc_id", digits.alias("fingerprint"), "component_id")


def op6_warc_segments(spark: SparkSession, folder: str) -> DataFrame:
    archives = new_folder(spark, "warc")
    segments.write_archives(table(spark, folder, "pages"), archives)
    return segments.captures(segments.read_records(spark, archives))


def op7_quotient_filter(spark: SparkSession, folder: str) -> DataFrame:
    return quotient.duplicates(table(spark, folder, "documents"))


def op8_hypergeometric_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    return shuffle.shuffle(table(spark, folder, "documents"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))
    return found.withColumn("held_out", remainder("doc_id", 5) == 0)


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE), keep_ids=False)


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return conversations.repaired_report(conversations.damaged(rows), rows)


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    words = spelling.word_counts(table(spark, folder, "documents"))
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op13_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return urlrules.judge(table(spark, folder, "pages"), urlrules.rule_table(spark))


OPERATORS = (
    op1_bit_planes,
    op2_byte_bpe,
    op3_robust_outliers,
    op4_cross_parsing,
    op5_simhash,
    op6_warc_segments,
    op7_quotient_filter,
    op8_hypergeometric_shuffle,
    op9_toxicity,
    op10_packing,
    op11_conversation_repair,
    op12_spelling_variants,
    op13_url_rules,
)
ORACLES = {
    "op7_quotient_filter": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
          doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
        FROM t WINDOW same AS (PARTITION BY body)""",
    "op13_url_rules": r"""
        WITH parts AS (
          SELECT page_id, row_number() OVER () AS row,
            translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
          FROM pages),
        rules(rule_host, rule_path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
          ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        best AS (
          SELECT row, max({'n': length(rule_host || rule_path), 'h': length(rule_host), 'v': verdict, 'r': rule_host || rule_path}) AS b
          FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
          GROUP BY row)
        SELECT page_id, host, path, b.r AS rule, coalesce(b.v, 'allow') AS verdict FROM parts LEFT JOIN best USING (row)""",
}


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in (*OPERATORS, pipeline)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
