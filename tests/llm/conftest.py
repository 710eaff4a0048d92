"""Fixtures of edge cases: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SENTENCE = "the quick brown fox jumps over the lazy dog and runs far away from every hunter near that old mill"


def edge_rows():
    varied = " ".join(f"word{i} of" for i in range(30))
    rows = [
        (1, "Same text, twice.", "en", "a", 17),
        (5, "Same text, twice.", "en", "b", 17),
        (3, "Same text, twice.", None, None, None),
        (7, None, "en", "a", None),
        (8, "", None, "a", 0),
        (9, " \t\n ", "de", None, 3),
        (10, "12345 $$$ ###", "de", "a", 13),
        (11, "Ünïcödé – 中文字 ’s don't  “x”\x0bend", "de", "b", 0),
        (12, SENTENCE, "en", "a", 0),
        (13, SENTENCE + " x", "en", "a", 0),
        (13, SENTENCE + " x", "en", "a", 0),
        (14, (SENTENCE + "\n") * 3, "en", "a", 0),
        (15, "long " * 30_000 + "x" * 50_000, "en", "a", 0),
        (16, varied, "fr", "a", 0),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    """Edge cases over three partitions, with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(edge_rows(), DOCUMENTS).repartition(3)
    clash = {c: F.lit("clash") for c in ("fp", "score", "shard", "ids", "size", "start", "part", "lang_pred")}
    return frame.withColumns(clash)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)
