"""Documents with the cases every corpus operator must handle."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession

LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(40_000))
COMMON = " ".join(f"passage{i}" for i in range(60))
ROWS: list[tuple[int | None, str | None, str | None, str | None, int | None]] = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "web", 50),
    (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "web", 50),
    (3, "alpha beta gamma delta epsilon zeta eta theta iota lambda", "en", "web", 51),
    (4, None, "en", "web", None),
    (5, "", None, None, 0),
    (6, "one", "de", "books", 3),
    (7, "one two", "de", None, 7),
    (8, LONG, "en", "web", len(LONG)),
    (9, LONG + " tail", "en", "web", len(LONG) + 5),
    (10, "start of ten " + COMMON + " end of ten", "en", "web", 1),
    (11, "another beginning here " + COMMON + " and another end", "fr", "news", 1),
    (11, "another beginning here " + COMMON + " and another end", "fr", "news", 1),
    (12, " \t\n ", "fr", "news", 4),
    (None, "a row without an id " * 4, "fr", "news", 80),
    (13, "same words again", "en", "web", 16),
    (14, "same words again", "en", "books", 16),
    (15, "ünï cödé 日本語 テスト \U0001f600 <|endoftext|>", "xx", "web", 20),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["n", "fp", "key", "token", "pos", "kept", "grp", "slot", "block", "place", "mix_source", "component_id", "n_private", "length", "piece", "h", "d2", "url", "_found", "is_toxic"]


@pytest.fixture(scope="session")
def edge_docs(spark: SparkSession) -> DataFrame:
    """Nulls, empty and long texts, repeated rows and ids, and extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ROWS, SCHEMA)
    return docs.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
