"""Corpus pipeline over the documents table: quality rules, near duplicates, personal data, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept; between
stages the documents are written as Parquet and read again. All but the last return the columns of
documents. Nulls, empty tables, ties and extra columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, mixing, packing, pii, quality
from tidemark.llm.common import stored, table
from tidemark.llm.registry import PSEUDONYM_KEY
from tidemark.llm.tokens import default_path

BLOCK_DOCS = 16
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality_verdicts(docs).where("kept").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8."""
    return jaccard.one_of_each(docs, size=5, num=80, den=100)


def private_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal values replaced; n_chars follows the text."""
    out = pii.pseudonymise(docs, key=PSEUDONYM_KEY)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_private") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order that follows the sources' target weights; the packing stage reads it from the files."""
    return mixing.mixed_order(docs, mixing.temperature_weights(docs), block_docs=BLOCK_DOCS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets; pieces of one length come in the order of the files.

    That is the order which the mixing stage gave them. Documents that are not read from Parquet files have no order yet:
    they are mixed and written first. Texts are tokenised where they are read: only pieces and their places, a few
    numbers each, are shuffled.
    """
    placed = mixing.file_places(docs, "doc_id", "text")
    if placed is None:
        placed = mixing.file_places(stored(mixing_stage(spark, docs, sf_dir), "source-mixing"), "doc_id", "text")
    pieces = stored(packing.pieces_of(placed, default_path("word_bpe_49k.json"), capacity=4096, end_id=1, order=("file", "row")), "pieces")
    return packing.pack(stored(mixing.in_file_order(pieces), "placed-pieces"), capacity=4096, order=("at",))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("private data", private_data_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Iterated fits, components, keyed digests and bin packing are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
