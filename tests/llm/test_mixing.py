"""Pfair mixing: shares within one block in every prefix, whole results, hot and null sources."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing
from tidemark.llm.registry import op6_source_mixing


def period_rows(spark: SparkSession, units: dict[str, int]) -> list[str]:
    weights = spark.createDataFrame(list(units.items()), "source_key string, units long")
    return [r.source_key for r in mixing.pfair_period(weights).orderBy("slot").collect()]


def test_every_prefix_is_within_one_block(spark: SparkSession) -> None:
    rng = random.Random(2)
    for units in ({"a": 1}, {"a": 1, "b": 1}, {"a": 7, "b": 2, "c": 1}, *[{f"s{i}": rng.randrange(1, 40) for i in range(rng.randrange(2, 9))} for _ in range(6)]):
        order, period = period_rows(spark, units), sum(units.values())
        assert len(order) == period
        for source, w in units.items():
            given = 0
            for t, got in enumerate(order, 1):
                given += got == source
                assert abs(given - w * t / period) < 1
            assert given == w


def test_whole_table_in_target_shares(spark: SparkSession, small: str) -> None:
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = op6_source_mixing(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    weights = {r.source_key: r.units for r in mixing.temperature_weights(docs).collect()}
    sizes = {r["source"]: r["count"] for r in docs.groupBy("source").count().collect()}
    by_slot: dict[int, list] = {}
    for r in rows:
        by_slot.setdefault(r.slot, []).append(r)
    assert all(len({(r.source, r.block) for r in part}) == 1 for part in by_slot.values())
    first_end = min(-(-n // 16) * sum(weights.values()) // weights[f"s{s}"] for s, n in sizes.items())
    for source in sizes:
        given = 0
        for t in range(first_end):
            given += any(r.source == source for r in by_slot.get(t, []))
            assert abs(given - weights[f"s{source}"] * (t + 1) / sum(weights.values())) < 1


def test_ranks_are_gapless_with_repeats_and_null_sources(edge_docs: DataFrame, no_docs: DataFrame) -> None:
    weights = mixing.temperature_weights(edge_docs, period=20)
    rows = mixing.mix(edge_docs, weights, block_docs=2).collect()
    assert len(rows) == edge_docs.count()
    for source in {r.source for r in rows}:
        ranks = sorted(r.block * 2 + r.place for r in rows if r.source == source)
        assert ranks == list(range(len(ranks)))
    assert mixing.mix(no_docs, mixing.temperature_weights(no_docs)).count() == 0
    mixed = mixing.mixed_order(edge_docs, weights, block_docs=2)
    assert mixed.columns == edge_docs.columns and mixed.count() == edge_docs.count()


def test_sources_without_weight_come_last(spark: SparkSession) -> None:
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "rare").otherwise("hot").alias("source"), F.lit("t").alias("text"))
    weights = spark.createDataFrame([("shot", 3)], "source_key string, units long")
    rows = mixing.mix(docs, weights, block_docs=4).orderBy("slot", "place").collect()
    assert [r.source for r in rows] == ["hot"] * 40 + ["rare"] * 20
