"""The corpus pipeline: every stage against a brute-force version on the small table, and odd inputs."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_jaccard import brute_components
from tests.llm.test_quality import base
from tidemark.llm import mixing, packing
from tidemark.llm.common import stored
from tidemark.llm.tokens import default_path


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted((str(r.doc_id), str(r.text)) for r in df.select("doc_id", "text").collect())


def test_stages_on_the_small_table(spark: SparkSession, small: str) -> None:
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "n-gram Jaccard join", "private data", "source mixing", "best-fit packing"]
    kept = stages["quality rules"](spark, docs, small).cache()
    assert not any(base(r.text)[5] for r in kept.collect())
    assert set(rows_of(kept)) <= set(rows_of(docs))
    unique = stages["n-gram Jaccard join"](spark, kept, small).cache()
    groups = brute_components([(r.doc_id, r.text) for r in kept.collect()], 5, 80, 100)
    assert sorted(r.doc_id for r in unique.collect()) == sorted({c for _, n, c in groups if n})
    private = stages["private data"](spark, unique, small).cache()
    assert [r[0] for r in rows_of(private)] == [r[0] for r in rows_of(unique)]
    mixed = stages["source mixing"](spark, private, small)
    assert rows_of(mixed) == rows_of(private)
    assert all(df.columns == docs.columns for df in (kept, unique, private, mixed))
    packed = stages["best-fit packing"](spark, mixed, small).collect()
    pieces = packing.pieces_of(private, default_path("word_bpe_49k.json")).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, packed)) == sorted(map(key, pieces))


def test_odd_inputs_go_through(spark: SparkSession, small: str, edge_docs: DataFrame, no_docs: DataFrame) -> None:
    for docs in (edge_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, small)
            out.collect()


def test_run(spark: SparkSession, small: str) -> None:
    assert corpus_pipeline.run(spark, small).count() > 0


def test_sequences_follow_the_mix(spark: SparkSession, small: str, monkeypatch: pytest.MonkeyPatch) -> None:
    docs = spark.range(240).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "rare").otherwise("hot").alias("source"), F.lit("the same words " * 400).alias("text"))
    unpacked = mixing.temperature_weights

    def packed(**weights: float) -> list[int]:
        monkeypatch.setattr(mixing, "temperature_weights", lambda d: unpacked(d, **weights))
        rows = corpus_pipeline.packing_stage(spark, docs, small).orderBy("sequence_id", "offset").collect()
        place = {r.doc_id: (r.slot, r.mix_source, r.place) for r in mixing.mix(docs, mixing.temperature_weights(docs)).collect()}
        ids = [r.doc_id for r in rows]
        assert ids == sorted(place, key=place.get)
        return ids

    assert packed(exponent=0.0) != packed(exponent=3.0)


def equal_texts(spark: SparkSession) -> DataFrame:
    return spark.range(240).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "rare").otherwise("hot").alias("source"), F.lit("the same words " * 400).alias("text"))


def in_sequence(packed: DataFrame) -> list[int]:
    return [r.doc_id for r in packed.orderBy("sequence_id", "offset").collect()]


def test_packing_follows_what_the_mixing_stage_wrote(spark: SparkSession, small: str, tmp_path: Path) -> None:
    docs = equal_texts(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for exponent in (0.0, 3.0):
            weights = mixing.temperature_weights(docs, exponent=exponent)
            place = {r.doc_id: (r.slot, r.mix_source, r.place) for r in mixing.mix(docs, weights).collect()}
            path = str(tmp_path / f"mixed-{exponent}")
            mixing.mixed_order(docs, weights).write.option("maxRecordsPerFile", 17).parquet(path)
            mixed = spark.read.parquet(path)
            assert len(mixed.inputFiles()) > 10
            assert in_sequence(corpus_pipeline.packing_stage(spark, mixed, small)) == sorted(place, key=place.get)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_run_differs_without_the_mixing_stage(spark: SparkSession, tmp_path: Path, monkeypatch: pytest.MonkeyPatch) -> None:
    docs = equal_texts(spark)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    place = {r.doc_id: (r.slot, r.mix_source, r.place) for r in mixing.mix(docs, mixing.temperature_weights(docs)).collect()}
    stages = corpus_pipeline.STAGES
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages[-2:])
    assert in_sequence(corpus_pipeline.run(spark, str(tmp_path))) == sorted(place, key=place.get)
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages[-1:])
    assert in_sequence(corpus_pipeline.run(spark, str(tmp_path))) == list(range(240))


def test_places_in_files(spark: SparkSession, tmp_path: Path) -> None:
    """Files come by number, and a file's rows by place, whatever the order of reading; clashing names do no harm."""
    names = [f"part-{n}-{u}-c{c}.snappy.parquet" for n, u, c in (("00002", "u", "000"), ("00010", "u", "000"), ("00010", "u", "999"), ("00010", "u", "1000"), ("100000", "u", "000"), ("99999", "u", "000"))]
    rows = [(f"file:///x/{name}", row, f"{name} {row}") for name in names for row in range(3)]
    placed = stored(spark.createDataFrame(rows, "file string, row long, what string"), "places")
    order = [names[i] for i in (0, 1, 2, 3, 5, 4)]
    got = mixing.in_file_order(placed).orderBy("at").collect()
    assert [(r.at, r.what) for r in got] == [(3 * i + k, f"{name} {k}") for i, name in enumerate(order) for k in range(3)]
    path = str(tmp_path / "clash")
    spark.range(5).select("id", F.lit("own").alias("_metadata"), F.lit("own").alias("file")).coalesce(1).write.parquet(path)
    assert [r.row for r in mixing.file_places(spark.read.parquet(path), "id").orderBy("id").collect()] == list(range(5))
    assert mixing.file_places(spark.range(5), "id") is None
