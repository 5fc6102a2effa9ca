"""The classifier chain: held-out accuracy, the chain itself, and odd inputs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import toxicity
from tidemark.llm.registry import categories, op4_toxicity


def test_held_out_accuracy(spark: SparkSession) -> None:
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    chain = toxicity.train(docs, labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 0), categories())
    held = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    rows = toxicity.score(docs, chain).join(held, "doc_id").select("is_toxic", "toxic", "is_low_quality", "quality").collect()
    hits = sum(r.is_toxic and r.toxic == 1 for r in rows)
    assert hits >= 0.9 * sum(r.toxic == 1 for r in rows)
    assert hits >= 0.9 * sum(r.is_toxic for r in rows)
    assert [m[0] for m in chain.models] == ["low_quality", "toxic"]
    assert len(chain.models[0][2]) == 0 and len(chain.models[1][2]) == 1


def test_later_models_use_earlier_categories() -> None:
    rng = np.random.default_rng(0)
    n = 600
    first = rng.integers(0, 2, n).astype(float)
    x = toxicity.Sparse(np.arange(n + 1), np.where(first == 1, 0, 1), np.ones(n), 2)
    labels = np.column_stack([first, first])
    chain = toxicity.fit_chain(x, labels, ["a", "b"], np.arange(n) % 3, {0: 0, 1: 1})
    assert chain.models[1][2][0] > 0
    p = chain.predict(x)
    assert ((p > 0.5) == (labels == 1)).all()


def test_labels_may_be_missing_or_of_one_kind() -> None:
    x = toxicity.Sparse(np.arange(5), np.zeros(4, np.int64), np.ones(4), 1)
    chain = toxicity.fit_chain(x, np.array([[1, np.nan], [1, np.nan], [1, 0], [1, 0]]), ["a", "b"], np.arange(4) % 3, {0: 0})
    assert [m[4] for m in chain.models] == [2.0, 2.0]


def test_edge_cases(spark: SparkSession, edge_docs: DataFrame, no_docs: DataFrame) -> None:
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 1), (3, 1, 0), (8, 1, 0), (None, 1, 1), (999, 0, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(edge_docs, labels, categories())
    out = toxicity.score(edge_docs, chain)
    rows = out.collect()
    assert len(rows) == edge_docs.count()
    assert not any(r.is_toxic for r in rows if not (r.text or "").strip())
    assert toxicity.score(no_docs, chain).count() == 0
    nothing = toxicity.train(no_docs, labels.limit(0), categories())
    assert not any(r.is_toxic for r in toxicity.score(edge_docs, nothing).collect())


def test_whole_table(spark: SparkSession, small: str) -> None:
    rows = op4_toxicity(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    assert all(0 <= r.p_toxic <= 1 for r in rows)
