"""Nearest neighbours: recall against brute force, exact scores, and odd vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import SparkSession

from tidemark.llm import ann
from tidemark.llm.registry import op2_nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, query_id string, shard string"


def brute(ids: np.ndarray, x: np.ndarray, every: int, k: int) -> dict[int, list[tuple[int, float]]]:
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        scores = (x * x[i]).sum(1)
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def answers(df) -> dict[int, list[tuple[int, float]]]:  # noqa: ANN001
    out: dict[int, list[tuple[int, int, float]]] = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for rows in out.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
    return {q: [(v, s) for _, v, s in rows] for q, rows in out.items()}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_recall_on_whole_tables(spark: SparkSession, folder: str) -> None:
    path = f"/root/testdata/{folder}"
    rows = [r for r in spark.read.parquet(f"{path}/embeddings.parquet").collect() if r.embedding]
    want = brute(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64), 20, 20)
    got = answers(op2_nearest_neighbours(spark, path))
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in rows}
    for q, found in got.items():
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
        for v, s in found:
            assert s == pytest.approx(float((vectors[q] * vectors[v]).sum()), rel=1e-12)


def test_graph_recall_in_one_large_shard() -> None:
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24)) * rng.uniform(0.5, 2, size=(3000, 1))
    graph, entry = ann.build_graph(x)
    assert graph.shape == (3000, 48)
    found, _ = ann._beam(x.astype(np.float32), graph, entry, x[:100].astype(np.float32), 128)
    scores = x[:100] @ x.T
    best = np.argsort(-scores, axis=1)[:, :20]
    hits = sum(len(set(a) & set(b)) for a, b in zip(found.tolist(), best.tolist(), strict=True))
    assert hits >= 0.9 * 2000


def test_pruning_keeps_diverse_edges() -> None:
    points = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2]], np.float32)
    kept = ann._pruned(points, np.array([0]), np.array([[1, 2, 3]]), 3, 1.2)
    assert kept.tolist() == [[1, 3, -1]]


def test_odd_vectors_ties_and_repeats(spark: SparkSession) -> None:
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [0.5, 0.5]), (None, [1.0, 1.0]), (10, [1.0, 2.0, 3.0]), (11, [-1.0, 0.0]), (40, [nan, 0.0])]
    df = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)
    got = answers(ann.nearest(df, every=20, k=20, least_shards=3))
    assert got == {0: [(1, 1.0), (2, 1.0), (20, 1.0), (9, 0.5), (11, -1.0)], 20: [(0, 1.0), (1, 1.0), (2, 1.0), (9, 0.5), (11, -1.0)]}
    assert answers(ann.nearest(df, every=20, k=2, least_shards=3)) == {0: [(1, 1.0), (2, 1.0)], 20: [(0, 1.0), (1, 1.0)]}


def test_many_copies_of_one_vector(spark: SparkSession) -> None:
    rows = [(i, [1.0, 1.0] if i % 3 else [float(i % 7), 1.0], 0, "x", "y") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert answers(ann.nearest(df, least_shards=2)) == brute(ids, x, 20, 20)


def test_empty_table(spark: SparkSession) -> None:
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).collect() == []
