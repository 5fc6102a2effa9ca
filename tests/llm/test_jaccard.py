"""The n-gram Jaccard join against a brute-force comparison of all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard
from tidemark.llm.registry import op10_ngram_jaccard


def shingle_set(text: str | None, size: int) -> frozenset:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return frozenset()
    width = min(size, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute_components(rows: list[tuple[int | None, str | None]], size: int, num: int, den: int) -> list[tuple]:
    """(doc_id, set size, smallest id of the component) of every row."""
    sets = [shingle_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    key = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    least = {}
    for i in range(len(rows)):
        r = root(i)
        least[r] = min(least.get(r, key(i)), key(i))
    return sorted(((d, len(sets[i]), None if least[root(i)][0] else least[root(i)][1]) for i, (d, _) in enumerate(rows)), key=str)


def found(df: DataFrame) -> list[tuple]:
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.mark.parametrize(("size", "num"), [(3, 90), (5, 80)])
def test_edge_cases(edge_docs: DataFrame, size: int, num: int) -> None:
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    assert found(jaccard.jaccard_components(edge_docs, size=size, num=num)) == brute_components(rows, size, num, 100)


def test_whole_table(spark: SparkSession, small: str) -> None:
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert found(op10_ngram_jaccard(spark, small)) == brute_components(rows, 3, 90, 100)


def test_chains_and_near_threshold_pairs(spark: SparkSession) -> None:
    """Texts that differ by single words around the threshold, in chains longer than one link."""
    rng = random.Random(5)
    rows: list[tuple[int, str]] = []
    for family in range(12):
        words = [f"f{family}w{i}" if rng.random() < 0.8 else f"common{rng.randrange(6)}" for i in range(rng.randrange(8, 60))]
        for _ in range(8):
            rows.append((len(rows) * 3 + 1, " ".join(words)))
            words = list(words)
            words[rng.randrange(len(words))] = f"x{rng.randrange(10_000)}"
            if rng.random() < 0.3:
                words.append(f"end{rng.randrange(50)}")
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size, num in ((3, 90), (5, 80), (2, 60)):
        assert found(jaccard.jaccard_components(docs, size=size, num=num)) == brute_components(rows, size, num, 100)


def test_one_of_each(edge_docs: DataFrame) -> None:
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    kept = jaccard.one_of_each(edge_docs, size=5, num=80)
    assert kept.columns == edge_docs.columns
    got = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
    groups = brute_components(rows, 5, 80, 100)
    wordless = sum(1 for _, n, _ in groups if not n)
    assert len(got) == len({c for _, n, c in groups if n}) + wordless
    assert set(got) <= set(rows)


def test_empty_table(no_docs: DataFrame) -> None:
    assert found(jaccard.jaccard_components(no_docs)) == []
    assert jaccard.one_of_each(no_docs).count() == 0


def test_lists_keep_all_that_may_link() -> None:
    """Streamed lists against all pairs, for lists of any length and batches of any size."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(6)
    rows = set()
    for token in range(60):
        for _ in range(rng.choice([1, 2, 3, 5, 40, 64, 65, 66, 130, 200])):
            n = rng.randrange(5, 40)
            rows.add((token, rng.randrange(1 << 40), n, rng.randrange(0, n // 5 + 1)))
    ordered = sorted(rows, key=lambda r: (r[0], r[3], r[2], r[1]))
    repeated = [r for r in ordered for _ in range(rng.choice([1, 1, 3]))]
    want = set()
    for token in range(60):
        part = [r for r in ordered if r[0] == token]
        for r in part:
            may = any(q is not r and 100 * min(r[2], q[2]) >= 80 * max(r[2], q[2]) and min(r[2] - r[3], q[2] - q[3]) >= -(-80 * (r[2] + q[2]) // 180) for q in part)
            if len(part) > 64 or may:
                want.add((*r, part[0][1], part[0][2], part[0][3]))
    for size in (1, 7, 64, 1000, 100_000):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in b]), pa.array([r[1] for r in b]), pa.array([r[2] for r in b], pa.int32()), pa.array([r[3] for r in b], pa.int32())], names=["token", "key", "n", "pos"]) for b in (repeated[i : i + size] for i in range(0, len(repeated), size))]
        got = [tuple(r.values()) for out in jaccard.with_leads(iter(batches), 80, 100) for r in out.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want
    a, b = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 700, np.int64)).view(np.uint64) * np.uint64(2), None
    b = np.unique(np.r_[a[:390], a[390:] + np.uint64(1)])
    real = len(np.setxor1d(a, b))
    for x, y in ((a, b), (a, a[:300]), (a[:20], b)):
        assert jaccard.least_difference(jaccard.range_counts(x), jaccard.range_counts(y)) <= len(np.setxor1d(x, y))
    assert real and jaccard.least_difference(jaccard.range_counts(a), jaccard.range_counts(a)) == 0
