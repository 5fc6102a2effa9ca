"""Repeated passages against a brute-force search over all word windows."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import suffix_dedup


def brute(rows: list[tuple[int | None, str | None]], min_words: int) -> list[tuple]:
    """Stretches of words covered by windows of min_words words that another row holds too."""
    texts = [(d, (t or "").split()) for d, t in rows]
    owners: dict[tuple, set[int]] = defaultdict(set)
    for i, (_, w) in enumerate(texts):
        for k in range(len(w) - min_words + 1):
            owners[tuple(w[k : k + min_words])].add(i)
    out = []
    for d, w in texts:
        spans: list[list[int]] = []
        for k in range(len(w) - min_words + 1):
            if len(owners[tuple(w[k : k + min_words])]) > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + min_words
                else:
                    spans.append([k, k + min_words])
        out += [(d, a, b, len(w)) for a, b in spans]
    return sorted(out, key=str)


def found(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("doc_id", "start_word", "end_word", "n_words").collect()), key=str)


def test_edge_cases(edge_docs: DataFrame) -> None:
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    assert found(suffix_dedup.repeated_passages(edge_docs)) == brute(rows, 50)


def test_planted_passages(spark: SparkSession) -> None:
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(4000)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 64, 65, 80, 200, 333)]
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 3)):
            words += rng.choice(passages) + [word() for _ in range(rng.randrange(0, 40))]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, want = found(suffix_dedup.repeated_passages(docs)), brute(rows, 50)
    assert got == want
    assert len(want) > 40


def test_shared_ends_of_different_lengths(spark: SparkSession) -> None:
    """One passage whose copies share more with some documents than with others, to the left and to the right."""
    core = [f"c{i}" for i in range(50)]
    left, right = [f"l{i}" for i in range(40)], [f"r{i}" for i in range(40)]
    rows = [(i, " ".join([f"a{i}"] + left[40 - n :] + core + right[:m] + [f"z{i}"])) for i, (n, m) in enumerate([(0, 0), (3, 7), (12, 2), (40, 0), (0, 40), (15, 16), (40, 40)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(suffix_dedup.repeated_passages(docs)) == brute(rows, 50)


def test_whole_table(spark: SparkSession, small: str) -> None:
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(suffix_dedup.repeated_passages(docs)) == brute(rows, 50)


def test_empty_table(no_docs: DataFrame) -> None:
    assert found(suffix_dedup.repeated_passages(no_docs)) == []


def test_halves_of_different_partners_do_not_make_a_passage(spark: SparkSession) -> None:
    """49 words shared with one text and 49 with another, 12 words further on: no passage of 50."""
    rows = []
    for family in range(40):
        w = [f"f{family}w{i}" for i in range(61)]
        rows += [(3 * family, " ".join(w)), (3 * family + 1, " ".join([*w[:49], "x"])), (3 * family + 2, " ".join(["y", *w[12:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(suffix_dedup.repeated_passages(docs)) == brute(rows, 50) == []


def test_overlapping_partners(spark: SparkSession) -> None:
    """Stretches that end at every offset, shared with others of other contexts, some of which have copies."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(140)]
    rows = []
    for i in range(90):
        a = rng.randrange(0, 90)
        b = rng.randrange(a + 30, 141)
        rows.append((i, " ".join([f"l{rng.randrange(3)}"] * rng.randrange(0, 2) + base[a:b] + [f"r{rng.randrange(3)}"] * rng.randrange(0, 2))))
    rows += [(200, rows[3][1]), (201, rows[4][1]), (None, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(suffix_dedup.repeated_passages(docs)) == brute(rows, 50)
