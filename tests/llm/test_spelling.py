"""Spelling variants against a comparison of all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import spelling
from tidemark.llm.registry import ORACLES, op11_spelling_variants
from tests.llm.oracle import same_as_sql


def is_near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(docs: list[tuple], min_length: int, min_count: int, ratio: int, typo_every: int) -> list[tuple]:
    counts: Counter[str] = Counter()
    for doc, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if typo_every and h % typo_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= min_length and c >= min_count}
    form, near = {}, {}
    for w in n:
        near[w] = [v for v in n if is_near(w, v)]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def found(df: DataFrame) -> list[tuple]:
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()), key=str)


def documents(seed: int) -> list[tuple]:
    """Texts whose words share beginnings and ends, with chains of ever rarer variants."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(4, 8))) for _ in range(40)]
    words += ["common" + a + b for a in "abcdef" for b in "abcdef"] + [a + "shared" for a in "abcdefgh"]
    text: list[str] = []
    for w in words:
        for times in (64, 8, 1):
            text += [w] * times
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i + 1 :], w[:i] + "b" + w[i:]])
    rng.shuffle(text)
    rows = [(i, rng.choice([" ", ", ", "-", "1", "İ"]).join(text[i::29])) for i in range(29)]
    return [*rows, (None, "Naïve NAÏVE naÏve naïve naïve naïve " * 9), (3, None), (3, ""), rows[4], rows[4], (50, "x" * 70_000 + " " + "x" * 69_999 + "y"), (51, "Æon÷×ße " * 8)]


@pytest.mark.parametrize(("shard_words", "shard_queries"), [(50_000, 400_000), (30, 400_000), (9, 25)])
def test_all_pairs_of_words_whatever_the_shards(spark: SparkSession, shard_words: int, shard_queries: int) -> None:
    docs = documents(8)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("extra") for c in ("word", "n", "size", "raw", "key", "part")})
    got = spelling.spelling_variants(df, min_length=4, min_count=1, ratio=5, typo_every=11, shard_words=shard_words, shard_queries=shard_queries)
    want = brute(docs, 4, 1, 5, 11)
    assert found(got) == want
    assert any(r[1] is not None and r[1] != r[2] for r in want), "no chain of forms was tried"


def test_no_words(spark: SparkSession, no_docs: DataFrame, edge_docs: DataFrame) -> None:
    assert spelling.spelling_variants(no_docs).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, "a bc 12")], "doc_id long, text string")).count() == 0
    rows = [(r.doc_id, r.text) for r in edge_docs.where("doc_id is null or doc_id not in (8, 9)").collect()]
    few = edge_docs.where("doc_id is null or doc_id not in (8, 9)")
    assert found(spelling.spelling_variants(few, min_count=1)) == brute(rows, 6, 1, 5, 0)


def test_wavelet_tree_reports_rectangles() -> None:
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 200):
        values = rng.permutation(n)
        a, b, c, d = (rng.integers(0, n + 1, 60) for _ in range(4))
        which, got = spelling.WaveletTree(values).report(a, b, c, d)
        want = [(q, int(v)) for q in range(60) for v in values[a[q] : b[q]] if c[q] <= v < d[q]]
        assert sorted(zip(which.tolist(), got.tolist(), strict=True)) == sorted(want)


def test_query_equals_sql(spark: SparkSession, small: str) -> None:
    same_as_sql(op11_spelling_variants(spark, small), ORACLES["op11_spelling_variants"], small)
