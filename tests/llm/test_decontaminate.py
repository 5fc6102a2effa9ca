"""Benchmark decontamination against a search for every window at every place."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate
from tidemark.llm.registry import ORACLES, op13_decontamination
from tests.llm.oracle import same_as_sql

ITEM_SCHEMA = "item_id long, text string"
DOC_SCHEMA = "doc_id long, text string"


def lowered(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def places(text: str | None) -> list[tuple[str, int, int]]:
    return [(m.group(), *m.span()) for m in re.finditer("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))]


def brute(docs: list[tuple], items: list[tuple], window: int) -> list[tuple]:
    out = []
    for doc, text in docs:
        at = places(text)
        words = [w for w, _, _ in at]
        hit: set[int] = set()
        names = set()
        for name, item in items:
            theirs = [w for w, _, _ in places(item)]
            k = min(window, len(theirs))
            for i in range(len(theirs) - k + 1 if k else 0):
                for j in range(len(words) - k + 1):
                    if words[j : j + k] == theirs[i : i + k]:
                        hit |= set(range(j, j + k))
                        names |= {str(name)} if name is not None else set()
        starts = sorted(i for i in hit if i - 1 not in hit)
        spans = [(at[i][1], at[min(j for j in range(i, len(at)) if j + 1 not in hit)][2]) for i in starts]
        out.append((doc, len(words), len(hit), sorted(names), spans))
    return sorted(out, key=str)


def found(df: DataFrame) -> list[tuple]:
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], [(s.start, s.end) for s in r.spans]) for r in df.collect()), key=str)


def cases() -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(3)
    word = lambda: rng.choice(["Alpha", "beta", "x1", "日本", "naïve", "É"])
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 9)))) for i in range(12)]
    items += [(2, "beta beta"), (None, "no name here at all"), (30, ""), (31, None), (32, "--- !"), (33, "alpha"), (12, items[3][1])]
    docs = [(i, rng.choice([" ", ", ", "\n-- "]).join(word() for _ in range(rng.randrange(40)))) for i in range(60)]
    docs += [(None, "Beta. BETA, and no-name here (at) all"), (5, None), (5, ""), (7, docs[7][1]), (7, docs[7][1]), (8, "alpha " * 50_000), (9, "\U0001f600 ALPHA_beta@Beta[x1 İ")]
    return docs, items


@pytest.mark.parametrize("block_patterns", [10**6, 7])
def test_every_window_is_found_whatever_the_blocks(spark: SparkSession, block_patterns: int) -> None:
    docs, items = cases()
    got = decontaminate.contamination(spark.createDataFrame(docs, DOC_SCHEMA), spark.createDataFrame(items, ITEM_SCHEMA), window=4, block_patterns=block_patterns)
    short = [d for d in docs if len(d[1] or "") < 10_000]
    rows = found(got)
    assert [r for r in rows if r[1] < 10_000] == brute(short, items, 4)
    long = next(r for r in rows if r[1] >= 10_000)
    assert long[:3] == (8, 50_000, 50_000) and "33" in long[3] and long[4] == [(0, 6 * 50_000 - 1)]


def test_empty_tables_and_odd_columns(spark: SparkSession, edge_docs: DataFrame, no_docs: DataFrame) -> None:
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], ITEM_SCHEMA)
    assert decontaminate.contamination(no_docs, items).count() == 0
    nothing = decontaminate.contamination(edge_docs, items.limit(0))
    assert nothing.count() == edge_docs.count() and nothing.where("n_hit > 0 or size(items) > 0").count() == 0
    clashing = items.withColumns({c: F.lit("extra") for c in ("pattern", "item", "hits", "digest")})
    hit = decontaminate.contamination(edge_docs.withColumns({c: F.lit("extra") for c in ("digest", "hits", "items", "spans", "n_hit")}), clashing).where("n_hit > 0")
    assert sorted((r.doc_id, r.n_hit) for r in hit.collect()) == [(1, 10), (2, 10)]


def test_query_equals_sql(spark: SparkSession, small: str) -> None:
    same_as_sql(op13_decontamination(spark, small), ORACLES["op13_decontamination"], small)
    assert op13_decontamination(spark, small).where("contaminated").count() > 0
