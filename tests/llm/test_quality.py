"""Quality rules: statistics against plain Python, the estimates against numpy, planted outliers."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import quality
from tidemark.llm.registry import op7_quality_rules


def base(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_statistics_of_edge_cases(edge_docs: DataFrame) -> None:
    rows = quality.quality_verdicts(edge_docs).collect()
    assert sorted((str(r.doc_id), tuple(r[c] for c in COLUMNS)) for r in rows) == sorted((str(r.doc_id), base(r.text)) for r in edge_docs.collect())
    assert not any(r.kept for r in rows if r.base_failed)


def test_statistics_of_the_whole_table(spark: SparkSession, small: str) -> None:
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = op7_quality_rules(spark, small).collect()
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got} == {d: base(t) for d, t in texts.items()}


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 10))) for _ in range(words))


def test_planted_outliers_go_and_clean_documents_stay(spark: SparkSession) -> None:
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(60, 900)), "en", "web" if i % 3 else "hot") for i in range(900)]
    junk = [(1000 + i, " ".join("#$%&*|<>" + w for w in prose(rng, 80).split()), "en", "web") for i in range(20)]
    junk += [(1100 + i, "\n".join([prose(rng, 30)] * 1 + ["same line of the page"] * 4 + [prose(rng, 40)]), "en", "web") for i in range(20)]
    docs = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.quality_verdicts(docs).collect()}
    assert sum(not kept[r[0]] for r in rows) <= 9
    assert sum(kept[r[0]] for r in junk[:20]) == 0


def exact_mcd(x: np.ndarray, support: float = 0.75) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance of the closest share of rows, from the same starts, by plain sorting."""
    floor = np.diag(np.square(list(quality.DIMENSIONS.values())))
    middle = np.sort(x, axis=0)[(len(x) - 1) // 2]
    scale = np.sqrt((1.4826 * np.sort(np.abs(x - middle), axis=0)[(len(x) - 1) // 2]) ** 2 + np.diag(floor))
    z = (x - middle) / scale
    unit = z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None]
    best = None
    for shape in (np.eye(4), 4 * unit.T @ unit / len(x), np.cov(np.tanh(z).T, bias=True)):
        centre, cov = middle, shape * np.outer(scale, scale) + floor
        for _ in range(40):
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            near = x[np.argsort(d, kind="stable")[: int(np.ceil(support * len(x)))]]
            centre, cov = near.mean(0), np.cov(near.T, bias=True) + floor
        if best is None or np.linalg.det(cov) < np.linalg.det(best[1]):
            best = (centre, cov)
    return best


def test_estimates_equal_a_plain_fit(spark: SparkSession) -> None:
    rng = np.random.default_rng(1)
    groups = {
        "planted": np.r_[rng.normal(0, 1, (900, 4)), rng.normal(12, 0.5, (100, 4))],
        "leaning": rng.normal(0, 1, (600, 4)) @ np.array([[1, 0.8, 0, 0], [0, 1, 0, 0], [0, 0, 0.3, 0.2], [0, 0, 0, 2]]),
        "small": rng.normal(5, 0.4, (21, 4)),
    }
    rows = spark.createDataFrame([(g, *map(float, r)) for g, x in groups.items() for r in x], "grp string, " + ", ".join(f"{c} double" for c in quality.DIMENSIONS)).cache()
    found = {r.grp: r for r in quality.mcd_models(rows).collect()}
    assert set(found) == set(groups)
    for g, x in groups.items():
        centre, cov = exact_mcd(x)
        m = found[g]
        own = np.array([[m[f"c{max(i, j)}{min(i, j)}"] for j in range(4)] for i in range(4)])
        assert m.n == len(x)
        assert np.abs(np.array([m[f"m{i}"] for i in range(4)]) - centre).max() < 0.12 * np.sqrt(np.diag(cov)).max()
        assert abs(np.log(np.linalg.det(own) / np.linalg.det(cov))) < (0.6 if g == "small" else 0.15)
        assert abs(m.logdet - np.log(np.linalg.det(own))) < 1e-6
    assert abs(np.cov(groups["planted"].T)[0, 1]) > 5 > abs(found["planted"].c10)


def test_verdicts_equal_those_of_plain_fits(spark: SparkSession, small: str) -> None:
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [r for r in quality.quality_verdicts(docs).collect() if not r.base_failed]
    table = np.array([[r[c] for c in quality.DIMENSIONS] for r in rows])
    keys = [(r.lang, r.source) for r in rows]
    floor = np.diag(np.square(list(quality.DIMENSIONS.values())))

    def fit(at: list[int]) -> tuple[int, np.ndarray, np.ndarray]:
        centre, cov = exact_mcd(table[at])
        return len(at), centre, quality.consistency(0.75) * (cov - floor) + floor

    drawn = lambda own, up: (own[0], *((own[0] * a + quality.PRIOR_ROWS * b) / (own[0] + quality.PRIOR_ROWS) for a, b in zip(own[1:], up[1:], strict=True)))
    every = fit(list(range(len(rows))))
    langs = {lang: drawn(fit([i for i, k in enumerate(keys) if k[0] == lang]), every) for lang in {k[0] for k in keys}}
    models = {k: drawn(fit([i for i, q in enumerate(keys) if q == k]), langs[k[0]]) for k in set(keys)}
    cut, differ = quality.chi_square_quantile(1e-15, 4), 0
    for r, k, x in zip(rows, keys, table, strict=True):
        _, centre, cov = models[k]
        d = (x - centre) @ np.linalg.inv(cov) @ (x - centre)
        if abs(np.log(d / cut)) > 0.3:  # near the cut the bins of distance may tell
            differ += (d <= cut) != r.kept
    assert len(rows) > 100 and differ == 0


def test_chi_square() -> None:
    assert abs(quality.chi_square_quantile(0.05, 4) - 9.4877) < 1e-3
    assert abs(quality.chi_square_tail(12.592, 6) - 0.05) < 1e-4


def test_small_groups_and_empty_tables(spark: SparkSession, no_docs: DataFrame) -> None:
    assert quality.quality_verdicts(no_docs).count() == 0
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, prose(rng, 100), None if i % 2 else "xx", f"s{i}") for i in range(12)], "doc_id long, text string, lang string, source string")
    assert all(r.kept for r in quality.quality_verdicts(docs).collect())
    assert docs.select(F.count("*")).head()[0] == 12
