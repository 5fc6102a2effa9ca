"""Exact quantiles of groups against numpy, with many and with few values left to rank."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.functions.quantiles import group_quantiles, with_quantiles


def values(rng: random.Random, kind: str, n: int) -> list[float]:
    if kind == "two":  # the middle lies between a half of zeros and a half of ones
        return [0.0] * (n // 2) + [1.0] * (n // 2)
    if kind == "ties":
        return [float(rng.choice([1, 1, 1, 2, 3])) for _ in range(n)]
    if kind == "outliers":
        return [rng.random() for _ in range(n - 2)] + [1e300, -1e300]
    if kind == "equal":
        return [7.0] * n
    return [rng.lognormvariate(0, 3) for _ in range(n)]


@pytest.mark.parametrize("gathered", [1, 20, 100_000])
@pytest.mark.parametrize("q", [0.5, 0.9])
def test_quantiles_equal_numpy(spark: SparkSession, gathered: int, q: float) -> None:
    rng = random.Random(3)
    groups = {"two": 400, "ties": 333, "outliers": 257, "equal": 50, "long": 1000, "one": 1, None: 12}
    rows = [(g, v, -v if rng.random() < 0.7 else None) for g, n in groups.items() for v in values(rng, str(g), n)]
    df = spark.createDataFrame([*rows, ("empty", None, None)], "g string, x double, _y double").repartition(4)
    got = {r.g: (r.qx, r.qy) for r in group_quantiles(df, ["g"], {"qx": "x", "qy": "_y"}, q, gathered=gathered).collect()}
    assert set(got) == set(groups)
    for g in groups:
        for place in (0, 1):
            have = [r[1 + place] for r in rows if r[0] == g and r[1 + place] is not None]
            want = float(np.quantile(have, q)) if have else None
            assert got[g][place] == (want if want is None else pytest.approx(want, rel=1e-12))


def test_the_whole_table_is_a_group(spark: SparkSession) -> None:
    df = spark.range(1001).select(F.col("id").alias("x"), F.lit(None).cast("int").alias("y"))
    row = group_quantiles(df, [], {"a": "x", "b": "y"}, gathered=5).head()
    assert (row.a, row.b) == (500.0, None)
    assert group_quantiles(df.limit(0), [], {"a": "x"}).head().a is None


def test_not_a_number_is_largest_and_infinities_are_values(spark: SparkSession) -> None:
    df = spark.createDataFrame([("a", math.inf), ("a", math.inf), ("a", -math.inf), ("b", math.nan), ("b", 1.0), ("b", 2.0), ("c", math.nan)], "g string, x double")
    for gathered in (1, 100):
        got = {r.g: r.m for r in group_quantiles(df, ["g"], {"m": "x"}, gathered=gathered).collect()}
        assert got["a"] == math.inf and got["b"] == 2.0 and math.isnan(got["c"])


def test_groups_without_values_stay(spark: SparkSession) -> None:
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 5.0), ("b", None)], "g string, x double")
    out = with_quantiles(df.groupBy("g").agg(F.count("*").alias("n")), df, ["g"], {"m": "x"})
    assert {tuple(r) for r in out.collect()} == {("a", 2, 1.5), (None, 1, 5.0), ("b", 1, None)}
