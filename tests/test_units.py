"""Rules on tables of a few literal rows."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars, windows
from tidemark.operators import cadence, decisions, identity, propensity, segments, value
from tidemark.operators.components import connected_components
from tidemark.sources import formats


def column(spark: SparkSession, values: list, expression, kind: str = "double") -> list:  # noqa: ANN001
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_active_window_and_lapse_floor(spark: SparkSession) -> None:
    assert column(spark, [100, 365, 366, None], cadence.active_flag, "int") == [True, True, False, False]
    row = cadence.add_lapse(spark.createDataFrame([(4, 2.0)], "days_since_last_purchase int, median_purchase_gap_days double")).head()
    assert row.expected_return_days == 7 and row.adjusted_lapse_ratio == pytest.approx(4 / 7)


def test_priority_scores(spark: SparkSession) -> None:
    row = spark.range(1).select(value.priority_score(F.lit(100.0), F.lit(80.0), F.lit(60.0)).alias("p"), value.lapse_score(F.lit(3.0), F.lit("Low")).alias("l"), value.lapse_score(F.lit(1.25), F.lit("High")).alias("m")).head()
    assert (row.p, row.l, row.m) == (83.0, 0.0, 50.0)
    assert column(spark, [75.0, 55.0, 35.0, 34.9], value.priority_band) == ["Critical", "High", "Medium", "Low"]


def test_customers_without_purchases(spark: SparkSession) -> None:
    df = spark.createDataFrame([(1, None, 0.0, 0.0), (2, 5, 500.0, 1500.0)], "golden_customer_id long, orders long, trailing_12m_margin double, trailing_12m_sales double")
    rows = {r.golden_customer_id: r for r in value.add_value(df).collect()}
    assert rows[1].customer_value_tier == "No Purchase" and rows[1].commercial_value_score == 0
    assert rows[2].customer_value_tier == "Very High"


def test_lifecycle_order(spark: SparkSession) -> None:
    rows = [(0, "Low", False, None), (1, "Low", True, 9.0), (1, "Low", False, 0.1), (5, "High", True, 0.99), (5, "High", True, 1.0), (5, "High", True, 1.5), (5, "High", False, 2.0), (5, "High", True, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, o int, c string, a boolean, r double")
    got = [r.s for r in df.select("i", cadence.lifecycle_status(F.col("o"), F.col("c"), F.col("a"), F.col("r")).alias("s")).orderBy("i").collect()]
    assert got == ["Acquired / Never Purchased", "Active / Limited History", "Inactive / Limited History", "On Cadence", "Watch", "At Risk", "Highly Lapsed", "Unclassified"]


def test_scalar_rules(spark: SparkSession) -> None:
    assert column(spark, [2.0, 0.0, None], lambda x: scalars.safe_divide(F.lit(6), x)) == [3.0, None, None]
    assert column(spark, [-1.0, 0.5, 2.0, None], lambda x: scalars.clip(x, 0, 1)) == [0.0, 0.5, 1.0, None]
    assert column(spark, [0.25, 0.249, None], lambda x: scalars.band(x, [(0.25, "a"), (0.5, "b")], "c")) == ["b", "a", None]
    assert column(spark, [" Jane.Doe+tag@Mail.com ", "nobody", None], scalars.normalise_email, "string") == ["janedoe@mail.com", "nobody", ""]
    assert column(spark, ["+61 412 345 678", "0412-345-678", None], scalars.normalise_phone, "string") == ["0412345678", "0412345678", ""]
    assert column(spark, ["12 High Street, Unit 3", "5 Park Avenue"], scalars.normalise_address, "string") == ["12 high st unit 3", "5 park ave"]
    assert column(spark, ["3000.0", "30 00"], scalars.normalise_postcode, "string") == ["3000", "3000"]


def test_p_value_equals_the_t_distribution(spark: SparkSession) -> None:
    def exact(r2: float, n: int) -> float:
        """By numeric integration of the density."""
        free = n - 2
        t = math.sqrt(r2 * free / (1 - r2))
        x = np.linspace(0, t, 200_001)
        y = (1 + x * x / free) ** (-(free + 1) / 2) * math.gamma((free + 1) / 2) / (math.sqrt(free * math.pi) * math.gamma(free / 2))
        return 1 - 2 * float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())

    cases = [(0.3, 3), (0.3, 4), (0.5, 5), (0.2, 6), (0.7, 9), (0.05, 20), (0.4, 31)]
    df = spark.createDataFrame(cases, "r2 double, n int")
    for r in df.select("r2", "n", scalars.slope_p_value(F.col("r2"), F.col("n")).alias("p")).collect():
        assert r.p == pytest.approx(exact(r.r2, r.n), abs=1e-6)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(0, 12)), min_size=1, max_size=60))
def test_ranks_equal_pandas(spark: SparkSession, values: list) -> None:
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "k int, v double")
    got = {r.k: (r.p, r.q) for r in windows.quintile_first(windows.pct_rank_average(df, "v", "p"), "v", "k", "q").collect()}
    s = pd.Series(values, dtype="float")
    pct, first = s.rank(pct=True, method="average"), s.rank(method="first")
    n = int(s.notna().sum())
    for i in range(len(values)):
        want_q = None if math.isnan(s[i]) else 1 if n == 1 else max(1, math.ceil(5 * (first[i] - 1) / (n - 1)))
        assert got[i][1] == want_q
        assert got[i][0] is None if math.isnan(s[i]) else got[i][0] == pytest.approx(pct[i])


def test_metrics_of_a_hand_made_score(spark: SparkSession) -> None:
    rows = [(1, 0.9, 1), (2, 0.8, 0), (3, 0.8, 1), (4, 0.3, 0), (5, 0.1, 0)]
    df = spark.createDataFrame(rows, "k int, s double, y int")
    m = propensity.evaluate_predictions(df, "s", "y").head()
    assert m.roc_auc == pytest.approx((3 + 2.5) / 6)
    assert m.pr_auc == pytest.approx((1 / 1 + 2 / 3) / 2)
    assert propensity.top_fraction_lift(df, "s", "y", "k", 0.2).head().lift == pytest.approx(2.5)


def test_leakage_guard_and_governance_fallback(spark: SparkSession) -> None:
    with pytest.raises(ValueError, match="future_sales_90d"):
        propensity.check_no_leakage(["orders", "future_sales_90d"])
    for features in (propensity.REENGAGEMENT, propensity.CROSS_SELL, propensity.PROMOTION):
        propensity.check_no_leakage(features)
    assert not propensity.model_is_accepted(None)
    assert not propensity.model_is_accepted(spark.createDataFrame([], "gate string, passed boolean"))
    assert propensity.model_is_accepted(spark.createDataFrame([("a", "True"), ("b", "yes")], "gate string, passed string"))
    assert not propensity.model_is_accepted(spark.createDataFrame([("a", "REJECTED")], "gate string, model_status string"))


def test_segment_names() -> None:
    assert len({n for _, n in segments.NAMES}) == 6


def test_components(spark: SparkSession) -> None:
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 101), (101, 102), (200, 200)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 31)}, **{i: 100 for i in (100, 101, 102)}}


def test_similarity_and_verdicts(spark: SparkSession) -> None:
    assert identity.ratio("", "x") == 0 and identity.ratio("abc", "abc") == 1
    assert identity.ratio("abcd", "bcde") == 0.75


def test_sources_and_sinks(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    df = formats.from_rows(spark, [(1, "a"), (2, "b")], "k int, v string")
    formats.write_parquet(df, f"{tmp_path}/p")
    assert sorted(formats.read_parquet(spark, f"{tmp_path}/p", ["k"]).collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError, match="lacks columns"):
        formats.read_parquet(spark, f"{tmp_path}/p", ["missing"])
    assert formats.read_optional(spark, f"{tmp_path}/none", "k int").schema.names == ["k"]
    formats.export_csv(df, f"{tmp_path}/c", one_file=True)
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 2
    formats.write_json(spark, {"status": "ACCEPTED", "on": dt.date(2001, 1, 1)}, f"{tmp_path}/j")
    assert formats.read_json(spark, f"{tmp_path}/j") == {"status": "ACCEPTED", "on": "2001-01-01"}
    assert [r.month.month for r in formats.month_spine(spark, "2001-01-15", "2001-03-01").collect()] == [1, 2, 3]
    joined = formats.checked_join(df, df.withColumnRenamed("v", "w"), ["k"])
    assert sorted(map(tuple, joined.collect())) == [(1, "a", "a"), (2, "b", "b")]
    with pytest.raises(Exception, match="right side repeats"):
        formats.checked_join(df, df.union(df).withColumnRenamed("v", "w"), ["k"]).collect()
    with pytest.raises(Exception, match="left side repeats"):
        formats.checked_join(df.union(df), df.withColumnRenamed("v", "w"), ["k"], validate="one_to_one").count()
    nulls = spark.createDataFrame([(None, "x"), (None, "y"), (1, "z")], "k int, w string")
    assert sorted(map(tuple, formats.checked_join(df, nulls, ["k"]).collect())) == [(1, "a", "z"), (2, "b", None)]
    assert formats.first_present(df, ["x", "v"]) == "v"


def test_actions_need_positive_economics(spark: SparkSession) -> None:
    assert set(decisions.ECONOMICS) == {"Protect", "Re-engage", "Develop", "Cross-sell", "Promote"}
