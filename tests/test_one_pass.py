"""Model runs read and deal their input once; windows, gaps and kinds as plain Python counts them."""

from __future__ import annotations

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import activation, propensity, snapshots
from tidemark.sources import canonical

ID = "golden_customer_id"


def exchanges(df: DataFrame, what: str) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count(what)


def counted(df: DataFrame) -> tuple[DataFrame, object]:
    """The same rows, and a counter of how many were computed."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), seen


def purchases(seed: int) -> list[tuple]:
    draw, start = random.Random(seed), dt.date(1999, 1, 1)
    kinds = ["A", "B", "Ç", "D", None]
    rows = []
    for who in range(60):
        for _ in range(draw.randrange(1, 14)):
            day = start + dt.timedelta(draw.randrange(0, 700))
            rows += [(len(rows) + k, who, day, draw.choice(kinds), draw.choice(["Store", "Online"]), 2, round(draw.random() * 90, 2), 3.0, draw.choice([None, 0.0, 0.05])) for k in range(draw.choice([1, 1, 2]))]
    return rows


def test_histories_are_dealt_once_and_equal_plain_counts(spark: SparkSession) -> None:
    rows, dates = purchases(5), [dt.date(1999, 4, 30), dt.date(2000, 1, 31), dt.date(2000, 7, 31)]
    tx = spark.createDataFrame(rows, f"order_id long, {ID} long, transaction_date date, category string, channel string, units long, net_sales double, gross_margin double, discount_pct double")
    out = snapshots.history_features(tx, dates, ahead=90, new_ahead=180)
    assert exchanges(out, "Exchange hashpartitioning") == 1
    got = {(r[snapshots.T], r[ID]): r for r in out.collect()}
    want = 0
    for date in dates:
        for who in range(60):
            mine = [r for r in rows if r[1] == who]
            past, inside = [r for r in mine if r[2] <= date], lambda a, b, m=mine, d=date: [r for r in m if a < (r[2] - d).days <= b]
            kinds = [r[3] for r in past if r[3]]
            if not kinds:
                assert (date, who) not in got
                continue
            want, r, days = want + 1, got[date, who], sorted({x[2] for x in past})
            gaps = [(b - a).days for a, b in zip(days, days[1:], strict=False)]
            assert (r.lifetime_orders, r.orders_prior_180d, r.prior_orders, r.future_orders_90d) == (len(past), len(inside(-180, 0)), len(inside(-360, -180)), len(inside(0, 90)))
            assert r.sales_prior_365d == pytest.approx(sum(x[6] for x in inside(-365, 0)))
            assert (r.days_since_last_purchase, r.observed_purchase_gaps) == ((date - days[-1]).days, len(gaps))
            assert r.median_purchase_gap_days == (statistics.median(gaps) if gaps else None)
            assert r.std_purchase_gap_days == (pytest.approx(statistics.stdev(gaps)) if len(gaps) > 1 else None)
            assert (r.categories_used, r.categories_prior_180d) == (len(set(kinds)), len({x[3] for x in inside(-180, 0)} - {None}))
            assert r.dominant_category_share == pytest.approx(max(kinds.count(k) for k in kinds) / len(kinds))
            assert r.new_categories == sorted({x[3] for x in inside(0, 180)} - {None} - set(kinds))
    assert len(got) == want > 100


def test_promotion_rows_are_neither_expanded_nor_dealt_by_exposure(spark: SparkSession, small: str) -> None:
    tx = canonical.transactions(spark, small).persist()
    exposures = canonical.campaign_exposures(spark, small, tx=tx)
    out = snapshots.promotion_training(tx, exposures)
    assert exchanges(out, "Expand") == 0 and exchanges(out, "hashpartitioning(exposure_id") == 0
    assert exchanges(exposures, "hashpartitioning(golden_customer_id#") == 1 and exchanges(exposures, "campaign_date#") > exchanges(exposures, "hashpartitioning(campaign_date")
    tx.unpersist()


def test_a_governed_run_reads_its_rows_once(spark: SparkSession) -> None:
    rows = spark.range(900).select(F.col("id").alias(ID), F.when(F.col("id") % 3 == 0, "2001-01-31").when(F.col("id") % 3 == 1, "2001-04-30").otherwise("2000-10-31").cast("date").alias(propensity.T), (F.col("id") * 37 % 101 / 101).alias("lifetime_sales"), F.when(F.col("id") % 7 > 0, F.col("id") % 11 / 1.0).alias("units"))
    data, seen = counted(rows.withColumn("bought", ((F.col("lifetime_sales") + (F.col(ID) * 17 % 29) / 60) > 0.75).cast("int")))
    run = propensity.governed_model(data, ["lifetime_sales", "units"], "bought", ("2000-01-31", "2001-01-31", "2001-04-30"), "reengagement", ID, rounds=3)
    assert run.metrics.count() == 8 and run.scores.count() == 300 and seen.value == 900
    # one deal for all eight gives what each gives alone
    one = run.metrics.where(f"candidate = '{run.about['champion']}' and split = 'test' and score = 'calibrated'").head()
    alone = propensity.evaluate_predictions(run.scores, "probability", "label").head()
    assert all(one[c] == pytest.approx(alone[c]) for c in ("roc_auc", "pr_auc", "brier", "log_loss", "calibration_gap"))
    assert one.top_decile_lift == pytest.approx(propensity.top_fraction_lift(run.scores, "probability", "label", ID, 0.1).head().lift)


def test_missing_values_take_the_median_before_scaling(spark: SparkSession) -> None:
    values = [1.0, None, 3.0, 8.0, None, 20.0]
    train = spark.createDataFrame([(i, v, float(i)) for i, v in enumerate(values)], "k int, units double, whole double")
    got = [r.vector for r in propensity.standardised(train, {"later": train.where("k < 2")}, ["units", "whole"])["train"].orderBy("k").collect()]
    filled = [5.5 if v is None else v for v in values]
    for c, column in enumerate((filled, list(map(float, range(6))))):
        mean, sd = statistics.mean(column), statistics.pstdev(column)
        assert [v[c] for v in got] == pytest.approx([(x - mean) / sd for x in column])


def test_offers_are_built_once(spark: SparkSession) -> None:
    fixed = {c: F.lit(1.0) for c in propensity.PROMOTION}
    kinds = {"campaign_channel": F.lit("Email"), "offer_category": F.lit("PROMO")}
    rows = spark.range(400).select(F.col("id").alias(ID), F.col("id").cast("string").alias("exposure_id")).withColumns(fixed | kinds | {"discount_depth": F.col(ID) % 4 / 10, "lifetime_sales": F.col(ID) % 13 / 1.0})
    training = rows.withColumns({"treatment_flag": F.lit(1), "campaign_date": F.when(F.col(ID) % 2 == 0, "2001-02-15").otherwise("2001-05-15").cast("date"), "responded": (F.col(ID) % 13 + F.col(ID) % 5 > 8).cast("int")})
    offers, seen = counted(rows.withColumn("margin_after_discount", F.lit(0.3)))
    out = activation.operational_scores(training, offers, spark.createDataFrame([("ACCEPTED",)], "model_status string"))
    assert out.count() == 400 and seen.value == 400
