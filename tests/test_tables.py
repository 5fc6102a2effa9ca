"""Invariants of the built tables, and agreement with SQL, on the smallest folder."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
import shutil
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.operators import activation, decisions, growth, identity, views
from tidemark.plans import catalog

CHECKED = ["transactions_canonical", "campaign_exposures", "customer_features", "customer_momentum", "cadence_trend", "rfm_scores", "customer_value", "customer_priority", "customer_ltv", "cohort_retention", "movement_events", "growth_monthly", "cohort_summary", "value_funnel", "reengagement_training", "cross_sell_training", "promotion_training", "category_recommendations", "action_scores", "next_best_action", "nba_lifetime_value", "evaluate_predictions", "lift_table", "segment_summary", "lifecycle_by_tier", "retention_heatmap", "stratified_sample", "growth_signals", "segment_enrichment", "reengagement_baseline", "identity_normalised", "identity_candidates", "identity_dropped_blocks", "identity_households", "address_key_households", "address_key_variants", "address_key_false_pairs", "address_key_evaluation", "explorer_profile", "explorer_monthly_history", "explorer_gap_series", "explorer_channel_mix", "explorer_category_mix", "explorer_latest", "event_windows_stream", "event_sliding_stream", "event_sessions_stream", "movement_stream"]


def plain(v: object) -> object:
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, dt.datetime):
        return str(v.date())
    return round(v, 6) if isinstance(v, float) else str(v) if isinstance(v, dt.date) else v


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark: SparkSession, small: str, name: str) -> None:
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = catalog.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*cols).collect()), key=str)
    rel = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=str)
    assert got == want


def test_lifetime_value_reconciles(spark: SparkSession, small: str) -> None:
    t = catalog.tables(spark, small)
    assert t.ltv.agg(F.sum("lifetime_sales")).head()[0] == pytest.approx(t.tx.agg(F.sum("net_sales")).head()[0], abs=0.01)
    assert t.ltv.count() == t.master.count() == t.ltv.select("golden_customer_id").distinct().count()
    assert t.ltv.where("(not m6_mature and m6_margin is not null) or (m12_mature and not m6_mature)").count() == 0


def test_first_month_retention_is_whole_and_months_reconcile(spark: SparkSession, small: str) -> None:
    t = catalog.tables(spark, small)
    assert growth.cohort_retention(t.tx).where("age_months = 0 and retention_rate <> 1").count() == 0
    rows = growth.growth_monthly(t.tx).orderBy("month").collect()
    for a, b in zip(rows, rows[1:], strict=False):
        assert b.opening_customers == a.closing_customers
    assert all(r.opening_customers + r.net_change == r.closing_customers for r in rows)


def test_interventions_pay_and_are_explained(spark: SparkSession, small: str) -> None:
    for nba in (catalog.tables(spark, small).nba, activation.governed_actions(catalog.tables(spark, small).priority, catalog.tables(spark, small).tx)):
        assert nba.count() == nba.select("golden_customer_id").distinct().count()
        assert nba.where("recommended_action_nba <> 'Do Nothing' and action_margin <= 0").count() == 0
        assert nba.where("recommended_action_nba = 'Do Nothing' and (action_margin <> 0 or economically_positive)").count() == 0
        assert nba.where("action_rationale is null or action_rationale = '' or action_confidence not between 0 and 100").count() == 0


def test_identity_quality_gates(spark: SparkSession, small: str) -> None:
    records = catalog.tables(spark, small).records
    resolution, audit = identity.resolve(records.drop("true_person_id"))
    assert "true_person_id" not in resolution.columns
    m = identity.evaluate(resolution.join(records.select("identity_record_id", "true_person_id"), "identity_record_id")).head()
    assert m.precision >= 0.985 and m.recall >= 0.95 and m.false_merge_rate <= 0.015 and m.missed_link_rate <= 0.05
    assert abs(m.golden_customers / m.true_customers - 1) <= 0.03
    assert resolution.count() == records.count() and audit.where("accepted").count() > 0


def test_filters_and_search(spark: SparkSession, small: str) -> None:
    t = catalog.tables(spark, small)
    joined = t.priority.join(t.master, "golden_customer_id")
    assert views.apply_filters(joined).count() == joined.count()
    assert views.apply_filters(joined, tier="High").count() == joined.where("customer_value_tier = 'High'").count()


def test_plans_push_down_and_keep_python_out(spark: SparkSession, small: str) -> None:
    plan = spark._jvm.PythonSQLUtils.explainString(catalog.QUERIES["lifecycle_distribution"](spark, small)._jdf.queryExecution(), "formatted")
    assert "ArrowEvalPython" not in plan and "CartesianProduct" not in plan


def test_actions_name_the_cluster_and_the_lifetime_value(spark: SparkSession, small: str) -> None:
    t = catalog.tables(spark, small)
    clusters = t.master.where("golden_customer_id % 2 = 0").select("golden_customer_id", F.lit("Store-Led Shoppers").alias("cluster_name"))
    nba = decisions.next_best_action(t.priority, t.tx, ltv=t.ltv, clusters=clusters)
    assert nba.count() == t.priority.count()
    assert nba.where("cluster_name <> if(golden_customer_id % 2 = 0, 'Store-Led Shoppers', 'Not Yet Clustered')").count() == 0
    assert nba.where("recommended_action_nba = 'Protect' and not contains(action_rationale, concat(' value ', cluster_name, ' customer with '))").count() == 0
    assert nba.agg(F.sum("observed_ltv_sales")).head()[0] == pytest.approx(t.tx.agg(F.sum("net_sales")).head()[0], abs=0.01)
    plain_rows = t.nba.select("golden_customer_id", "recommended_action_nba", "action_score")
    assert nba.select("golden_customer_id", "recommended_action_nba", "action_score").exceptAll(plain_rows).count() == 0


def test_tables_are_released_when_their_input_changes(spark: SparkSession, small: str, tmp_path: Path) -> None:
    folder = tmp_path / "in"
    shutil.copytree(small, folder)
    first = catalog.tables(spark, str(folder))
    whole = first.tx.count()
    assert catalog.tables(spark, str(folder)) is first and first.tx.storageLevel.useMemory
    kept = spark.read.parquet(f"{small}/orders.parquet").where("o_orderkey % 2 = 0")
    os.chmod(folder, 0o755)
    os.rename(folder / "orders.parquet", tmp_path / "old.parquet")
    kept.write.parquet(f"{folder}/orders.parquet")
    second = catalog.tables(spark, str(folder))
    assert second is not first and 0 < second.tx.count() < whole
    assert not first.held and len(second.held) == 1
