"""Candidate choice, gates that activation reads, ranks with tied values, exact pairs, samples and names."""

from __future__ import annotations

import pytest
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.windows import positions, quintile_first
from tidemark.operators import activation, identity, propensity, views
from tidemark.plans import catalog

ID = "golden_customer_id"


def scores(boosted: tuple, logistic: tuple) -> list[Row]:
    names = ("roc_auc", "pr_auc", "top_decile_lift", "brier")
    return [Row(candidate=c, split="validation", score="raw_score", **dict(zip(names, v, strict=True))) for c, v in (("boosted", boosted), ("logistic", logistic))]


def test_boosted_trees_win_only_by_a_margin() -> None:
    assert propensity.select_candidate(scores((0.70, 0.4, 1.5, 0.2), (0.69, 0.4, 1.5, 0.2)), "reengagement") == "logistic"
    assert propensity.select_candidate(scores((0.72, 0.4, 1.5, 0.2), (0.69, 0.4, 1.5, 0.2)), "reengagement") == "boosted"
    assert propensity.select_candidate(scores((0.695, 0.4, 1.60, 0.2), (0.69, 0.4, 1.5, 0.2)), "cross_sell") == "boosted"
    assert propensity.select_candidate(scores((0.695, 0.4, 1.56, 0.2), (0.69, 0.4, 1.5, 0.2)), "cross_sell") == "logistic"
    assert propensity.select_candidate(scores((0.695, 0.4, 1.56, 0.2), (0.69, 0.4, 1.5, 0.2)), "promotion") == "boosted"
    assert propensity.select_candidate(scores((0.695, 0.4, 2.00, 0.2), (0.69, 0.4, 1.5, 0.2)), "reengagement") == "logistic"
    assert propensity.select_candidate(scores((0.60, 0.4, 1.5, 0.2), (0.69, 0.4, 1.5, 0.2)), "promotion") == "logistic"


def test_offers_need_an_accepting_governance_table(spark: SparkSession, small: str) -> None:
    training = spark.createDataFrame([], "treatment_flag int")
    for gates in (None, spark.createDataFrame([], "model_status string"), spark.createDataFrame([("REJECTED",)], "model_status string"), spark.createDataFrame([(False,)], "passed boolean")):
        assert activation.operational_scores(training, training, gates).count() == 0


def test_a_governed_run_writes_what_activation_reads(spark: SparkSession, small: str) -> None:
    rows = spark.range(900).select(F.col("id").alias(ID), F.when(F.col("id") % 3 == 0, "2001-01-31").when(F.col("id") % 3 == 1, "2001-04-30").otherwise("2000-10-31").cast("date").alias(propensity.T), (F.col("id") * 37 % 101 / 101).alias("lifetime_sales"))
    data = rows.withColumn("bought", ((F.col("lifetime_sales") + (F.col(ID) * 17 % 29) / 60) > 0.75).cast("int"))
    run = propensity.governed_model(data, ["lifetime_sales"], "bought", ("2000-01-31", "2001-01-31", "2001-04-30"), "reengagement", ID, rounds=5)
    assert run.about["activation_allowed"] == propensity.model_is_accepted(run.gates)
    assert run.about["champion"] in ("logistic", "boosted") and run.about["metrics"]["roc_auc"] > 0.8
    got = run.scores.collect()
    assert len(got) == 300 and {r.eligible_for_activation for r in got} == {run.about["activation_allowed"]}
    assert {r.model_status for r in got} == {run.about["status"]}
    assert run.metrics.count() == 8 and run.coefficients.head().direction == "Increases"


def test_ranks_of_tied_values(spark: SparkSession) -> None:
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("v"))
    got = {r.k: r for r in positions(df, [F.col("v"), F.col("k")], "k").collect()}
    want = sorted(range(1000), key=lambda k: (k % 3, k))
    assert [got[k]._rank for k in want] == list(range(1, 1001)) and {r._n for r in got.values()} == {1000}
    fifth = {r.k: r.q for r in quintile_first(df, "v", "k", "q").collect()}
    assert [fifth[k] for k in want] == [max(1, -(-5 * i // 999)) for i in range(1000)]
    assert quintile_first(df.withColumn("v", F.lit(None).cast("long")), "v", "k", "q").where("q is not null").count() == 0


def test_exact_links_hold_groups_of_any_size_together(spark: SparkSession) -> None:
    rows = [(f"R{i:03d}", "same@x.org" if i < 5 else "many@x.org" if i < 55 else "", "") for i in range(60)]
    n = spark.createDataFrame(rows, f"{identity.RECORD} string, norm_email string, norm_phone string")
    got = {(r.a, r.b) for r in identity.exact_links(n).collect()}
    assert got == {("R000", f"R{j:03d}") for j in range(1, 5)} | {("R005", f"R{j:03d}") for j in range(6, 55)}


def test_blocks_too_large_are_reported_and_can_be_kept(spark: SparkSession) -> None:
    rows = [(f"R{i:03d}", f"jo{i % 7}hn", "smith", f"johnny{i}@x.org", "", "", "") for i in range(130)]
    n = identity.add_normalised_fields(spark.createDataFrame(rows, f"{identity.RECORD} string, first_name string, last_name string, email string, phone string, address string, postcode string"))
    assert [tuple(r) for r in identity.dropped_blocks(n).collect()] == [("EM", 1, 130)]
    assert identity.candidate_pairs(n).count() == 0
    assert identity.candidate_pairs(n, None).count() == 130 * 129 // 2


def test_names_and_samples(spark: SparkSession) -> None:
    df = spark.createDataFrame([(1, 2, 3)], ["Click & Collect", "click collect", "Net Sales ($)"])
    assert views.slugged(df).columns == ["click_collect", "click_collect_2", "net_sales"]
    people = spark.range(50).select(F.col("id").alias(ID), F.lit("g").alias("g"))
    assert views.uniform_sample(people, 7).count() == 7 and views.uniform_sample(people, 99).count() == 50
    assert views.stratified_sample(people, "g", 10).count() == 10


def test_streams_give_what_a_pass_gives(spark: SparkSession, small: str) -> None:
    queries = catalog.QUERIES
    assert queries["distinct_events_stream"](spark, small).count() == spark.read.parquet(f"{small}/events.parquet").select("event_id").distinct().count()
    moved = queries["movement_stream"](spark, small)
    whole = queries["movement_events"](spark, small)
    kinds = lambda df: {tuple(r) for r in df.where("event_type <> 'Lapsed'").select(ID, "event_type", "event_date").collect()}
    assert kinds(moved) == kinds(whole) and len(kinds(whole)) > 100


def test_a_cluster_without_a_shared_folder_is_refused() -> None:
    from types import SimpleNamespace

    from tidemark.sources import storage

    nothing = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: nothing)))
    with pytest.raises(RuntimeError):
        storage.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))
