"""Lookups of one customer: what they read, and that they agree with the same rows of whole tables."""

from __future__ import annotations

import re
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.operators import views
from tidemark.operators.explorer import Explorer, busiest
from tidemark.plans import catalog
from tidemark.sources.lookup import publish

ID = "golden_customer_id"


def test_a_lookup_opens_the_files_of_one_bucket(spark: SparkSession, small: str) -> None:
    t = catalog.tables(spark, small)
    found = Explorer.of(t.tx, t.features, file_rows=200)
    customer, whole = busiest(t.tx), spark.table(found.transactions)
    assert whole.count() == t.tx.count() and whole.exceptAll(t.tx.select(*whole.columns)).count() == 0
    lookups = lambda: [found.monthly_history(customer), found.gap_series(customer), found.mix(customer, "channel"), found.latest(customer)]
    before = [sorted(map(tuple, df.collect())) for df in lookups()]
    buckets = -(-t.tx.count() // 200)
    mine = spark.range(1).select(F.pmod(F.hash(F.lit(customer).cast("long")), F.lit(buckets))).head()[0]
    other = [f for f in whole.inputFiles() if int(re.search(r"_(\d{5})\.", f).group(1)) != mine]
    assert 0 < len(whole.inputFiles()) - len(other) <= 2 < len(other)
    for f in other:  # a reader that opens any of them fails
        Path(urlparse(f).path).write_bytes(b"no table")
    assert [sorted(map(tuple, df.collect())) for df in lookups()] == before
    with pytest.raises(Exception, match="(?i)parquet|footer|checksum"):
        spark.table(found.transactions).agg(F.sum("net_sales")).collect()


def test_every_customer_is_found_whole(spark: SparkSession, small: str) -> None:
    t = catalog.tables(spark, small)
    found = Explorer.of(t.tx, t.features, file_rows=300)
    want = {(r[ID], r.order_id) for r in views.last_transactions(t.tx, 20).collect()}
    for customer in [r[0] for r in t.tx.select(ID).distinct().orderBy(ID).limit(4).collect()]:
        assert {(customer, r.order_id) for r in found.latest(customer).collect()} == {x for x in want if x[0] == customer}
        assert found.profile(customer).count() == 1
    for df in (found.monthly_history(-1), found.gap_series(-1), found.mix(-1, "category"), found.latest(-1), found.profile(-1)):
        assert df.count() == 0


def test_a_key_with_a_third_of_all_rows_is_written_by_several_tasks(spark: SparkSession) -> None:
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 500 == 1, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    table = spark.table(publish(rows, "hot", "k", file_rows=500))
    assert table.exceptAll(rows).count() == 0 and table.count() == 6000
    sizes = table.where("k = 7").groupBy(F.input_file_name().alias("f")).count().collect()
    assert len(sizes) >= 4 and max(r["count"] for r in sizes) < 600 and sum(r["count"] for r in sizes) == 2001
    assert table.where("k is null").count() == rows.where("k is null").count() > 0
    assert spark.table(publish(rows.limit(0), "none", "k")).count() == 0


def test_evidence_of_one_customer(spark: SparkSession) -> None:
    schema = f"identity_record_id string, {ID} string, source_system string, match_confidence double"
    records = spark.createDataFrame([("a", "G1", "POS", 0.9), ("b", "G1", "Loyalty", 1.0), ("c", "G2", "POS", None)], schema)
    tx = spark.createDataFrame([], f"{ID} string, transaction_date date")
    found = Explorer.of(tx, tx.select(ID), records)
    assert [tuple(r) for r in found.evidence("G1").collect()] == [("G1", 2, "Loyalty | POS", 1.0, 0.9)]
    with pytest.raises(ValueError):
        Explorer.of(tx, tx.select(ID)).evidence("G1")
