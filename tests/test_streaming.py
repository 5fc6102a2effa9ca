"""Streams give the rows that batch gives for the same input."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.operators import growth
from tidemark.sources import canonical
from tidemark.streaming import movement


def test_windowed_counts_and_distinct_events(spark: SparkSession, small: str, tmp_path: Path) -> None:
    events = spark.read.parquet(f"{small}/events.parquet")
    ordered = events.repartitionByRange(3, "ts")
    ordered.write.parquet(f"{tmp_path}/in")
    stream = movement.event_stream(spark, f"{tmp_path}/in")
    table = events.withColumn("ts", F.col("ts").cast("timestamp"))
    for kind in ("tumbling", "sliding", "session"):
        got = movement.run_available(movement.windowed_counts(stream, kind, late="400 days"), kind)
        want = movement.windowed_counts(table, kind)
        last = want.agg(F.max("window_end")).head()[0]
        # windows that the watermark has not passed stay open in a stream
        assert got.count() <= want.count()
        assert got.exceptAll(want).where(F.col("window_end") < F.lit(last - dt.timedelta(days=2))).count() == 0
    again = movement.run_available(movement.distinct_events(stream.unionByName(stream), late="400 days"), "distinct")
    assert again.count() == events.select("event_id").distinct().count()


def test_movement_equals_batch(spark: SparkSession, small: str, tmp_path: Path) -> None:
    tx = canonical.transactions(spark, small).where("golden_customer_id < 40").select("golden_customer_id", "transaction_date").distinct().cache()
    folder = f"{tmp_path}/days"
    for year in range(1995, 2002):
        tx.where(F.year("transaction_date") == year).coalesce(1).write.mode("append").parquet(folder)
    closing = spark.createDataFrame([(movement.MARK, dt.date(2001, 7, 31)), (None, dt.date(2001, 8, 9))], "golden_customer_id long, transaction_date date")
    closing.coalesce(1).write.mode("append").parquet(folder)
    days = spark.readStream.schema(tx.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = movement.run_available(movement.movement_stream(days), "movement")
    want = growth.movement_events(tx).select("golden_customer_id", "event_type", "event_date", "change")
    key = lambda df: sorted(map(tuple, df.select("golden_customer_id", "event_type", "event_date", "change").collect()))
    assert key(got) == key(want)


def test_windows_over_several_batches_with_late_rows(spark: SparkSession, tmp_path: Path) -> None:
    """Sessions go on from batch to batch; rows behind the watermark count no more, rows before it do."""
    at = lambda day, clock: dt.datetime(2024, 1, day, *map(int, clock.split(":")))
    batches = [
        [(1, at(1, "10:00"), 7, "view", 1.0), (2, at(1, "23:50"), 7, "view", 2.0)],
        [(3, at(1, "10:20"), 7, "view", 4.0), (4, at(2, "00:10"), 7, "view", 8.0), (5, at(5, "09:00"), 8, "click", 16.0)],
        [(7, at(4, "12:00"), 8, "click", 64.0), (8, at(9, "00:00"), 9, "view", 0.0)],
        [(6, at(1, "10:25"), 7, "view", 32.0), (9, at(12, "00:00"), 9, "view", 0.0)],
    ]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    for i, rows in enumerate(batches):
        spark.createDataFrame([(*r, None) for r in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    stream = files.withColumn("ts", F.col("ts").cast("timestamp"))
    sessions = movement.run_available(movement.windowed_counts(stream, "session", gap="30 minutes"), "late-sessions")
    told = sorted((r.user_id, str(r.window_start), r.events, r.value) for r in sessions.collect())
    # event 6 comes after the watermark has passed its session; event 7 is a day behind and still in time
    assert told == [(7, "2024-01-01 10:00:00", 2, 5.0), (7, "2024-01-01 23:50:00", 2, 10.0), (8, "2024-01-04 12:00:00", 1, 64.0), (8, "2024-01-05 09:00:00", 1, 16.0), (9, "2024-01-09 00:00:00", 1, 0.0)]
    sliding = movement.run_available(movement.windowed_counts(stream, "sliding", size="1 day", slide="12 hours"), "late-sliding")
    kept = [r for rows in batches for r in rows if r[0] != 6]
    table = spark.createDataFrame([(*r, None) for r in kept], schema).withColumn("ts", F.col("ts").cast("timestamp"))
    want = movement.windowed_counts(table, "sliding", size="1 day", slide="12 hours").where("window_end <= timestamp'2024-01-11 00:00:00'")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(sliding) == key(want)
