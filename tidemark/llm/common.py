"""Helpers that every corpus operator shares: tables, shared folders and partition counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.storage import new_path, shared_dir, stored


__all__ = ["bounded_batches", "new_path", "partitions", "shared_dir", "stored", "table", "text_or_empty", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Arrow batches grow to this many bytes; Spark's own bound is eight times as much for each of several buffers a task.
BATCH_BYTES = 8 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Let no Arrow batch of this session exceed BATCH_BYTES (one row may); a smaller setting stays."""
    now = str(spark.conf.get(_SETTING, "64m")).lower()
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now.rstrip("b")[-1:], 1)
    number = int("".join(c for c in now if c in "-0123456789"))
    if number <= 0 or number * unit > BATCH_BYTES:
        spark.conf.set(_SETTING, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(name: str, columns: list[str]) -> str:
    """The name, lengthened until no column has it."""
    while name in columns:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
