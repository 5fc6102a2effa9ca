"""Readers and writers of files, small tables and spines, and the checks on what is read."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_parquet(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """A Parquet table; columns and filters are pushed into the scan by what is selected from it."""
    return require_columns(spark.read.parquet(path), required, path)


def read_optional(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A Parquet table, or an empty one of the schema where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return empty_table(spark, schema)


def empty_table(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path) if partition_by else df.write.mode("overwrite").parquet(path)


def export_csv(df: DataFrame, path: str, *, one_file: bool = False) -> None:
    """CSV with a header; one_file is for small reports only."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(spark: SparkSession, value: Mapping[str, Any], path: str) -> None:
    """One JSON document, such as a model's metadata, through Spark's writer, so that any store will do."""
    spark.createDataFrame([(json.dumps(value, default=str, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict[str, Any]:
    row = spark.read.text(path, wholetext=True).where(F.col("value") != "").head()
    return json.loads(row.value) if row else {}


def from_rows(spark: SparkSession, rows: Sequence[Any], schema: T.StructType | str) -> DataFrame:
    """A small table from rows in memory."""
    return spark.createDataFrame(list(rows), schema)


def month_spine(spark: SparkSession, start: dt.date | str, end: dt.date | str) -> DataFrame:
    """The first day of every month from start to end."""
    first = lambda d: F.trunc(F.lit(d).cast("date"), "MM")
    return spark.range(1).select(F.explode(F.sequence(first(start), first(end), F.expr("interval 1 month"))).alias("month"))


def integer_spine(last: Column) -> Column:
    """0, 1, .. last of each row, as rows."""
    return F.explode(F.sequence(F.lit(0), last))


def first_present(df: DataFrame, names: Sequence[str]) -> str | None:
    """The first of several names that the table has."""
    return next((n for n in names if n in df.columns), None)


def require_columns(df: DataFrame, names: Sequence[str], what: str = "table") -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {missing}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; none in a valid table."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def require_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    if duplicate_keys(df, keys).take(1):
        raise ValueError(f"{what} repeats {list(keys)}")
    return df


def once_each(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    """The same rows, without those of null keys; one that repeats the keys fails the job that reads it.

    The rows are grouped by the keys on the way, which deals them as a join by the keys needs them: no job of its own.
    """
    others = [c for c in df.columns if c not in keys]
    row = F.first(F.struct(*others)) if others else F.lit(None)
    grouped = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("_n"), row.alias("_row"))
    checked = grouped.where(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{what} repeats {list(keys)}")).isNull()).otherwise(True))
    return checked.select(*[F.col(f"_row.`{c}`").alias(c) if c in others else F.col(c) for c in df.columns])


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """A join in which a repeated key of the right side (one_to_one: of either side) fails the job, found in the join's own pass."""
    if validate not in ("many_to_one", "one_to_one"):
        raise ValueError(f"no validation {validate!r}")
    if validate == "one_to_one":
        left = once_each(left, on, "left side")
    return left.join(once_each(right, on, "right side"), list(on), how)
