"""Ranks and shares over customer-level tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.storage import stored


def running_sums(values: DataFrame, key: str, sums: list[str], by: Sequence[str] = ()) -> DataFrame:
    """Add {c}_below (the sum of c over smaller keys) and {c}_total for each c; key is unique and not null, in each group of `by` where given.

    Rows are dealt by ranges of the key and written, so that the ranges stay the same for both
    readings; only one row for each range (and group) is summed in one task.
    """
    ranged = stored(values.repartitionByRange(*by, key).withColumn("_part", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy("_part", *by).agg(*[F.sum(c).alias(c) for c in sums])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = parts.select("_part", *by, *[x for c in sums for x in (F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}_before"), F.sum(c).over(Window.partitionBy(*by)).alias(f"{c}_total"))])
    inside = Window.partitionBy("_part", *by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(parts), ["_part", *by])
    return placed.select(*values.columns, *[x for c in sums for x in ((F.col(f"_{c}_before") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_below"), F.col(f"{c}_total"))])


def value_positions(df: DataFrame, value: str, out: str, source: DataFrame | None = None) -> DataFrame:
    """Add {out}_below (rows with a smaller value), {out}_ties and {out}_n, by joining counts of distinct values.

    Only the table of distinct values is sorted, and rows themselves are never gathered in one task;
    null values get null. source is the table the values come from where df already has added
    columns, so that chained calls don't each read all that came before.
    """
    counts = (df if source is None else source).where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_t"))
    placed = running_sums(counts, "_v", ["_t"]).select("_v", F.col("_t").alias(f"{out}_ties"), F.col("_t_total").alias(f"{out}_n"), F.col("_t_below").alias(f"{out}_below"))
    return df.join(placed, F.col(value) == F.col("_v"), "left").drop("_v")


def pct_rank_average(df: DataFrame, value: str, out: str, source: DataFrame | None = None) -> DataFrame:
    """Add the fractional rank: average rank among ties over the number of values."""
    placed = value_positions(df, value, "_p", source)
    return placed.withColumn(out, (F.col("_p_below") + (F.col("_p_ties") + 1) / 2) / F.col("_p_n")).drop("_p_below", "_p_ties", "_p_n")


def positions(df: DataFrame, order: list[Column], key: str, by: Sequence[str] = (), beside: Sequence[str] = ()) -> DataFrame:
    """(key, _rank from 1, _n): the place of each row in a total order, without a sort or a tied value in one task.

    Rows are dealt by ranges of the whole order and written, so a value that many rows share is split
    by what follows it; only one row for each range is summed in one task. key is unique. With `by`,
    places in each group, whose columns stand first; `beside` names columns that stay beside the key.
    """
    named = df.select(*by, F.col(key), *beside, *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    o = [F.col(f"_o{i}") for i in range(len(order))]
    ranged = stored(named.repartitionByRange(*by, *o).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = ranged.groupBy("_part", *by).agg(F.count("*").alias("_c")).select("_part", *by, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy(*by)).alias("_n"))
    inside = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*o))
    return ranged.join(F.broadcast(parts), ["_part", *by]).select(*by, key, *beside, (F.col("_before") + inside).alias("_rank"), "_n")


def quintile_first(df: DataFrame, value: str, key: str, out: str, source: DataFrame | None = None) -> DataFrame:
    """Add quintiles 1..5 of the rank in which ties follow the key; null values stay null."""
    placed = positions((df if source is None else source).where(F.col(value).isNotNull()), [F.col(value), F.col(key)], key)
    quintile = F.when(F.col("_n") == 1, 1).otherwise(F.greatest(F.lit(1), F.ceil(5 * (F.col("_rank") - 1) / (F.col("_n") - 1))))
    return df.join(placed.select(key, quintile.cast("int").alias(out)), key, "left")


def _measures(df: DataFrame, measures: dict[str, str], key: str) -> DataFrame:
    """(key, _m, _v): a row for each measure (by number) that is not null; numbers are compared as doubles."""
    values = F.array(*[F.struct(F.lit(i).alias("_m"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(measures.values())])
    return df.select(key, F.explode(values).alias("_x")).select(key, "_x._m", "_x._v").where("_v is not null")


def _dealt(rows: DataFrame, *order: str, total: Column) -> tuple[DataFrame, DataFrame]:
    """Rows dealt by ranges of measure and order and written, and what lies before each range: one deal for all measures."""
    ranged = stored(rows.repartitionByRange("_m", *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("_m").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = ranged.groupBy("_part", "_m").agg(total.alias("_c"))
    return ranged, parts.select("_part", "_m", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy("_m")).alias("_n"))


def _spread(placed: DataFrame, measures: dict[str, str], value: Column, key: str) -> DataFrame:
    """One row for each key with the value of each measure."""
    return placed.groupBy(key).agg(*[F.max(F.when(F.col("_m") == i, value)).alias(out) for i, out in enumerate(measures)])


def quintiles_first(df: DataFrame, measures: dict[str, str], key: str) -> DataFrame:
    """(key, quintiles): for each name: column of `measures` what quintile_first gives, from one deal of all of them."""
    ranged, parts = _dealt(_measures(df, measures, key), "_v", key, total=F.count("*"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_part", "_m").orderBy("_v", key))
    placed = ranged.join(parts, ["_part", "_m"]).withColumn("_rank", rank)
    return _spread(placed, measures, qcut_labels(F.col("_rank"), F.col("_n"), 5), key)


def pct_ranks_average(df: DataFrame, measures: dict[str, str], key: str) -> DataFrame:
    """(key, fractional ranks): for each name: column of `measures` what pct_rank_average gives, from one deal of all their distinct values."""
    rows = _measures(df, measures, key)
    ranged, parts = _dealt(rows.groupBy("_m", "_v").agg(F.count("*").alias("_t")), "_v", total=F.sum("_t"))
    inside = F.coalesce(F.sum("_t").over(Window.partitionBy("_part", "_m").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.join(parts, ["_part", "_m"]).select("_m", "_v", ((F.col("_before") + inside + (F.col("_t") + 1) / 2) / F.col("_n")).alias("_pct"))
    return _spread(rows.join(placed, ["_m", "_v"]), measures, F.col("_pct"), key)


def qcut_labels(rank: Column, n: Column, size: int) -> Column:
    """Bin 1..size of rank 1..n with the edges of linear quantiles of the ranks; a value on an edge belongs to the lower bin."""
    return F.when(n == 1, 1).otherwise(F.greatest(F.lit(1), F.ceil(size * (rank - 1) / (n - 1)))).cast("int")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def share_of_total(value: Column, keys: list[str]) -> Column:
    return value / F.sum(value).over(Window.partitionBy(*keys))
