"""Exact quantiles of groups of any size: no task sorts or holds a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.storage import Scratch

#: Values of one group and measure that a task may rank at the end; more are narrowed first.
GATHERED = 100_000
#: Parts into which a sketch divides the values that are still open, and its accuracy.
PARTS, ACCURACY = 256, 10_000


def _with_state(rows: DataFrame, state: DataFrame, group: list[str]) -> DataFrame:
    """Each row with the state of its group, by equal keys (null is a key), where its value lies between lo and hi."""
    named = state.select(*[F.col(g).alias(f"_s{i}") for i, g in enumerate(group)], *[c for c in state.columns if c not in group])
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_s{i}")) for i, g in enumerate(group)])
    return rows.join(named, same & (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))).drop(*[f"_s{i}" for i in range(len(group))])


def _narrowed(rows: DataFrame, state: DataFrame, group: list[str], scratch: Scratch) -> DataFrame:
    """The state of open groups after one more division: a sketch offers two values near the rank, and exact counts
    below, at, between and above them tell in which of these five parts the two ranks fall.

    A part of one value, or ranks that end one part and start the next, settle the values. One of the
    two values is in no other part, so every division leaves fewer values, whatever the sketch says.
    """
    kept = [c for c in state.columns if c not in group]
    near = F.least(F.lit(PARTS - 1), F.floor((F.col("_r1") - F.col("_before")) * PARTS / F.col("_inside"))).cast("int")
    sketch = _with_state(rows, state, group).groupBy(*group, *kept).agg(F.percentile_approx("_v", [i / PARTS for i in range(PARTS + 1)], ACCURACY).alias("_e"))
    cuts = scratch.stored(sketch.withColumns({"_e1": F.get("_e", near), "_e2": F.get("_e", near + 1)}).drop("_e"), "cuts")
    v, e1, e2 = F.col("_v"), F.col("_e1"), F.col("_e2")
    part = F.when(v < e1, 0).when(v == e1, 1).when(v < e2, 2).when(v == e2, 3).otherwise(4)
    parts = _with_state(rows, cuts, group).groupBy(*group, "_r1", "_r2", "_before", "_weight", part.alias("_part")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    earlier = F.coalesce(F.sum("_c").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # five rows a group
    parts = parts.withColumn("_start", F.col("_before") + earlier)
    holds = lambda r: (F.col("_start") <= F.col(r)) & (F.col(r) < F.col("_start") + F.col("_c"))
    here = F.struct("_part", "_lo", "_hi", "_start", "_c")
    both = parts.groupBy(*group, "_r1", "_r2", "_weight").agg(F.max(F.when(holds("_r1"), here)).alias("_a"), F.max(F.when(holds("_r2"), here)).alias("_b"))
    split = F.col("_a._part") != F.col("_b._part")
    return both.select(*group, F.col("_a._lo").alias("_lo"), F.col("_a._hi").alias("_hi"), F.col("_a._start").alias("_before"), F.col("_a._c").alias("_inside"), "_r1", "_r2", "_weight", F.when(split, F.col("_a._hi")).alias("_v1"), F.when(split, F.col("_b._lo")).alias("_v2"))


def group_quantiles(df: DataFrame, keys: list[str], measures: dict[str, str], q: float = 0.5, *, gathered: int = GATHERED) -> DataFrame:
    """(keys, names): for each name: column of `measures` the exact quantile of its values, between two ranks linearly.

    Nulls are no values; a name is null in a group without values, and a group without any is left
    out. Not-a-number counts as the largest value; a null key is a group of its own. Each pass
    counts values by ranges around the rank, with partial counts where rows are read, and keeps the
    range in which the rank falls, until at most `gathered` values are left to rank, whatever the
    size of a group, its ties or its outliers.
    """
    scratch, group = Scratch(df.sparkSession, "quantiles"), [*keys, "_m"]
    values = F.array(*[F.struct(F.lit(i).alias("_m"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(measures.values())])
    rows = df.select(*keys, F.explode(values).alias("_x")).select(*keys, "_x._m", "_x._v").where("_v is not null")
    at = (F.col("_n") - 1) * F.lit(q)
    nothing = F.lit(None).cast("double")
    state = rows.groupBy(*group).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    state = state.select(*group, "_lo", "_hi", F.lit(0).cast("long").alias("_before"), F.col("_n").alias("_inside"), F.floor(at).alias("_r1"), F.ceil(at).alias("_r2"), (at - F.floor(at)).alias("_weight"), nothing.alias("_v1"), nothing.alias("_v2"))
    unknown = F.col("_v1").isNull() & (F.col("_lo") != F.col("_hi"))
    still = unknown & (F.col("_inside") > gathered)
    state = scratch.stored(state, "state")
    while state.where(still).limit(1).count():
        state = scratch.stored(state.where(~still).unionByName(_narrowed(rows, state.where(still), group, scratch)), "state")
    counted = _with_state(rows, state.where(unknown), group).groupBy(*group, "_before", "_r1", "_r2", "_weight", "_v").agg(F.count("*").alias("_c"))
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*group).orderBy("_v"))  # at most `gathered` values
    least = lambda r: F.min(F.when(F.col("_upto") > F.col(r), F.col("_v")))
    ranked = counted.withColumn("_upto", upto).groupBy(*group, "_weight").agg(least("_r1").alias("_v1"), least("_r2").alias("_v2"))
    known = state.where(~unknown).select(*group, "_weight", F.coalesce("_v1", "_lo").alias("_v1"), F.coalesce("_v2", "_lo").alias("_v2"))
    v1, v2 = F.col("_v1"), F.col("_v2")
    every = ranked.unionByName(known).withColumn("_q", F.when(v1 == v2, v1).otherwise(v1 + (v2 - v1) * F.col("_weight")))
    return every.groupBy(*keys).agg(*[F.max(F.when(F.col("_m") == i, F.col("_q"))).alias(name) for i, name in enumerate(measures)])


def with_quantiles(grouped: DataFrame, df: DataFrame, keys: list[str], measures: dict[str, str], q: float = 0.5) -> DataFrame:
    """A table with a row for each group of df, with group_quantiles of these groups beside it."""
    found = group_quantiles(df, keys, measures, q)
    found = found.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *measures)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return grouped.join(found, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])
