"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source with weight w (integer units of a period of A slots) gets for its j-th block a release
slot floor((j - 1) A / w) and a deadline ceil(j A / w). Earliest-deadline-first over the released
blocks gives each source its share of every prefix of slots to within one block. Weights are whole
units, so the schedule repeats after A slots: one period is computed, as one expression over the
bounded weight table, and block j of a source lies in period (j - 1) div w.

A source that runs out leaves its slots empty and the others move up, so no document is dropped
or repeated; the one-block bound holds up to the first slot that a finished source leaves empty.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import stored

#: Rows that one bucket of a source is to hold; buckets are the leading hex digits of the order's digest.
BUCKET_ROWS = 50_000


def source_key(column: str = "source") -> Column:
    """A key for each source; a null source is one of its own."""
    return F.when(F.col(column).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(column).cast("string")))


def temperature_weights(docs: DataFrame, *, exponent: float = 0.5, period: int = 400) -> DataFrame:
    """(source_key, units): units of the period in proportion to documents ** exponent, at least one each."""
    sizes = docs.select(source_key().alias("source_key")).groupBy("source_key").agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # a row for each source
    share = F.pow(F.col("n").cast("double"), F.lit(exponent))
    return sizes.select("source_key", F.greatest(F.lit(1), F.round(period * share / F.sum(share).over(every)).cast("long")).cast("long").alias("units"))


def pfair_period(weights: DataFrame) -> DataFrame:
    """One period of the schedule from (source_key, units): rows (source_key, nth, slot, units, period).

    Ties of deadlines go to the smaller key. Sources without units are left out. Bounded by the
    sum of the units, whatever the corpus holds.
    """
    one = weights.where(F.col("units") > 0).agg(F.sort_array(F.collect_list(F.struct("source_key", F.col("units").cast("long").alias("units")))).alias("w"))
    one = one.withColumn("period", F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x.units)).where("period > 0")
    # state: blocks given so far by source, and the source of each slot
    start = F.struct(F.transform("w", lambda x: F.lit(0).cast("long")).alias("given"), F.array().cast("array<int>").alias("order"))

    def step(state: Column, slot: Column) -> Column:
        deadlines = F.transform(
            F.sequence(F.lit(0), F.size("w") - 1),
            lambda i: F.when(
                F.floor(state.given[i] * F.col("period") / F.col("w")[i].units) <= slot,
                F.struct(F.ceil((state.given[i] + 1) * F.col("period") / F.col("w")[i].units).alias("deadline"), i.alias("i")),
            ),
        )
        # a lambda of one element names the pick once
        picked = F.transform(
            F.array(F.array_min(deadlines).i),
            lambda p: F.struct(
                F.transform(state.given, lambda g, i: F.when(i == p, g + 1).otherwise(g)).alias("given"),
                F.concat(state.order, F.array(p)).alias("order"),
            ),
        )
        return picked[0]

    turns = F.when(F.col("period") > 0, F.sequence(F.lit(0).cast("long"), F.greatest(F.col("period") - 1, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    run = one.select("w", "period", F.aggregate(turns, start, step).alias("run"))
    slots = run.select("w", "period", F.posexplode("run.order").alias("slot", "i"))
    nth = F.row_number().over(Window.partitionBy("i").orderBy("slot")) - 1
    return slots.select(F.col("w")[F.col("i")].source_key.alias("source_key"), nth.cast("long").alias("nth"), F.col("slot").cast("long").alias("slot"), F.col("w")[F.col("i")].units.alias("units"), "period")


def text_digest(column: str = "text") -> Column:
    """The md5 of a text; a null text counts as the empty one."""
    return F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def mix(docs: DataFrame, weights: DataFrame, *, block_docs: int = 16, with_text: bool = True, digest: str | None = None) -> DataFrame:
    """Add block, slot and mix_key columns; ordering by (slot, place) is the mixed corpus.

    Within a source documents come in a fixed pseudo-random order (md5 of the id and the text's md5),
    cut into blocks of block_docs. Documents of a source without a weight come after all others. A
    null id or text hashes as the empty one; only rows equal in both tie, and may change places.
    Ranks come from buckets of each source, as many as the table's size asks for, and a sum over
    bucket sizes, so a source that holds most rows is spread. Columns added: mix_source, block, place
    (in the block), slot. Clashing names of the input are replaced in the result. Without with_text
    the texts are hashed where they are read and go no further; with `digest`, a column that holds
    text_digest already, docs needs no text at all.
    """
    own = ["mix_source", "block", "place", "slot"]
    base = docs.drop(*own)
    names = [c for c in base.columns if with_text or c != "text"]
    digits, left = 2, docs.count() // BUCKET_ROWS
    while left >= 256:
        digits, left = digits + 1, left // 16
    text = F.col(digest) if digest else text_digest()
    order = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).cast("binary"))
    keyed = base.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), source_key().alias("mix_source"), order.alias("_order"), F.substring(order, 1, digits).alias("_bucket"))  # no name of the input meets one of ours
    sizes = keyed.groupBy("mix_source", "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("mix_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    sizes = sizes.select("mix_source", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("mix_source", "_bucket").orderBy("_order")
    ranked = keyed.withColumn("_rank", F.row_number().over(within) - 1).join(sizes, ["mix_source", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    ranked = ranked.withColumns({"block": F.floor(F.col("_rank") / block_docs).cast("long"), "place": F.pmod("_rank", F.lit(block_docs)).cast("long")})
    # a stored table of one row for each slot of the period: Spark broadcasts it if its size allows
    period = stored(pfair_period(weights), "period").select(F.col("source_key").alias("mix_source"), F.col("nth").alias("_nth"), F.col("slot").alias("_slot"), "units", "period")
    units = period.where("_nth = 0").select("mix_source", "units", "period")
    turned = ranked.join(units, "mix_source", "left").withColumn("_nth", F.pmod("block", F.col("units")))
    placed = turned.join(period.select("mix_source", "_nth", "_slot"), ["mix_source", "_nth"], "left")
    slot = F.floor(F.col("block") / F.col("units")) * F.col("period") + F.col("_slot")
    return placed.withColumn("slot", F.coalesce(slot, F.lit((1 << 62)) + F.col("block")).cast("long")).select("_doc.*", *own)


def mixed_order(docs: DataFrame, weights: DataFrame, *, block_docs: int = 16) -> DataFrame:
    """The documents themselves, sorted into the mixed order; no row is dropped."""
    placed = mix(docs, weights, block_docs=block_docs)
    return placed.orderBy("slot", "mix_source", "place").select(*docs.columns)


def file_places(docs: DataFrame, *columns: str) -> DataFrame | None:
    """The columns, and each row's file and row in it; None where docs have no such places, as they are not read from Parquet.

    Reading keeps no order of rows, but each still knows its place in the files, so a written mixed_order is not lost.
    """
    try:
        read = docs.metadataColumn("_metadata")  # also where docs have a column of that name
        return docs.select(*columns, read["file_path"].alias("file"), read["row_index"].alias("row"))
    except AnalysisException:
        return None


def in_file_order(placed: DataFrame) -> DataFrame:
    """Put `at`, the place in all files together, in the place of file and row; rows of one place stay together.

    Spark numbers the files of a sorted table by its partitions. Rows before a file are summed over the files,
    a row each, which Spark broadcasts if their table's size allows. `placed` is read twice, so pass a stored table.
    """
    number = F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).try_cast("long")
    earlier = Window.partitionBy().orderBy(number, F.length("file"), "file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = placed.groupBy("file").agg((F.max("row") + 1).alias("_n"))
    starts = stored(files.select("file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).cast("long").alias("_start")), "file-starts")
    return placed.join(starts, "file").withColumn("at", F.col("_start") + F.col("row")).drop("file", "row", "_start")
