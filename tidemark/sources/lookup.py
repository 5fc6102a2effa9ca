"""Tables laid out for reading the rows of one key: bucketed by it, and sorted by it inside each file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.storage import new_path

#: Rows that one file is to hold, and the most buckets a table has, whatever its size.
FILE_ROWS, MOST_BUCKETS = 1_000_000, 1 << 15


def publish(df: DataFrame, name: str, key: str, *, then: tuple[str, ...] = (), file_rows: int = FILE_ROWS) -> str:
    """Write a table bucketed by key and sorted by key and `then`; its name, as the session's catalog knows it.

    A filter on one key reads one bucket, and of that the row groups whose range holds the key. The
    number of buckets follows the rows. A bucket with more than file_rows rows, as that of a key
    which holds a third of all rows, is dealt to several tasks by a hash of whole rows and becomes
    several files, so no task writes all of a key; how rows are dealt is fixed by the rows, so a
    task that runs again writes the same; rows equal in all columns share a file. A null key has a bucket like any other.
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    rows = df.count()
    buckets = max(1, min(MOST_BUCKETS, -(-rows // file_rows)))
    placed = df.withColumn("_bucket", F.pmod(F.hash(key), F.lit(buckets)))  # the hash by which buckets are made
    sizes = placed.groupBy("_bucket").agg(F.ceil(F.count("*") / file_rows).alias("_files"))
    earlier = F.sum("_files").over(Window.orderBy("_bucket")) - F.col("_files")  # a row for each bucket
    dealt = placed.join(F.broadcast(sizes.withColumn("_first", earlier)), "_bucket")  # MOST_BUCKETS rows at most
    file = (F.col("_first") + F.pmod(F.xxhash64(*df.columns), "_files")).cast("int")
    dealt = dealt.repartitionById(rows // file_rows + buckets, file).select(*df.columns)  # a task writes one file
    dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key, *then).option("path", new_path(spark, name)).saveAsTable(table)
    return table
