"""Connected components of a large edge table by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.storage import Scratch, stored


def connected_components(edges: DataFrame, *, most_rounds: int = 100) -> DataFrame:
    """(id, component) for every end of the edges (a, b); component is the smallest id reachable.

    Each round takes the least label among a vertex and its neighbours, then follows that label's
    own label; rounds end when no label changes, after about the logarithm of the longest path.
    Labels and edges are stored tables, so joins read plain exchanges that skew handling can split;
    those of earlier rounds are removed.
    """
    spark = edges.sparkSession
    fixed, last = Scratch(spark, "edges"), Scratch(spark, "labels")
    both = fixed.stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = last.stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        now = Scratch(spark, "labels")
        nearest = now.stored(labels.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component")), "labels")
        hop = nearest.select(F.col("id").alias("component"), F.col("component").alias("further"))
        moved = now.stored(nearest.join(hop, "component", "left").select("id", "old", F.coalesce("further", "component").alias("component")), "labels")
        last.drop()
        labels, last = moved.select("id", "component"), now
        if moved.where("old <> component").limit(1).count() == 0:
            labels = stored(labels, "components")
            last.drop()
            fixed.drop()
            return labels
    raise RuntimeError("components did not settle")
