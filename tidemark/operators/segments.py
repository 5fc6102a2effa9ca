"""Behavioural segments by k-means on customer features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.quantiles import group_quantiles
from tidemark.functions.scalars import safe_divide
from tidemark.operators.cadence import cadence_features
from tidemark.sources.storage import stored

ID = "golden_customer_id"
FEATURES = ["orders", "avg_order_value", "units_per_order", "avg_margin_per_order", "avg_discount_pct", "discounted_order_share", "store_share", "online_share", "click_collect_share", "channels_used", "categories_used", "category_concentration", "dominant_category_share", "median_purchase_gap_days", "cadence_cv"]
LOGGED = ["orders", "avg_order_value", "units_per_order", "avg_margin_per_order"]
# Segment names with the feature whose largest centre they take, in order.
NAMES = [("avg_order_value", "Big Ticket Shoppers"), ("orders", "High Frequency Generalists"), ("discounted_order_share", "Promotion-Led Shoppers"), ("dominant_category_share", "Category Specialists"), ("store_share", "Store-Led Shoppers"), (None, "Omnichannel Mainstream")]


def clustering_features(tx: DataFrame) -> DataFrame:
    """Fifteen behaviour features of each customer with orders."""
    share = lambda c: F.avg((F.col("channel") == c).cast("int"))
    base = tx.groupBy(ID).agg(
        F.countDistinct("order_id").alias("orders"),
        F.avg("net_sales").alias("avg_order_value"),
        F.avg("units").alias("units_per_order"),
        F.avg("gross_margin").alias("avg_margin_per_order"),
        F.avg("discount_pct").alias("avg_discount_pct"),
        F.avg((F.col("discount_pct") > 0).cast("int")).alias("discounted_order_share"),
        share("Store").alias("store_share"),
        share("Online").alias("online_share"),
        share("Click & Collect").alias("click_collect_share"),
        F.countDistinct("channel").alias("channels_used"),
        F.countDistinct("category").alias("categories_used"),
    )
    cats = tx.groupBy(ID, "category").agg(F.countDistinct("order_id").alias("n")).groupBy(ID)
    cats = cats.agg(safe_divide(F.sum(F.col("n") * F.col("n")), F.sum("n") * F.sum("n")).alias("category_concentration"), (F.max("n") / F.sum("n")).alias("dominant_category_share"))
    return base.join(cats, ID).join(cadence_features(tx).select(ID, "median_purchase_gap_days", "cadence_cv"), ID, "left")


def prepared(features: DataFrame) -> DataFrame:
    """log1p of four columns, exact medians for missing values, then zero mean and unit population deviation."""
    x = features.select(ID, *[(F.log1p(c) if c in LOGGED else F.col(c).cast("double")).alias(c) for c in FEATURES])
    med = group_quantiles(x, [], {f"_m_{c}": c for c in FEATURES})
    x = x.crossJoin(F.broadcast(med)).select(ID, *[F.coalesce(F.col(c), F.col(f"_m_{c}")).alias(c) for c in FEATURES])  # one row
    stats = x.agg(*[s for c in FEATURES for s in (F.avg(c).alias(f"_a_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    z = x.crossJoin(F.broadcast(stats))  # one row
    return z.select(ID, *[F.coalesce(F.try_divide(F.col(c) - F.col(f"_a_{c}"), F.col(f"_s_{c}")), F.lit(0.0)).alias(c) for c in FEATURES])


def _sample(z: DataFrame, rows: int, seed: int) -> DataFrame:
    """The rows whose keys hash lowest: the same ones in every run."""
    return z.orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(ID).cast("string")).cast("binary")), ID).limit(rows)


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in FEATURES])


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def spread_starts(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the points: each next one drawn in proportion to its squared distance from those drawn (the best of a few draws)."""
    rng = np.random.default_rng(seed)
    chosen = [points[rng.integers(len(points))]]
    near = _squares(points, np.array(chosen))[:, 0]
    while len(chosen) < k:
        total = near.sum()
        tries = rng.choice(len(points), 2 + int(np.log(k)), p=near / total if total > 0 else None)
        left = np.minimum(near[:, None], _squares(points, points[tries]))
        best = int(left.sum(0).argmin())
        chosen.append(points[tries[best]])
        near = left[:, best]
    return np.array(chosen)


_SUMS = "run int, cluster int, n long, cost double, " + ", ".join(f"s{i} double" for i in range(len(FEATURES)))


def _pass(z: DataFrame, runs: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """(rows by cluster, sums by cluster, cost) of every run, from one reading of all rows; what comes back has a row for each centre."""
    names = list(runs)
    ends = np.cumsum([len(runs[r]) for r in names])
    shared = z.sparkSession.sparkContext.broadcast(np.concatenate([runs[r] for r in names]))  # the centres alone

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        n, cost, total = np.zeros(len(centres), np.int64), np.zeros(len(centres)), np.zeros(centres.shape)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                x = _columns(batch.slice(at, 2048))
                far = _squares(x, centres)
                for a, b in zip([0, *ends], ends, strict=False):
                    own = far[:, a:b].argmin(1)
                    one = np.zeros((len(x), b - a))
                    one[np.arange(len(x)), own] = 1
                    n[a:b] += one.sum(0).astype(np.int64)
                    cost[a:b] += (far[:, a:b] * one).sum(0)
                    total[a:b] += one.T @ x
        run = np.repeat(names, np.diff([0, *ends]))
        which = np.concatenate([np.arange(len(runs[r])) for r in names])
        yield pa.RecordBatch.from_arrays([pa.array(run, pa.int32()), pa.array(which, pa.int32()), pa.array(n), pa.array(cost), *[pa.array(c) for c in total.T.copy()]], names=[c.split(" ")[0] for c in _SUMS.split(", ")])

    rows = z.select(*FEATURES).mapInArrow(sums, _SUMS).groupBy("run", "cluster").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(FEATURES))]).collect()
    out = {r: (np.zeros(len(c), np.int64), np.zeros(c.shape), 0.0) for r, c in runs.items()}
    for row in rows:
        n, total, cost = out[row.run]
        n[row.cluster], total[row.cluster] = row.n, [row[f"s{i}"] for i in range(len(FEATURES))]
        out[row.run] = (n, total, cost + row.cost)
    return out


def many_starts(z: DataFrame, ks: Sequence[int], starts: int, seed: int, *, most_steps: int = 300, tolerance: float = 1e-4, sample_rows: int = 10_000) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """For each k the centres, cluster sizes and cost of the best of `starts` k-means runs over all rows.

    All runs of all k advance together, one reading of the table for each step; a run that has
    settled (its centres' squared movement is within `tolerance`) rests. First centres are drawn from
    sample_rows rows. An empty cluster keeps its centre.
    """
    points = _columns(_sample(z, sample_rows, seed).select(*FEATURES).toArrow().combine_chunks().to_batches()[0])
    runs = {(k, i): spread_starts(points, min(k, len(points)), seed + 1000 * k + i) for k in ks for i in range(starts)}
    moving = {j: c for j, c in enumerate(runs.values())}
    centres = dict(moving)
    for _ in range(most_steps):
        if not moving:
            break
        for j, (n, total, _) in _pass(z, moving).items():
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres[j])
            if ((new - centres[j]) ** 2).sum() <= tolerance:
                moving.pop(j)
            else:
                moving[j] = new
            centres[j] = new
    last = _pass(z, centres)
    best: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}
    for j, (k, _) in enumerate(runs):
        if k not in best or last[j][2] < best[k][2]:
            best[k] = (centres[j], last[j][0], last[j][2])
    return best


def silhouettes(z: DataFrame, centres: dict[int, np.ndarray], *, sample_rows: int = 10_000, seed: int = 42) -> dict[int, float]:
    """Mean Euclidean silhouette of each clustering over a sample of rows, each compared with the whole sample; a cluster of one row counts 0."""
    few = stored(_sample(z, sample_rows, seed).select(*FEATURES), "sample")
    points = _columns(few.toArrow().combine_chunks().to_batches()[0])
    labels = {k: _squares(points, c).argmin(1) for k, c in centres.items()}
    shared = z.sparkSession.sparkContext.broadcast((points, labels))  # sample_rows rows

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                x = _columns(batch.slice(at, 256))
                far = np.sqrt(_squares(x, every))
                total = []
                for k, c in centres.items():
                    one = np.eye(len(c))[own[k]]
                    size, mine = one.sum(0), _squares(x, c).argmin(1)
                    sums, rows = far @ one, np.arange(len(x))
                    inside = sums[rows, mine] / np.maximum(size[mine] - 1, 1)
                    mean = np.where(size > 0, sums / np.maximum(size, 1), np.inf)
                    mean[rows, mine] = np.inf
                    outside = mean.min(1)
                    total.append(float(np.where((size[mine] > 1) & np.isfinite(outside), (outside - inside) / np.maximum(np.maximum(outside, inside), 1e-300), 0).sum()))
                yield pa.RecordBatch.from_arrays([pa.array(list(centres), pa.int32()), pa.array(total, pa.float64())], names=["k", "s"])

    spread = few.repartition(max(1, -(-len(points) // 512)))
    return {r.k: r.s / len(points) for r in spread.mapInArrow(compare, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()}


def evaluate_clusters(features: DataFrame, ks: range = range(3, 10), seed: int = 42, *, starts: int = 20) -> DataFrame:
    """Silhouette (Euclidean, of a sample of 10,000 rows), cost and cluster sizes for each k, of the best of `starts` runs over all rows."""
    z = stored(prepared(features), "prepared")
    schema = "k int, silhouette double, inertia double, smallest_cluster long, largest_cluster long, smallest_cluster_pct double, largest_cluster_pct double"
    if not z.take(1):
        return features.sparkSession.createDataFrame([], schema)
    best = many_starts(z, ks, starts, seed)
    score = silhouettes(z, {k: c for k, (c, _, _) in best.items()}, seed=seed)
    rows = [(k, score[k], cost, int(n.min()), int(n.max()), float(n.min() / n.sum()), float(n.max() / n.sum())) for k, (_, n, cost) in best.items()]
    return features.sparkSession.createDataFrame(rows, schema)


def choose_k(evaluation: DataFrame) -> DataFrame:
    """The k with the best silhouette among those whose smallest cluster holds 3 percent, or among all."""
    fits = F.max(F.when(F.col("smallest_cluster_pct") >= 0.03, F.struct("silhouette", F.col("k").alias("kk"))))
    return evaluation.agg(F.coalesce(fits, F.max(F.struct("silhouette", F.col("k").alias("kk")))).kk.alias("k"))


def principal_axes(z: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(two axes as rows, their shares of the variance); of each axis the largest loading is positive."""
    model = PCA(k=2, inputCol="vector", outputCol="pca").fit(VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(z))
    axes = model.pc.toArray().T
    axes = axes * np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(1)] < 0, -1, 1)[:, None]
    return axes, model.explainedVariance.toArray()


def customer_clusters(features: DataFrame, *, k: int = 6, starts: int = 30, seed: int = 42) -> DataFrame:
    """Cluster, segment name and two principal coordinates (with the share of variance of each) of every customer, by the best of `starts` runs."""
    z = stored(prepared(features), "prepared")
    if not z.take(1):
        return features.sparkSession.createDataFrame([], f"{ID} long, cluster int, cluster_name string, pca_1 double, pca_2 double, pca_1_share double, pca_2_share double")
    centres = many_starts(z, [k], starts, seed)[k][0]
    names, free = {}, set(range(len(centres)))
    for column, name in NAMES:
        if free:
            at = max(free, key=lambda i: centres[i][FEATURES.index(column)]) if column else min(free)
            names[at] = name
            free.discard(at)
    label = F.create_map(*[F.lit(x) for i, n in names.items() for x in (i, n)])
    far = F.array(*[F.struct(sum(((F.col(f) - float(c[j])) * (F.col(f) - float(c[j])) for j, f in enumerate(FEATURES)), F.lit(0.0)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)])
    axes, shares = principal_axes(z)
    along = [sum((F.col(f) * float(axes[p][j]) for j, f in enumerate(FEATURES)), F.lit(0.0)).alias(f"pca_{p + 1}") for p in range(2)]
    out = z.select(ID, F.array_min(far).i.alias("cluster"), *along)
    return out.select(ID, "cluster", F.coalesce(label[F.col("cluster")], F.lit("Not Yet Clustered")).alias("cluster_name"), "pca_1", "pca_2", *[F.lit(float(x)).alias(f"pca_{p + 1}_share") for p, x in enumerate(shares)])
