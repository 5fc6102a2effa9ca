"""Many-start k-means, silhouettes and principal axes against plain numpy and the library's own k-means."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import segments
from tidemark.plans import catalog


@pytest.fixture(scope="module")
def z(spark: SparkSession, small: str) -> DataFrame:
    return segments.prepared(segments.clustering_features(catalog.tables(spark, small).tx)).cache()


def points_of(z: DataFrame) -> np.ndarray:
    return np.array([list(r) for r in z.select(*segments.FEATURES).collect()])


def test_best_of_many_starts_costs_no_more_than_the_librarys_best_of_three(z: DataFrame) -> None:
    found = segments.many_starts(z, [3, 6], 8, 42)
    points, vectors = points_of(z), VectorAssembler(inputCols=segments.FEATURES, outputCol="vector").transform(z)
    for k, (centres, sizes, cost) in found.items():
        far = ((points[:, None] - centres[None]) ** 2).sum(2)
        assert cost == pytest.approx(far.min(1).sum()) and sizes.tolist() == np.bincount(far.argmin(1), minlength=k).tolist()
        other = min(KMeans(k=k, seed=s, featuresCol="vector").fit(vectors).summary.trainingCost for s in (1, 2, 3))
        assert cost <= 1.01 * other
        # settled: each centre is the mean of its rows
        assert all(np.allclose(points[far.argmin(1) == i].mean(0), c, atol=0.05) for i, c in enumerate(centres))


def test_silhouette_equals_a_plain_one(z: DataFrame) -> None:
    points, centres = points_of(z), points_of(z)[:4]
    own = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    want = []
    for i in range(len(points)):
        same = (own == own[i]) & (np.arange(len(points)) != i)
        a = far[i][same].mean() if same.any() else None
        b = min(far[i][own == c].mean() for c in set(own) - {own[i]})
        want.append(0.0 if a is None else (b - a) / max(a, b))
    assert segments.silhouettes(z, {4: centres})[4] == pytest.approx(np.mean(want), abs=1e-6)


def test_axes_have_a_fixed_sign_and_their_share(z: DataFrame) -> None:
    axes, shares = segments.principal_axes(z)
    values = np.linalg.eigvalsh(np.cov(points_of(z).T))[::-1]
    assert shares == pytest.approx(values[:2] / values.sum())
    assert all(a[np.abs(a).argmax()] > 0 for a in axes)


def test_clusters_are_named_and_whole(spark: SparkSession, small: str) -> None:
    features = segments.clustering_features(catalog.tables(spark, small).tx)
    out = segments.customer_clusters(features, starts=4)
    assert out.count() == features.count() == out.select(segments.ID).distinct().count()
    assert {r.cluster_name for r in out.select("cluster_name").distinct().collect()} == {n for _, n in segments.NAMES}
    table = segments.evaluate_clusters(features, range(3, 5), starts=3)
    assert [r.k for r in table.orderBy("k").collect()] == [3, 4] and table.where("silhouette between -1 and 1 and smallest_cluster > 0").count() == 2
    assert segments.evaluate_clusters(features.limit(0)).count() == segments.customer_clusters(features.limit(0)).count() == 0
