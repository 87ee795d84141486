"""K-means with stacked restarts against plain steps and Spark's own."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector

from threadtide.operators import lloyd, models


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 6)) * 3
    return np.concatenate([c + rng.normal(size=(150, 6)) for c in centres])


@pytest.fixture(scope="module")
def df(spark, points):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "id long, v array<double>").repartition(5).cache()


def test_a_step_is_a_step_of_every_restart(df, points):
    rng = np.random.default_rng(1)
    centres = points[rng.choice(len(points), 9)].reshape(3, 3, 6)
    sums, n, cost = lloyd.step(df.select("v"), centres)
    for r in range(3):
        d = ((points[:, None] - centres[r][None]) ** 2).sum(axis=2)
        best = d.argmin(axis=1)
        assert cost[r] == pytest.approx(d.min(axis=1).sum())
        for c in range(3):
            assert n[r, c] == (best == c).sum()
            assert np.allclose(sums[r, c], points[best == c].sum(axis=0))


def test_cost_is_no_worse_than_sparks(df, points):
    centres, cost, every = lloyd.fit(df, "v", 4, restarts=6)
    data = df.withColumn("f", array_to_vector("v"))
    other = min(KMeans(k=4, seed=42 + i, featuresCol="f").fit(data).summary.trainingCost for i in range(3))
    assert cost <= other * 1.0001 and len(every) == 6 and cost == pytest.approx(every.min())
    own = ((points[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()
    assert cost == pytest.approx(own)
    again, _, _ = lloyd.fit(df.repartition(3), "v", 4, restarts=6)
    assert np.allclose(again, centres)


def test_rows_go_to_the_nearest_centre(df):
    out, centres = models.kmeans_best(df, "v", 2, 3)
    for r in out.collect():
        d = [sum((a - b) ** 2 for a, b in zip(r["v"], c)) for c in centres]
        assert r["cluster"] == d.index(min(d))


def test_fewer_points_than_clusters(spark):
    same = spark.createDataFrame([([1.0, 2.0],)] * 5 + [(None,)], "v array<double>")
    centres, cost, _ = lloyd.fit(same, "v", 3, restarts=2)
    assert cost == 0 and centres.shape == (3, 2)
    with pytest.raises(ValueError):
        lloyd.fit(same.limit(0), "v")
