"""Plain K-means by a tree of its centres, against all pairs."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import functions as F

from staylens.operators import clusters, lloyd, nearest
from staylens.plans.catalogue import QUERIES
from staylens.session import staged

XYZ = ["x", "y", "z"]


def of_all(points, centres):
    """The least number of the nearest centres, all worked out."""
    return np.array([sum((p[j] - centres[:, j]) ** 2 for j in range(len(p))).argmin() for p in points])


def odd_points():
    rng = np.random.default_rng(5)
    blobs = rng.normal(size=(40, 4)) * [100, 1, 1, 0.01]
    spread = blobs[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 4)) * 0.3
    yield "blobs", spread, spread[:700]
    yield "one", spread[:50], spread[:1]
    yield "copies", np.round(spread), np.round(spread[:600])
    grid = np.stack(np.meshgrid(*[np.arange(6.0)] * 3), axis=-1).reshape(-1, 3)
    yield "ties", np.concatenate([grid + 0.5, grid, -grid * 1e9]), grid
    yield "far off", spread + 1e7, spread[::5] + 1e7
    yield "tiny", spread * 1e-9, spread[::5] * 1e-9
    yield "equal column", np.column_stack([spread, np.ones(3000)]), np.column_stack([spread, np.ones(3000)])[:500]
    yield "all equal", np.ones((20, 2)), np.ones((100, 2))


@pytest.mark.parametrize("name, points, centres", [pytest.param(*x, id=x[0]) for x in odd_points()])
def test_nearest_is_that_of_all(name, points, centres):
    assert (nearest.centre_tree(centres).nearest(points) == of_all(points, centres)).all()
    # Whatever rows stand beside them.
    some = nearest.centre_tree(centres).nearest(points[::7])
    assert (some == of_all(points[::7], centres)).all()
    assert len(nearest.centre_tree(centres).nearest(points[:0])) == 0


def test_few_centres_are_compared(monkeypatch):
    rng = np.random.default_rng(3)
    points = rng.random((20_000, 2))
    met, closest = [], nearest.CentreTree._closest
    monkeypatch.setattr(
        nearest.CentreTree, "_closest",
        lambda tree, rows, squares, boxes: met.append(len(rows) * len(tree._members(boxes))) or closest(tree, rows, squares, boxes),
    )
    tree = nearest.centre_tree(points[:2000])
    tree.nearest(points)
    assert sum(met) < 20_000 * 2000 / 8


def test_rows_without_a_number_are_refused():
    with pytest.raises(ValueError, match="nan"):
        nearest.centre_tree(np.ones((2, 1))).nearest(np.array([[1.0], [np.nan]]))


def cloud(spark, rows):
    n = F.col("id")
    return staged(
        spark.range(rows).select(
            "id", (n % 40).cast("double").alias("x"), F.round(F.rand(2) * 9, 1).alias("y"), (n % 7 + F.rand(4)).alias("z")
        ).unionByName(spark.range(50).select("id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("z"))),
        "cloud",
    )


def test_fit_follows_plain_lloyd(spark, monkeypatch):
    """The same centres, passes and cost as with all pairs, by a model that Spark saves and loads."""
    points = cloud(spark, 3000)
    drawn, draw = [], lloyd._drawn
    monkeypatch.setattr(lloyd, "_drawn", lambda *a: drawn.append(draw(*a)) or drawn[0])
    model = clusters.train_clusters(points, XYZ, k=200, max_iterations=4, seed=7)
    rows = np.array([list(r) for r in points.select(*XYZ).collect()])
    centres, cost = drawn[0], 0.0
    assert 190 < len(centres) == len(np.unique(centres, axis=0)) <= 200
    for _ in range(4):
        near = of_all(rows, centres)
        cost = ((rows - centres[near]) ** 2).sum()
        centres = np.array([rows[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(centres)])
    assert np.allclose(np.array(model.clusterCenters()), centres, atol=1e-9)
    assert (model.getK(), model.summary.numIter) == (200, 4)
    assert model.summary.trainingCost == pytest.approx(cost, rel=1e-9)
    assigned = clusters.assign_clusters(model, points, XYZ)
    assert dict(assigned.dtypes)["cluster_id"] == "int"
    own = np.array([r.cluster_id for r in assigned.select(*XYZ, "cluster_id").collect()])
    again = np.array([list(r)[:3] for r in assigned.select(*XYZ).collect()])
    assert (own == of_all(again, centres)).all()
    # Spark's own look-up takes a centre as near.
    told = model.summary.predictions.select(*XYZ, "cluster_id").collect()
    gaps = [sum((r[j] - centres[r.cluster_id][j]) ** 2 for j in range(3)) for r in told]
    assert sum(gaps) == pytest.approx(((again - centres[own]) ** 2).sum(), rel=1e-6)


def test_more_clusters_than_rows(spark, tmp_path):
    points = cloud(spark, 30)
    model = clusters.train_clusters(points, XYZ, k=500)
    assert len(model.clusterCenters()) == 31
    path = str(tmp_path / "means")
    model.write().save(path)
    one, other = (clusters.assign_clusters(m, points, XYZ) for m in (model, KMeansModel.load(path)))
    assert one.exceptAll(other).isEmpty() and one.groupBy("cluster_id").count().count() == 31
    with pytest.raises(ValueError, match="no rows"):
        clusters.train_clusters(points.limit(0), XYZ, k=3)


def test_cost_query_tells_a_wrong_sum_of_distances(spark, monkeypatch):
    """The reference's cost is the sum of distances, not of their squares alone."""
    folder = "/root/testdata/sf0.001"
    assert QUERIES["kmeans_cost"](spark, folder).collect() == [(200, True, True)]
    cost = clusters.cluster_cost
    for name, expected in (("sum_distance", (200, True, False)), ("sum_squared", (200, False, False))):
        monkeypatch.setattr(clusters, "cluster_cost", lambda *a, c=name: cost(*a).withColumn(c, F.col(c) * 1.1))
        assert QUERIES["kmeans_cost"](spark, folder).collect() == [expected]
