"""Bisecting K-means against plain Python and Spark's own estimator, and how its jobs grow."""

import datetime

import numpy as np
import pytest
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F
from test_cluster_tree import XY, blobs

from staylens.operators import clusters, halving
from staylens.session import staged


def groups_of(assigned):
    """The clusters as sets of hotels."""
    found = {}
    for r in assigned.collect():
        found.setdefault(r.cluster_id, set()).add(r.hotel_id)
    return found


@pytest.mark.parametrize("rows,k,group_rows", [(900, 45, 10_000), (900, 45, 70), (600, 5, 20), (500, 500, 90), (300, 1, 40)])
def test_clusters_are_the_means_of_their_rows(spark, rows, k, group_rows):
    points = staged(blobs(spark, rows), "points")
    model = halving.fit_halves(points, XY, k, group_rows=group_rows)
    found = groups_of(halving.assign_halves(model, points))
    at = {r.hotel_id: np.array([r.x, r.y]) for r in points.collect()}
    leaves = {r.cluster_id: np.array([r.c_x, r.c_y]) for r in model.leaves().collect()}
    assert len(found) == k and set(found) == set(leaves)
    sizes = {r.node: r["size"] for r in model.nodes.filter("leaf").collect()}
    cost = 0.0
    for node, hotels in found.items():
        here = np.array([at[h] for h in hotels])
        assert np.allclose(here.mean(axis=0), leaves[node]) and sizes[node] == len(hotels)
        cost += ((here - here.mean(axis=0)) ** 2).sum()
    assert model.training_cost == pytest.approx(cost, rel=1e-9, abs=1e-9)


def test_splits_level_by_level_the_largest_first(spark):
    model = halving.fit_halves(staged(blobs(spark, 700), "points"), XY, k=37, group_rows=100)
    nodes = model.nodes.collect()
    sizes = {r.node: r["size"] for r in nodes}
    split = {r.node for r in nodes if not r.leaf}
    last = max(n.bit_length() for n in split)
    able = {n for n in sizes if sizes[n] > 1 and n.bit_length() <= last}
    assert all(n in split for n in able if n.bit_length() < last)
    left = [sizes[n] for n in able - split]
    assert not left or min(sizes[n] for n in split if n.bit_length() == last) >= max(left)
    assert all(sizes[n] == sizes[2 * n] + sizes[2 * n + 1] for n in split)


def test_same_clusters_whoever_splits_a_group(spark):
    points = staged(blobs(spark, 800), "points")
    one, other = (
        groups_of(halving.assign_halves(halving.fit_halves(points, XY, 60, group_rows=n), points)) for n in (10_000, 30)
    )
    assert one == other


@pytest.mark.parametrize("k", [2, 3, 4, 6, 8])
def test_same_clusters_as_the_library_where_groups_lie_apart(spark, k):
    """Eight groups in pairs of pairs, of unlike size: every split has one best answer."""
    rng = np.random.default_rng(3)
    rows, hotel = [], 0
    for g, size in enumerate([40, 31, 25, 22, 18, 14, 11, 9]):
        centre = 1 + 1000 * (g >> 2) + 100 * (g >> 1 & 1) + 10 * (g & 1)
        for _ in range(size):
            rows.append((hotel, float(centre + rng.normal() / 10), float(rng.normal() / 10)))
            hotel += 1
    points = staged(spark.createDataFrame(rows, "hotel_id long, x double, y double"), "points")
    ours = groups_of(halving.assign_halves(halving.fit_halves(points, XY, k, group_rows=50), points))
    ready = VectorAssembler(inputCols=XY, outputCol="features").transform(points)
    library = BisectingKMeans(k=k, maxIter=15, seed=1, predictionCol="cluster_id").fit(ready)
    theirs = groups_of(library.transform(ready))
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_cost_is_that_of_the_assigned_rows(spark):
    """The library's own cost was that of the pass before the last, which differs where 15 passes settle nothing."""
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, p)) for i, p in enumerate(rng.uniform(size=(6000, 2)))]
    points = staged(spark.createDataFrame(rows, "hotel_id long, x double, y double"), "points")
    model = clusters.train_clusters(points, XY, k=300, method="bisecting")
    assigned = clusters.assign_clusters(model, points, XY)
    cost = clusters.cluster_cost(assigned, clusters.model_centres(spark, model, XY), XY).first()
    assert cost.sum_squared == pytest.approx(model.training_cost, rel=1e-9)


def test_jobs_do_not_follow_the_clusters(spark):
    points = staged(blobs(spark, 2000), "points")

    def jobs(k):
        group = f"halving-{k}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            clusters.train_clusters(points, XY, k=k, method="bisecting")
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few, many = jobs(4), jobs(500)
    assert many <= few + 4


def test_rows_meet_the_planes_of_their_part(spark, monkeypatch):
    """Where the planes are too many to broadcast; other columns keep their values and types."""
    hotels = blobs(spark, 400).withColumns(
        {
            "name": F.when(F.col("hotel_id") % 3 != 0, F.concat(F.lit("h"), "hotel_id")),
            "stars": F.when(F.col("hotel_id") % 5 != 0, F.col("hotel_id") + F.lit(2**60)),
            "seen": F.lit(datetime.datetime(2020, 1, 2, 3, 4, 5, 6)),
            "x": F.when(F.col("hotel_id") != 7, F.col("x")),
        }
    )
    points = staged(hotels, "points")
    model = halving.fit_halves(points, XY, 30, group_rows=60)
    expected = {tuple(r) for r in halving.assign_halves(model, points).collect()}
    monkeypatch.setattr(halving, "fits_broadcast", lambda table: False)
    monkeypatch.setattr(halving, "GROUP_ROWS", 16)
    found = halving.assign_halves(model, points)
    assert found.schema == points.schema.add("cluster_id", "long")
    assert {tuple(r) for r in found.collect()} == expected
    assert [r.cluster_id for r in found.filter("hotel_id = 7").collect()] == [None]


@pytest.mark.parametrize("group_rows", [1, 100])
def test_copies_and_rows_that_are_alike(spark, group_rows):
    near = float(np.nextafter(1.0, 2.0))
    rows = [(i, x, 0.0) for i, x in enumerate([1.0, near, 5.0, 5.0, 5.0, 9.0] * 4)]
    points = staged(spark.createDataFrame(rows, "hotel_id long, x double, y double"), "points")
    model = halving.fit_halves(points, XY, 20, group_rows=group_rows)
    found = groups_of(halving.assign_halves(model, points))
    values = sorted({r[1] for r in rows if r[0] in hotels} for hotels in found.values())
    assert {5.0} in values and {9.0} in values and 3 <= len(found) <= 4
    assert sum(map(len, found.values())) == 24 and model.training_cost < 1e-20


def test_no_rows(spark):
    points = staged(spark.createDataFrame([], "hotel_id long, x double, y double"), "points")
    model = halving.fit_halves(points, XY, 5)
    assert model.training_cost == 0 and halving.assign_halves(model, points).isEmpty()
