"""The tree of clusters against plain Python, and how its work grows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from staylens.operators import cluster_tree, clusters
from staylens.session import staged

XY = ["x", "y"]


def blobs(spark, rows, groups=40, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-100, 100, size=(groups, 2))
    points = centres[rng.integers(groups, size=rows)] + rng.normal(size=(rows, 2))
    return spark.createDataFrame(
        [(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "hotel_id long, x double, y double"
    )


def plain_descent(tree, rows):
    """The leaf that each row reaches when it takes the nearest centre of its group on each level."""
    children = {}
    for c in tree.centres.collect():
        children.setdefault(c.parent, []).append((c.node, np.array([c[f"c_{x}"] for x in tree.columns]), c.leaf))
    found, met = {}, 0
    for r in rows.collect():
        here = np.array([float(r[c]) for c in tree.columns])
        at, leaf = 0, children[None][0][2]
        while not leaf:
            met += len(children[at])
            _, at, leaf = min((float(((here - c) ** 2).sum()), node, leaf) for node, c, leaf in children[at])
        found[r.hotel_id] = at
    return found, met


@pytest.mark.parametrize("rows,k", [(600, 20), (1500, 100), (3000, 1500)])
def test_assigned_as_by_brute_force(spark, rows, k):
    points = staged(blobs(spark, rows), "points")
    tree = cluster_tree.fit_tree(points, XY, k)
    assigned = {r.hotel_id: r.cluster_id for r in cluster_tree.assign_tree(tree, points).collect()}
    expected, met = plain_descent(tree, points)
    assert assigned == expected
    assert tuple(cluster_tree.centres_met(tree, points).first()) == (rows, met)
    leaves = {r.cluster_id for r in tree.leaves().collect()}
    assert set(assigned.values()) <= leaves and 0.7 * k <= len(leaves) <= 1.3 * k


def test_each_split_is_settled(spark):
    """After enough passes the centres of a split are the means of the rows that are nearest to them."""
    points = staged(blobs(spark, 800, groups=8), "points")
    tree = cluster_tree.fit_tree(points, XY, k=8, max_iterations=100)
    assert tree.depth == 1
    means = cluster_tree.assign_tree(tree, points).groupBy("cluster_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    both = means.join(tree.leaves(), "cluster_id").collect()
    assert len(both) == 8
    assert all(abs(r.x - r.c_x) < 0.01 and abs(r.y - r.c_y) < 0.01 for r in both)


def test_about_as_close_as_plain_clusters(spark):
    points = staged(blobs(spark, 2000), "points")
    tree = cluster_tree.fit_tree(points, XY, k=100)
    cost = clusters.cluster_cost(cluster_tree.assign_tree(tree, points), tree.leaves(), XY).first()
    model = clusters.train_clusters(points, XY, k=100)
    plain = clusters.cluster_cost(
        clusters.assign_clusters(model, points, XY), clusters.model_centres(spark, model, XY), XY
    ).first()
    assert cost["points"] == plain["points"] == 2000
    assert cost["sum_distance"] < 1.5 * plain["sum_distance"]


def test_work_grows_with_the_rows(spark):
    """Ten times the rows with ten times the clusters meet ten times the centres, and a level's more at most."""
    met = []
    for rows in (2_000, 20_000):
        points = staged(blobs(spark, rows, groups=200), "points")
        tree = cluster_tree.fit_tree(points, XY, k=rows // 20, max_iterations=4)
        found = cluster_tree.centres_met(tree, points).first()
        assert found["points"] == rows
        met.append(found["met"])
        assert found["met"] <= rows * cluster_tree.BRANCH * tree.depth and tree.depth <= 3
    assert met[1] < 20 * met[0]
    # Plain clusters would meet k centres a row: a hundred times as many.
    assert met[1] < 0.1 * 20_000 * 1_000


def test_no_driver_array_and_no_all_pairs(spark):
    points = staged(blobs(spark, 500), "points")
    tree = cluster_tree.fit_tree(points, XY, k=50)
    plan = cluster_tree.assign_tree(tree, points)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "LocalTableScan" not in plan


def test_equal_rows_make_one_cluster(spark):
    """A third of all rows are equal: they are one row with a weight and one cluster."""
    rng = random.Random(2)
    rows = [(i, 5.0, 5.0) if i % 3 == 0 else (i, rng.random() * 50, rng.random() * 50) for i in range(900)]
    points = spark.createDataFrame(rows, "hotel_id long, x double, y double")
    tree = cluster_tree.fit_tree(points, XY, k=200)
    assigned = cluster_tree.assign_tree(tree, points)
    hot = assigned.filter("hotel_id % 3 = 0").select("cluster_id").distinct()
    assert hot.count() == 1
    assert tree.leaves().count() > 60
    same = spark.createDataFrame([(i, 1.0, 2.0) for i in range(50)], "hotel_id long, x double, y double")
    one = cluster_tree.fit_tree(same, XY, k=10)
    assert one.depth == 0 and one.leaves().count() == 1
    assert {r.cluster_id for r in cluster_tree.assign_tree(one, same).collect()} == {0}


def test_odd_rows(spark):
    schema = "hotel_id long, x double, y double, tree_near int, weight int, node int, child int, cluster_id int"
    rows = [(1, 0.0, 0.0), (1, 0.0, 0.0), (2, 9.0, 9.0), (3, None, 1.0), (None, 1.0, 0.0)]
    points = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], schema)
    tree = cluster_tree.fit_tree(points, XY, k=2)
    out = cluster_tree.assign_tree(tree, points.drop("tree_near"))
    found = [(r.hotel_id, r.cluster_id) for r in out.collect()]
    assert len(found) == 5 and (3, None) in found
    by_id = dict(found)
    assert by_id[1] == by_id[None] != by_id[2]
    empty = points.limit(0)
    none = cluster_tree.fit_tree(empty, XY, k=5)
    assert cluster_tree.assign_tree(none, empty.drop("tree_near")).count() == 0


def test_saved_tree_gives_the_same_clusters(spark, tmp_path):
    points = staged(blobs(spark, 700), "points")
    tree = cluster_tree.fit_tree(points, XY, k=60)
    cluster_tree.save_tree(tree, str(tmp_path / "tree"))
    again = cluster_tree.load_tree(spark, str(tmp_path / "tree"))
    assert (again.columns, again.depth) == (tree.columns, tree.depth)
    one, other = (cluster_tree.assign_tree(t, points) for t in (tree, again))
    assert one.exceptAll(other).isEmpty()


def test_without_broadcast(spark):
    """Lists of centres too many to broadcast are joined by shuffling, with the same clusters."""
    points = staged(blobs(spark, 600), "points")
    tree = cluster_tree.fit_tree(points, XY, k=80)
    small = cluster_tree.assign_tree(tree, points)
    was = cluster_tree.fits_broadcast
    cluster_tree.fits_broadcast = lambda centres: False
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = cluster_tree.assign_tree(tree, points)
        assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()
        assert small.exceptAll(large).isEmpty()
    finally:
        cluster_tree.fits_broadcast = was
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_groups_that_no_task_could_hold(spark):
    """Groups above the bound are split by Spark's joins, and only what is small enough by a task."""
    points = staged(blobs(spark, 900), "points")
    tree = cluster_tree.fit_tree(points, XY, k=150, max_iterations=3, group_rows=100)
    assigned = {r.hotel_id: r.cluster_id for r in cluster_tree.assign_tree(tree, points).collect()}
    expected, _ = plain_descent(tree, points)
    assert assigned == expected
    nodes = tree.centres.collect()
    assert len({n.node for n in nodes}) == len(nodes)
    by_level = {level: sum(n.level == level for n in nodes) for level in range(tree.depth + 1)}
    assert by_level[0] == 1 and by_level[1] <= cluster_tree.BRANCH and tree.depth >= 2
    weights = {n.node: n.weight for n in nodes}
    for n in nodes:
        if not n.leaf:
            assert sum(m.weight for m in nodes if m.parent == n.node) == weights[n.node]
    leaves = sum(n.leaf for n in nodes)
    assert 0.6 * 150 <= leaves <= 1.4 * 150


def test_few_centres_are_compared_in_batches(spark):
    """Lists small enough to broadcast are compared by arrays, not by a lambda over the list of each row."""
    rows = [(i, float(i % 7), float(i % 11)) for i in range(80)] + [(90, None, 1.0), (91, float("nan"), 2.0)]
    points = spark.createDataFrame(rows, "hotel_id long, x double, y double")
    tree = cluster_tree.fit_tree(points.filter("hotel_id < 90"), XY, k=40, max_iterations=3)
    found = cluster_tree.assign_tree(tree, points)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") == tree.depth
    was = cluster_tree.fits_broadcast
    cluster_tree.fits_broadcast = lambda centres: False
    try:
        joined = cluster_tree.assign_tree(tree, points).collect()
    finally:
        cluster_tree.fits_broadcast = was
    assert sorted((r.hotel_id, r.cluster_id) for r in found.collect() if r.cluster_id is not None) == sorted(
        (r.hotel_id, r.cluster_id) for r in joined if r.cluster_id is not None
    )
    assert [r.hotel_id for r in joined if r.cluster_id is None] == [90]
