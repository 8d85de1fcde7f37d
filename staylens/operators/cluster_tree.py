"""Very many clusters as a tree: a row meets only the centres of its own group, never all of them.

Plain K-means compares every row with all k centres in each pass and holds them on the driver. Here the rows
are split into at most ``BRANCH`` groups by K-means, each group into as many again, until a group wants no more
clusters than that; those are its fine centres. A group wants its share of k by the rows it has. So a row meets
about ``BRANCH`` centres on each of log k levels, and ten times the rows with ten times the clusters take about
ten times the work.

Groups of more than ``GROUP_ROWS`` rows are split level by level, all groups of a level by the same jobs: rows join
the list of their group's centres (at most ``BRANCH``), take the nearest in place, and the new centres are means
summed in the map tasks first. A smaller group goes to one task, which splits it to its end in the same way. The
centres are a table keyed by the group they divide. Equal rows are one row with a weight. A group of equal rows, or one that a
split leaves whole, is a cluster; so the number of clusters comes near k, and can be less where rows repeat.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staylens.functions.numbers import distance, total
from staylens.operators.id_book import in_order
from staylens.operators.joins import fits_broadcast
from staylens.session import Workspace, staged

# Centres that a group is split into at once.
BRANCH = 32
MAX_ITERATIONS = 15
# A split is done when no centre moves by more than this.
TOLERANCE = 1e-4

# Rows that one task may split by itself, and of them those compared at once.
GROUP_ROWS = 65_536
BATCH = 8192
# Rows compared at once with the centres of their own groups.
FEW = 1024

# A node's number is its level in the high bits and a number of the level's table in the low ones; of nodes
# that a task made, a mark, the number of their group, and a number in the group (at most twice its rows).
LEVEL_BITS = 56
IN_TASK = 1 << 62
GROUP_BITS = 18


@dataclass(frozen=True)
class ClusterTree:
    """``centres``: level, parent, node, weight, leaf and a ``c_<column>`` for each column; the root is node 0."""

    centres: DataFrame
    columns: tuple[str, ...]
    depth: int

    def leaves(self) -> DataFrame:
        """The clusters: ``cluster_id`` and their centres."""
        return self.centres.filter("leaf").select(F.col("node").alias("cluster_id"), *_centre_names(self.columns))


def _centre_names(columns: Sequence[str]) -> list[str]:
    return [f"c_{c}" for c in columns]


def _doubles(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).cast("double").alias(c) for c in columns]


def _lists(centres: DataFrame, group: str, number: str, columns: Sequence[str]) -> DataFrame:
    """Per group the list of its centres, at most ``BRANCH``."""
    names = _centre_names(columns)
    half = (total([F.col(c) * F.col(c) for c in names]) / 2).alias("half")
    return centres.groupBy(F.col(group).alias("tree_group")).agg(
        F.collect_list(F.struct(half, F.col(number).alias("number"), *names)).alias("tree_near")
    )


def _nearest_of_few(group: str, centres: DataFrame, key: str, number: str, columns: Sequence[str]) -> Column:
    """Of the centres whose ``key`` is the row's ``group`` the nearest one, as ``_nearest`` finds it.

    For a table of centres small enough to broadcast: it goes to the tasks as sorted arrays, and a batch of rows
    is compared at once with the centres of each row's own group (``number``, and ``met``, how many they are;
    -1 and 0 for a row whose group has none).
    """
    names = _centre_names(columns)
    table = centres.select(F.col(key).alias("key"), F.col(number).alias("number"), *names).toPandas()
    table = table.sort_values(["key", "number"], kind="stable")
    groups, first, counts = np.unique(table["key"].to_numpy(np.int64), return_index=True, return_counts=True)
    numbers = table["number"].to_numpy(np.int64)
    every = [table[c].to_numpy(np.float64) for c in names]
    half = reduce(add, [c * c for c in every]) / 2
    size = FEW

    def nearest(of: pd.Series, *here: pd.Series) -> pd.DataFrame:
        keys = of.to_numpy()
        number, met = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        place = np.searchsorted(groups, keys)
        inside = np.flatnonzero(np.append(groups, -1)[place] == keys) if len(groups) else []
        for low in range(0, len(inside), size):
            rows = inside[low : low + size]
            many = counts[place[rows]]
            starts = np.cumsum(many) - many
            one = np.repeat(first[place[rows]] - starts, many) + np.arange(many.sum())
            # The same sums in the same order as in ``_nearest``; what is no number comes last there, too.
            gap = half[one] - reduce(
                add, [np.repeat(x.to_numpy(np.float64)[rows], many) * c[one] for x, c in zip(here, every, strict=True)]
            )
            gap[np.isnan(gap)] = np.inf
            hits = np.flatnonzero(gap == np.repeat(np.minimum.reduceat(gap, starts), many))
            number[rows] = numbers[one[hits[np.searchsorted(hits, starts)]]]
            met[rows] = many
        return pd.DataFrame({"number": number, "met": met})

    shown = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    return F.pandas_udf(nearest, "number long, met long")(F.coalesce(F.col(group), F.lit(-1)), *shown)


def _nearest(here: Sequence[str], columns: Sequence[str]) -> Column:
    """Of the list ``tree_near`` the number of the centre nearest to the columns ``here``; of equals the least.

    Half the squared distance, less the same for all centres, is half the centre's square less the product.
    """
    values = [F.col(c).cast("double") for c in here]

    def one(centre: Column) -> Column:
        product = total([x * centre[c] for x, c in zip(values, _centre_names(columns), strict=True)])
        return F.struct((centre["half"] - product).alias("gap"), centre["number"].alias("number"))

    return F.array_min(F.transform("tree_near", one))["number"]


def _means(columns: Sequence[str]) -> list[Column]:
    return [(F.sum(F.col(c) * F.col("weight")) / F.sum("weight")).alias(f"c_{c}") for c in columns]


def _first_centres(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows drawn by their hash, as many for each group as it is to be split into."""
    drawn = Window.partitionBy("node").orderBy("draw", *columns)
    placed = rows.withColumn("child", F.row_number().over(drawn)).filter(F.col("child") <= BRANCH)
    taken = placed.filter(F.col("child") <= F.col("want"))
    return taken.select("node", "child", *(F.col(c).alias(f"c_{c}") for c in columns))


def _placed(rows: DataFrame, centres: DataFrame, columns: Sequence[str], small: bool) -> DataFrame:
    """The rows with the ``child`` of their group that is nearest."""
    if small:
        found = _nearest_of_few("node", centres, "node", "child", columns)
        return rows.withColumn("child", found["number"].cast("int"))
    lists = _lists(centres, "node", "child", columns)
    joined = rows.join(lists, rows.node == lists.tree_group)
    return joined.withColumn("child", _nearest(columns, columns)).drop("tree_group", "tree_near")


def _split(
    rows: DataFrame, columns: Sequence[str], iterations: int, work: Workspace
) -> tuple[DataFrame, bool]:
    """Centres (node, child, c_*) for every group of ``rows``, and whether they are few."""
    names = _centre_names(columns)
    centres = staged(_first_centres(rows, columns), "tree-centres")
    small = fits_broadcast(centres)
    for _ in range(iterations):
        moved = _placed(rows, centres, columns, small).groupBy("node", "child").agg(*_means(columns))
        before = centres.select("node", "child", *(F.col(c).alias(f"old_{c}") for c in names))
        step = distance([F.col(c) for c in names], [F.col(f"old_{c}") for c in names])
        both = moved.join(before, ["node", "child"])
        following = staged(both.select("node", "child", *names, step.alias("step")), "tree-centres")
        work.release(centres)
        centres = following
        if centres.agg(F.max("step")).first()[0] <= TOLERANCE:
            break
    return centres, small


def _numbered(placed: DataFrame, centres: DataFrame, level: int, columns: Sequence[str]) -> DataFrame:
    """The nodes that a level adds, each with the clusters it ``want``s of its parent's."""
    names = _centre_names(columns)
    found = placed.groupBy("node", "child").agg(
        F.sum("weight").alias("weight"), F.count("*").alias("rows"), F.first("want").alias("parent_want")
    )
    family = Window.partitionBy("node")
    share = F.round(F.col("parent_want") * F.col("weight") / F.sum("weight").over(family)).cast("long")
    # A group that wants no more than a list of centres has got them; one that stayed whole ends as well.
    whole = F.count("*").over(family) == 1
    want = F.when((F.col("parent_want") <= BRANCH) | whole, F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.least(share, F.col("rows")))
    )
    return (
        found.withColumn("wanted", want.cast("long"))
        .join(centres.select("node", "child", *names), ["node", "child"])
        .withColumn("number", F.lit(level << LEVEL_BITS) + F.monotonically_increasing_id())
    )


# -- groups that one task can hold


def _settled(points: np.ndarray, weights: np.ndarray, centres: np.ndarray, iterations: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres after K-means, without those that lost all rows, and the nearest of them for each row."""

    def nearest() -> np.ndarray:
        parts = [points[low : low + BATCH] for low in range(0, len(points), BATCH)]
        # Half the squared distance, less the same for all centres.
        half = (centres * centres).sum(axis=1) / 2
        return np.concatenate([(half - p @ centres.T).argmin(axis=1) for p in parts])

    for _ in range(iterations):
        child = nearest()
        mass = np.bincount(child, weights, len(centres))
        held = mass > 0
        sums = np.stack([np.bincount(child, weights * x, len(centres)) for x in points.T], axis=1)
        moved = sums[held] / mass[held, None]
        step = np.sqrt(((moved - centres[held]) ** 2).sum(axis=1)).max()
        centres = moved
        if step <= TOLERANCE:
            break
    return centres, nearest()


def _grow(
    points: np.ndarray, weights: np.ndarray, want: int, root: int, level: int, number: int, iterations: int
) -> list[tuple]:
    """The nodes under ``root``, numbered from ``number`` on. Rows come in the order in which they are drawn."""
    nodes: list[tuple] = []
    todo = [(np.arange(len(points)), root, level, want)]
    while todo:
        rows, parent, level, want = todo.pop()
        centres, child = _settled(points[rows], weights[rows], points[rows[: min(BRANCH, want)]], iterations)
        found = [(c, rows[child == c]) for c in range(len(centres))]
        found = [(c, own) for c, own in found if len(own)]
        mass = weights[rows].sum()
        for c, own in found:
            share = round(want * weights[own].sum() / mass)
            wanted = 1 if want <= BRANCH or len(found) == 1 else max(1, min(share, len(own)))
            at = number + len(nodes)
            nodes.append((level + 1, parent, at, int(weights[own].sum()), wanted <= 1, *centres[c].tolist()))
            if wanted > 1:
                todo.append((own, at, level + 1, wanted))
    return nodes


def _grown(rows: DataFrame, columns: Sequence[str], iterations: int, level: int) -> DataFrame:
    """The nodes under groups of at most ``GROUP_ROWS`` rows, each group split to its end in one task."""
    names = _centre_names(columns)
    schema = ", ".join(
        ["level int, parent long, node long, weight long, leaf boolean", *(f"{c} double" for c in names)]
    )
    places = in_order(rows.select(F.col("node").alias("of")).distinct(), "of")
    numbered = rows.join(places, F.col("node") == F.col("of")).drop("of")

    def split(group: pd.DataFrame) -> pd.DataFrame:
        drawn = group.sort_values(["draw", *columns], kind="stable")
        nodes = _grow(
            drawn[list(columns)].to_numpy(np.float64),
            drawn["weight"].to_numpy(np.float64),
            int(drawn["want"].iloc[0]),
            int(drawn["node"].iloc[0]),
            level,
            IN_TASK | int(drawn["place"].iloc[0]) << GROUP_BITS,
            iterations,
        )
        return pd.DataFrame(nodes, columns=["level", "parent", "node", "weight", "leaf", *names])

    return numbered.groupBy("node").applyInPandas(split, schema)


def fit_tree(
    points: DataFrame,
    columns: Sequence[str],
    k: int,
    max_iterations: int = MAX_ITERATIONS,
    seed: int = 1,
    group_rows: int = GROUP_ROWS,
) -> ClusterTree:
    """A tree of about ``k`` clusters of the rows of ``points``; rows with a null in a column take no part."""
    columns = tuple(columns)
    names = _centre_names(columns)
    shape = ["level", "parent", "node", "weight", "leaf", *names]
    with Workspace(points.sparkSession) as work:
        distinct = points.select(*_doubles(columns)).na.drop().groupBy(*columns).agg(F.count("*").alias("weight"))
        rows = staged(
            distinct.select(
                "*",
                F.lit(0).cast("long").alias("node"),
                F.lit(k).cast("long").alias("want"),
                F.xxhash64(F.lit(seed), *columns).alias("draw"),
            ),
            "tree-rows",
        )
        root = rows.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"), *_means(columns), F.count("*").alias("n"))
        leaf = (F.col("n") <= 1) | F.lit(k <= 1)
        root = root.select(
            F.lit(0).alias("level"),
            F.lit(None).cast("long").alias("parent"),
            F.lit(0).cast("long").alias("node"),
            "weight",
            leaf.alias("leaf"),
            *names,
        )
        parts = [staged(root, "tree-level")]
        level, ended = 0, parts[0].first()["leaf"]
        while not ended:
            sizes = staged(rows.groupBy("node").agg(F.count("*").alias("n")), "tree-sizes")
            large = sizes.filter(F.col("n") > group_rows).select("node")
            large = F.broadcast(large) if fits_broadcast(sizes) else large
            few = rows.join(large, "node", "left_anti")
            parts.append(staged(_grown(few, columns, max_iterations, level), "tree-level"))
            many = rows.join(large, "node", "left_semi")
            if many.isEmpty():
                break
            level += 1
            many = staged(many, "tree-rows")
            work.release(rows)
            rows, nodes = _level(many, columns, max_iterations, level, work)
            parts.append(nodes)
            ended = rows.isEmpty()
        union = parts[0].select(*shape)
        for part in parts[1:]:
            union = union.unionByName(part.select(*shape))
        centres = work.keep(staged(union, "cluster-tree"))
        return ClusterTree(centres, columns, centres.agg(F.max("level")).first()[0])


def _level(
    rows: DataFrame, columns: Sequence[str], iterations: int, level: int, work: Workspace
) -> tuple[DataFrame, DataFrame]:
    """Split groups that no task could hold: the rows of the new groups that want more, and the new nodes."""
    names = _centre_names(columns)
    centres, small = _split(rows, columns, iterations, work)
    placed = staged(_placed(rows, centres, columns, small), "tree-placed")
    nodes = staged(_numbered(placed, centres, level, columns), "tree-nodes")
    work.release(rows, centres)
    added = nodes.select(
        F.lit(level).alias("level"),
        F.col("node").alias("parent"),
        F.col("number").alias("node"),
        "weight",
        (F.col("wanted") <= 1).alias("leaf"),
        *names,
    )
    added = staged(added, "tree-level")
    onward = nodes.filter("wanted > 1").select("node", "child", "number", "wanted")
    onward = F.broadcast(onward) if fits_broadcast(onward) else onward
    following = placed.join(onward, ["node", "child"]).select(
        *columns, "weight", F.col("number").alias("node"), F.col("wanted").alias("want"), "draw"
    )
    following = staged(following, "tree-rows")
    work.release(placed, nodes)
    return following, added


def _descended(tree: ClusterTree, points: DataFrame) -> DataFrame:
    """The points with ``cluster_id``, and ``met``: how many centres each was compared with on its way."""
    incomplete = reduce(or_, [F.col(c).isNull() for c in tree.columns])
    start = F.when(~incomplete, F.lit(0).cast("long"))
    found = points.withColumns({"cluster_id": start, "met": F.lit(0).cast("long")})
    kept = found.columns
    tasks = points.sparkSession.sparkContext.defaultParallelism
    if tree.depth > 0 and points.rdd.getNumPartitions() < tasks:
        found = found.repartition(tasks)
    for level in range(1, tree.depth + 1):
        centres = tree.centres.filter(F.col("level") == level)
        if fits_broadcast(centres):
            near = _nearest_of_few("cluster_id", centres, "parent", "node", tree.columns)
            down = {
                "cluster_id": F.when(F.col("tree_near.met") > 0, F.col("tree_near.number")).otherwise(F.col("cluster_id")),
                "met": F.col("met") + F.col("tree_near.met"),
            }
            found = found.withColumn("tree_near", near).withColumns(down).select(*kept)
            continue
        lists = _lists(centres, "parent", "node", tree.columns)
        joined = found.join(lists, F.col("cluster_id") == lists.tree_group, "left")
        # A row without a list stands at a leaf already.
        down = {
            "cluster_id": F.coalesce(_nearest(tree.columns, tree.columns), F.col("cluster_id")),
            "met": F.col("met") + F.coalesce(F.size("tree_near"), F.lit(0)),
        }
        found = joined.withColumns(down).select(*kept)
    return found


def assign_tree(tree: ClusterTree, points: DataFrame) -> DataFrame:
    """Add ``cluster_id`` by walking down the tree; every other column stays on its row.

    A row with a null in a column of the tree gets a null.
    """
    return _descended(tree, points).drop("met")


def centres_met(tree: ClusterTree, points: DataFrame) -> DataFrame:
    """One row: the points, and the centres they were compared with in all."""
    return _descended(tree, points).agg(
        F.count("*").alias("points"), F.coalesce(F.sum("met"), F.lit(0)).alias("met")
    )


def save_tree(tree: ClusterTree, path: str) -> None:
    tree.centres.write.mode("overwrite").parquet(path)


def load_tree(spark: SparkSession, path: str) -> ClusterTree:
    centres = spark.read.parquet(path)
    columns = tuple(c.removeprefix("c_") for c in centres.columns if c.startswith("c_"))
    return ClusterTree(centres, columns, centres.agg(F.max("level")).first()[0])
