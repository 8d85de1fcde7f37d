"""Bisecting K-means for very many clusters: all groups of a level are halved, from the whole down to k clusters.

The rule is that of Spark's own estimator. On each level every group with two or more different rows is split by
two-means; where that would give more than ``k`` clusters, the groups with the most rows are split (of groups with as
many, those with the lowest numbers). Spark's estimator makes ``max_iterations`` passes over all rows on each of about
log k levels and sends the centres of all groups through the driver in every one. Here passes over all rows are made for
groups of more than ``GROUP_ROWS`` different rows alone, so their number does not follow k; a smaller group goes to one
task, which splits it level by level. The tasks first count the splits by level and size, which tells where the last
level is cut, and then write the nodes that are left. The driver sees the large groups and those counts.

A split is a plane between the centres of its two halves. Rows go down by the planes, in the fit and afterwards alike,
and a cluster's centre is the mean of the rows that come to it. Equal rows are one row with a weight. There are k
clusters unless there are fewer different rows; rows that no plane divides any more (equal but for the last digits)
stay together. Rows with a null in a column take no part and get no cluster.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions.numbers import squared_distance, total
from staylens.operators.joins import fits_broadcast
from staylens.session import Workspace, staged

MAX_ITERATIONS = 15
# Different rows that one task may split by itself, and rows that one task takes down at once.
GROUP_ROWS = 262_144
# Passes over large groups end when no centre moves by more than this part of its group's width.
STILL = 1e-9

# A node's number is its path: the root is 1, the halves of n are 2n and 2n + 1. Numbers from here on are not split.
LAST_NODE = 1 << 61


@dataclass(frozen=True)
class HalvedClusters:
    """``nodes``: node, part, size, leaf, cost, the plane (``cut``, ``d_<column>``) and the centre (``c_<column>``).

    ``part`` is the node whose group a task split, 0 for the nodes above. ``training_cost`` is the sum of squared
    distances of the fitted rows to the centres of their clusters.
    """

    nodes: DataFrame
    columns: tuple[str, ...]
    training_cost: float

    def leaves(self) -> DataFrame:
        """The clusters: ``cluster_id`` and their centres."""
        return self.nodes.filter("leaf").select(F.col("node").alias("cluster_id"), *(f"c_{c}" for c in self.columns))


@dataclass(frozen=True)
class _Group:
    """A group above the tasks' own: its different rows, all rows, their mean, and how wide each column is."""

    rows: int
    size: int
    centre: np.ndarray
    width: np.ndarray


@dataclass(frozen=True)
class _Last:
    """The last level with splits: there groups larger than ``size`` are split, and ``ties`` of just that size."""

    level: int
    size: int
    ties: int

    def splits(self, level: int, size: int | np.ndarray) -> bool | np.ndarray:
        """Whether groups are split, ties included."""
        return (level < self.level) | ((level == self.level) & (size >= self.size))


def _level(node: int) -> int:
    return node.bit_length() - 1


def _noise(nodes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """For each node ``width`` numbers from -1 to 1, told by its number and the seed (SplitMix64)."""
    x = np.add.outer(nodes.astype(np.uint64) * np.uint64(width), np.arange(width, dtype=np.uint64))
    x = (x + np.uint64(seed % 2**32)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**52 - 1


def _first_planes(nodes: np.ndarray, means: np.ndarray, widths: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Planes through the means of groups, in directions drawn for their numbers."""
    across = _noise(nodes, means.shape[1], seed) * widths
    return across, (across * means).sum(axis=1)


def _between(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The planes halfway between two centres each."""
    across = right - left
    return across, (across * ((left + right) / 2)).sum(axis=1)


def _beyond(points: Sequence[np.ndarray], across: np.ndarray, cut: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether rows lie beyond the plane ``of`` each; the same sums in the same order as in ``_placed``."""
    return reduce(add, [x * across[of, c] for c, x in enumerate(points)]) > cut[of]


# -- groups that one task can hold


def _halved(
    points: np.ndarray, weights: np.ndarray, slot: np.ndarray, nodes: np.ndarray, iterations: int, seed: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two-means of every group at once: the planes, and the half of each row. Rows lie by group (``slot``)."""
    count = len(nodes)

    def means(rows: np.ndarray, of: np.ndarray, groups: int) -> np.ndarray:
        mass = np.bincount(of, weights[rows], groups)
        sums = np.stack([np.bincount(of, weights[rows] * x[rows], groups) for x in points], axis=1)
        with np.errstate(invalid="ignore"):
            return sums / mass[:, None]

    live = np.arange(len(slot))
    starts = np.flatnonzero(np.diff(slot, prepend=-1))
    widths = np.stack([np.maximum.reduceat(x, starts) - np.minimum.reduceat(x, starts) for x in points], axis=1)
    across, cut = _first_planes(nodes, means(live, slot, count), widths, seed)
    right = _beyond(points, across, cut, slot)
    for _ in range(iterations):
        centres = means(live, 2 * slot[live] + right[live], 2 * count).reshape(count, 2, -1)
        # Groups that stand still are not looked at again; one with an empty half keeps its plane.
        both = np.isfinite(centres).all(axis=(1, 2))
        across[both], cut[both] = _between(centres[both, 0], centres[both, 1])
        now = _beyond(points[:, live], across, cut, slot[live])
        moving = np.zeros(count, bool)
        moving[slot[live[now != right[live]]]] = True
        right[live] = now
        live = live[moving[slot[live]]]
        if not len(live):
            break
    return across, cut, right


@dataclass(frozen=True)
class _Floor:
    """The nodes of one level in a task, those that are split among them, and their rows."""

    level: int
    nodes: np.ndarray
    size: np.ndarray
    split: np.ndarray
    across: np.ndarray
    cut: np.ndarray
    points: np.ndarray
    weights: np.ndarray
    slot: np.ndarray


def _floors(
    points: np.ndarray, weights: np.ndarray, root: int, iterations: int, seed: int, last: _Last | None, ties: int = 0
) -> Iterator[_Floor]:
    """The levels under ``root``; without ``last`` down to rows that are alike. ``ties``: the group's own of the last."""
    nodes, slot, level = np.array([root]), np.zeros(len(weights), np.int64), _level(root)
    while len(nodes):
        size = np.bincount(slot, weights).astype(np.int64)
        split = (np.bincount(slot) > 1) & (nodes < LAST_NODE)
        if last is not None:
            split &= last.splits(level, size)
        across, cut = np.zeros((len(nodes), len(points))), np.zeros(len(nodes))
        right = np.zeros(len(slot), bool)
        if split.any():
            tried, rows = np.flatnonzero(split), np.flatnonzero(split[slot])
            own = (np.cumsum(split) - 1)[slot[rows]]
            across[tried], cut[tried], right[rows] = _halved(
                points[:, rows], weights[rows], own, nodes[tried], iterations, seed
            )
            split &= (np.bincount(2 * slot + right, minlength=2 * len(nodes)).reshape(-1, 2) > 0).all(axis=1)
            if last is not None and level == last.level:
                split[np.flatnonzero(split & (size == last.size))[ties:]] = False
        yield _Floor(level, nodes, size, split, across, cut, points, weights, slot)
        rows = np.flatnonzero(split[slot])
        side = 2 * slot[rows] + right[rows]
        order = np.argsort(side, kind="stable")
        points, weights = points[:, rows[order]], weights[rows[order]]
        found, slot = np.unique(side[order], return_inverse=True)
        nodes, level = 2 * nodes[found // 2] + found % 2, level + 1


def _ordered(group: pd.DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The points, a row for each column, and their weights, in the same order on every run."""
    points = np.ascontiguousarray(group[list(columns)].to_numpy(np.float64).T)
    order = np.lexsort(points)
    return points[:, order], group["weight"].to_numpy(np.float64)[order]


def _node_rows(floor: _Floor, root: int, columns: Sequence[str]) -> pd.DataFrame:
    """A level's nodes as rows of the table of nodes."""
    mass = np.bincount(floor.slot, floor.weights)
    centres = [np.bincount(floor.slot, floor.weights * x) / mass for x in floor.points]
    gaps = reduce(add, [(x - c[floor.slot]) ** 2 for x, c in zip(floor.points, centres, strict=True)])
    table = {
        "node": floor.nodes,
        "part": root,
        "size": floor.size,
        "leaf": ~floor.split,
        "cost": np.bincount(floor.slot, floor.weights * gaps),
        "cut": floor.cut,
    }
    table |= {f"d_{c}": floor.across[:, i] for i, c in enumerate(columns)}
    return pd.DataFrame(table | {f"c_{c}": x for c, x in zip(columns, centres, strict=True)})


def _for_tasks(rows: DataFrame, groups: Sequence[int]) -> DataFrame:
    """The rows of groups, each group in one place; more places than groups, so that few meet in one."""
    table = rows.sparkSession.createDataFrame([(n,) for n in groups], "node long")
    return rows.join(F.broadcast(table), "node").repartition(4 * max(1, len(groups)), "node")


def _split_counts(rows: DataFrame, columns: Sequence[str], iterations: int, seed: int) -> DataFrame:
    """For each group, level and size how many of the group's nodes could be split."""

    def count(group: pd.DataFrame) -> pd.DataFrame:
        points, weights = _ordered(group, columns)
        root, found = int(group["node"].iloc[0]), []
        for floor in _floors(points, weights, root, iterations, seed, None):
            sizes, n = np.unique(floor.size[floor.split], return_counts=True)
            found.append(pd.DataFrame({"node": root, "level": floor.level, "size": sizes, "n": n}))
        return pd.concat(found)

    return rows.groupBy("node").applyInPandas(count, "node long, level int, size long, n long")


def _node_schema(columns: Sequence[str]) -> str:
    numbers = ["cost", "cut", *(f"d_{c}" for c in columns), *(f"c_{c}" for c in columns)]
    return ", ".join(["node long, part long, size long, leaf boolean", *(f"`{c}` double" for c in numbers)])


def _grown(
    rows: DataFrame, columns: Sequence[str], iterations: int, seed: int, last: _Last | None, ties: dict[int, int]
) -> DataFrame:
    """The nodes of the groups down to the last level."""

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        points, weights = _ordered(group, columns)
        root = int(group["node"].iloc[0])
        floors = _floors(points, weights, root, iterations, seed, last, ties.get(root, 0))
        return pd.concat([_node_rows(floor, root, columns) for floor in floors])

    return rows.groupBy("node").applyInPandas(grow, _node_schema(columns))


# -- groups of more rows than that


def _groups(rows: DataFrame, columns: Sequence[str]) -> dict[int, _Group]:
    """All groups of the rows, by their nodes."""
    found = rows.groupBy("node").agg(
        F.count("*"),
        F.sum("weight"),
        F.array(*(F.sum(F.col(c) * F.col("weight")) for c in columns)),
        F.array(*(F.max(c) - F.min(c) for c in columns)),
    )
    return {n: _Group(count, size, np.array(sums) / size, np.array(width)) for n, count, size, sums, width in found.collect()}


def _placed(rows: DataFrame, nodes: np.ndarray, across: np.ndarray, cut: np.ndarray, columns: Sequence[str], how: str) -> DataFrame:
    """The rows with ``right``, whether they lie beyond the plane of their group; null if it has none."""
    planes = {"node": nodes, "cut": cut} | {f"d_{c}": across[:, i] for i, c in enumerate(columns)}
    # As an Arrow table it is part of the plan, not the output of tasks.
    table = rows.sparkSession.createDataFrame(pa.table(planes))
    product = total([F.col(c) * F.col(f"d_{c}") for c in columns])
    joined = rows.join(F.broadcast(table), "node", how)
    return joined.select("node", *columns, "weight", (product > F.col("cut")).alias("right"))


def _planes(
    rows: DataFrame, columns: Sequence[str], large: dict[int, _Group], iterations: int, seed: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two-means of large groups, all by the same jobs: their nodes and planes."""
    nodes = np.array(sorted(large))
    at = {int(n): i for i, n in enumerate(nodes)}
    widths = np.stack([large[n].width for n in at])
    across, cut = _first_planes(nodes, np.stack([large[n].centre for n in at]), widths, seed)
    before = None
    for _ in range(iterations):
        halves = _placed(rows, nodes, across, cut, columns, "inner").groupBy("node", "right")
        centres = np.full((len(nodes), 2, len(columns)), np.nan)
        sums = F.array(*(F.sum(F.col(c) * F.col("weight")) for c in columns))
        for node, right, size, summed in halves.agg(F.sum("weight"), sums).collect():
            centres[at[node], int(right)] = np.array(summed) / size
        both = np.isfinite(centres).all(axis=(1, 2))
        across[both], cut[both] = _between(centres[both, 0], centres[both, 1])
        if before is not None and not (np.abs(centres - before).max(axis=2) > STILL * widths.max(axis=1)[:, None]).any():
            break
        before = centres
    return nodes, across, cut


def _split_large(
    rows: DataFrame, columns: Sequence[str], k: int, iterations: int, seed: int, group_rows: int, work: Workspace
) -> tuple[DataFrame, dict[int, _Group], dict[int, tuple[np.ndarray, float]]]:
    """Split groups until each has at most ``group_rows`` rows, or there are k of them.

    The rows with their groups (``node``), all groups met on the way, and the planes of those that are split.
    """
    groups = _groups(rows, columns)
    planes: dict[int, tuple[np.ndarray, float]] = {}
    large = {n: g for n, g in groups.items() if g.rows > group_rows and k > 1}
    while large and len(planes) + 1 < k:
        nodes, across, cut = _planes(rows, columns, large, iterations, seed)
        child = F.when(F.col("right").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.col("right").cast("long"))
        placed = _placed(rows, nodes, across, cut, columns, "left")
        following = staged(placed.withColumn("node", child).drop("right"), "halving-rows")
        work.release(rows)
        rows, found = following, _groups(following, columns)
        whole = [c for n in large for c in (2 * n, 2 * n + 1) if c in found and c ^ 1 not in found]
        if whole:
            back = F.when(F.col("node").isin(whole), F.shiftright("node", 1)).otherwise(F.col("node"))
            following = staged(rows.withColumn("node", back), "halving-rows")
            work.release(rows)
            rows = following
        split = [(int(n), d, float(t)) for n, d, t in zip(nodes, across, cut, strict=True) if 2 * n in found and 2 * n + 1 in found]
        planes |= {n: (d, t) for n, d, t in split}
        fresh = {c: found[c] for n, *_ in split for c in (2 * n, 2 * n + 1)}
        groups |= fresh
        large = {n: g for n, g in fresh.items() if g.rows > group_rows and n < LAST_NODE}
    return rows, groups, planes


# -- the whole


def _last(counts: dict[tuple[int, int], int], k: int) -> _Last | None:
    """Where k clusters are reached, by the number of possible splits of each level and size; None: nowhere."""
    left = k - 1
    for level in sorted({level for level, _ in counts}):
        here = sorted(((size, n) for (at, size), n in counts.items() if at == level), reverse=True)
        if sum(n for _, n in here) <= left:
            left -= sum(n for _, n in here)
            continue
        for size, n in here:
            if n >= left:
                return _Last(level, size, left)
            left -= n
    return None


def fit_halves(
    points: DataFrame,
    columns: Sequence[str],
    k: int,
    max_iterations: int = MAX_ITERATIONS,
    seed: int = 1,
    group_rows: int = GROUP_ROWS,
) -> HalvedClusters:
    """``k`` clusters of the rows of ``points`` by bisecting K-means."""
    columns = tuple(columns)
    spark = points.sparkSession
    with Workspace(spark) as work:
        doubles = points.select(*(F.col(c).cast("double").alias(c) for c in columns)).na.drop()
        distinct = doubles.groupBy(*columns).agg(F.count("*").alias("weight"))
        rows = staged(distinct.select(F.lit(1).cast("long").alias("node"), *columns, "weight"), "halving-rows")
        rows, groups, planes = _split_large(rows, columns, k, max_iterations, seed, group_rows, work)
        small = [n for n, g in groups.items() if n not in planes and g.rows <= group_rows]

        splits = staged(_split_counts(_for_tasks(rows, small), columns, max_iterations, seed), "halving-counts")
        counts = {(r.level, r.size): r.n for r in splits.groupBy("level", "size").agg(F.sum("n").alias("n")).collect()}
        for n in planes:
            key = (_level(n), groups[n].size)
            counts[key] = counts.get(key, 0) + 1
        last = _last(counts, k)

        split, ties = set(planes), {}
        if last is not None:
            split = {n for n in planes if last.splits(_level(n), groups[n].size)}
            equal = sorted(n for n in split if (_level(n), groups[n].size) == (last.level, last.size))
            split -= set(equal[last.ties :])
            left = max(0, last.ties - len(equal))
            tied = splits.filter((F.col("level") == last.level) & (F.col("size") == last.size))
            for r in tied.orderBy("node").collect():
                ties[r.node] = min(left, r.n)
                left -= ties[r.node]
        alive = {n for n in groups if n == 1 or n >> 1 in split}
        small = [n for n in small if n in alive]
        leaves = sorted(alive - split - set(small))

        costs = _costs(rows, columns, groups, leaves, [n for n in groups if n not in planes and n not in small])
        none = [None] * len(columns)
        above = [
            (n, 0, groups[n].size, False, 0.0, planes[n][1], *planes[n][0].tolist(), *groups[n].centre.tolist()) for n in split
        ] + [(n, 0, groups[n].size, True, costs[n], None, *none, *groups[n].centre.tolist()) for n in leaves]
        below = _grown(_for_tasks(rows, small), columns, max_iterations, seed, last, ties)
        nodes = spark.createDataFrame(above, _node_schema(columns)).unionByName(below)
        nodes = work.keep(staged(nodes, "halved-clusters"))
    return HalvedClusters(nodes, columns, nodes.filter("leaf").agg(F.sum("cost")).first()[0] or 0.0)


def _costs(
    rows: DataFrame, columns: Sequence[str], groups: dict[int, _Group], leaves: Sequence[int], ends: Sequence[int]
) -> dict[int, float]:
    """The costs of the clusters that no task split; ``ends``: the nodes of their rows, at or below them."""
    if not leaves:
        return {}
    known, table = set(leaves), []
    for node in ends:
        leaf = node
        while leaf not in known:
            leaf >>= 1
        table.append((node, leaf, *groups[leaf].centre.tolist()))
    fields = ", ".join(["node long, leaf long", *(f"`c_{c}` double" for c in columns)])
    joined = rows.join(F.broadcast(rows.sparkSession.createDataFrame(table, fields)), "node")
    gap = squared_distance([F.col(c) for c in columns], [F.col(f"c_{c}") for c in columns])
    return dict(map(tuple, joined.groupBy("leaf").agg(F.sum(gap * F.col("weight"))).collect()))


def _down(at: np.ndarray, points: Sequence[np.ndarray], planes: pd.DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Where rows come to from the nodes ``at`` by the planes (node, cut, d_*)."""
    planes = planes.sort_values("node")
    nodes, cut = planes["node"].to_numpy(np.int64), planes["cut"].to_numpy(np.float64)
    across = planes[[f"d_{c}" for c in columns]].to_numpy(np.float64)
    at, live = at.copy(), np.arange(len(at))
    while len(live) and len(nodes):
        place = np.searchsorted(nodes, at[live])
        inside = np.append(nodes, -1)[place] == at[live]
        live, place = live[inside], place[inside]
        at[live] = 2 * at[live] + _beyond([x[live] for x in points], across, cut, place)
    return at


def assign_halves(model: HalvedClusters, points: DataFrame) -> DataFrame:
    """Add ``cluster_id`` by going down the planes; every other column stays on its row.

    A table of planes that is small enough goes to every task. Otherwise only those above the parts do, and the rows
    meet the planes of their part, at most about ``GROUP_ROWS`` rows in one place.
    """
    columns = model.columns
    planes = model.nodes.filter(~F.col("leaf")).select("part", "node", "cut", *(f"d_{c}" for c in columns))
    few = fits_broadcast(planes)
    first = (planes if few else planes.filter("part = 0")).drop("part").toPandas()

    def start(*here: pd.Series) -> pd.Series:
        return pd.Series(_down(np.ones(len(here[0]), np.int64), [x.to_numpy(np.float64) for x in here], first, columns))

    numbers = [F.col(c).cast("double") for c in columns]
    incomplete = reduce(or_, [c.isNull() | F.isnan(c) for c in numbers])
    reached: Column = F.pandas_udf(start, "long")(*numbers)
    if few:
        return points.withColumn("cluster_id", F.when(~incomplete, reached))
    names = points.columns
    found = points.withColumn("halving_at", F.when(incomplete, F.lit(0)).otherwise(reached))
    loads = found.groupBy(F.col("halving_at").alias("halving_of")).agg(
        F.ceil(F.count("*") / GROUP_ROWS).alias("halving_shares")
    )
    share = F.monotonically_increasing_id() % F.col("halving_shares")
    dealt = found.join(F.broadcast(loads), F.col("halving_at") == F.col("halving_of"))
    dealt = dealt.select(*names, "halving_at", share.alias("halving_share"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("halving_shares") - 1)).alias("halving_share")
    given = planes.filter("part != 0").join(F.broadcast(loads), F.col("part") == F.col("halving_of"))
    given = given.select("part", copies, "node", "cut", *(f"d_{c}" for c in columns))

    def descend(rows: pa.Table, below: pa.Table) -> pa.Table:
        here = [rows[c].cast(pa.float64()).to_numpy() for c in columns]
        at = _down(rows["halving_at"].to_numpy(), here, below.to_pandas(), columns)
        return rows.select(names).append_column("cluster_id", pa.array(at, pa.int64(), mask=at == 0))

    schema = points.select("*", F.lit(None).cast("long").alias("cluster_id")).schema
    grouped = dealt.groupBy("halving_at", "halving_share").cogroup(given.groupBy("part", "halving_share"))
    return grouped.applyInArrow(descend, schema)
