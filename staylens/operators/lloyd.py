"""Plain K-means: every row takes the nearest of all centres, centres move to the means of their rows.

The rule is that of Spark's own estimator with random starting centres: ``k`` rows are drawn, equal ones count once;
centres without rows stay; passes end after ``max_iterations`` or when no centre moves by more than ``TOLERANCE``.
Spark's estimator compares every row with every centre. Here the tasks look the nearest up in a tree of the centres
(``nearest``), which finds the same one, and equal rows are one row with a weight. Rows are dealt to tasks by the
starting centres near them and stay there. Centres are on the driver, as in Spark's estimator, and go to every task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.operators.nearest import CentreTree, centre_tree
from staylens.session import Workspace, staged

# A fit is done when no centre moves by more than this.
TOLERANCE = 1e-4
# Rows whose nearest centres a task looks up at once.
ROWS = 131_072


@dataclass(frozen=True)
class FittedMeans:
    """``centres``, the ``passes`` made, and the ``cost`` that the last met: the squared distances of all rows to the
    nearest centre, before the centres moved for the last time."""

    centres: np.ndarray
    passes: int
    cost: float


def _matrix(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    return np.stack([table[c].to_numpy() for c in columns], axis=1).astype(np.float64)


def _drawn(rows: DataFrame, columns: Sequence[str], k: int, seed: int) -> np.ndarray:
    """``k`` rows drawn at random, equal ones once; all if there are no more. About ``k`` come to the driver."""
    count = rows.count()
    share = (k + 6 * k**0.5 + 6) / max(1, count)
    while True:
        drawn = rows.select(*columns, F.rand(seed).alias("draw")).filter(F.col("draw") <= share).toArrow()
        if len(drawn) >= min(k, count):
            first = np.argsort(drawn["draw"].to_numpy(), kind="stable")[:k]
            return np.unique(_matrix(drawn, columns)[first], axis=0)
        share *= 2


def _sums(
    tree: CentreTree, columns: Sequence[str]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of rows, per centre: the rows, their sums, and the sum of squared distances."""
    names = [*columns, "weight"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.stack([batch.column(c).to_numpy() for c in names], axis=1).astype(np.float64)
            points, weights = np.ascontiguousarray(table[:, :-1]), table[:, -1]
            number = tree.nearest(points)
            place = np.empty(len(tree.numbers), np.int64)
            place[tree.numbers] = np.arange(len(place))
            squares = ((points - tree.centres[place[number]]) ** 2).sum(axis=1)
            found, of = np.unique(number, return_inverse=True)
            sums = [np.bincount(of, weights * x, len(found)) for x in (np.ones(len(points)), *points.T, squares)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (found, *sums)], names=["number", "weight", *columns, "squares"]
            )

    return summed


def fit_means(points: DataFrame, columns: Sequence[str], k: int, max_iterations: int, seed: int) -> FittedMeans:
    """At most ``k`` centres of the rows, without nulls, of ``points``."""
    columns = list(columns)
    spark = points.sparkSession
    rows = points.select(*(F.col(c).cast("double").alias(c) for c in columns))
    with Workspace(spark):
        rows = staged(rows, "means-rows")
        centres = _drawn(rows, columns, k, seed)
        if not len(centres):
            raise ValueError("no rows to fit clusters on")
        box = _of_rows(centre_tree(centres).boxes, "long")(F.struct(*columns))
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        # Rows of one box may be many; their columns divide them.
        dealt = (
            rows.groupBy(*columns)
            .agg(F.count("*").alias("weight"))
            .withColumn("box", box)
            .repartitionByRange(tasks, "box", *columns)
            .sortWithinPartitions("box", *columns)
        )
        dealt = staged(dealt.drop("box"), "means-points")
        shape = ", ".join(["number long", *(f"{c} double" for c in ["weight", *columns, "squares"])])
        passes, cost = 0, 0.0
        while passes < max_iterations:
            sums = dealt.mapInArrow(_sums(centre_tree(centres), columns), shape)
            sums = sums.groupBy("number").agg(*(F.sum(c).alias(c) for c in ["weight", *columns, "squares"])).toArrow()
            moved = centres.copy()
            moved[sums["number"].to_numpy()] = _matrix(sums, columns) / sums["weight"].to_numpy()[:, None]
            step = np.sqrt(((moved - centres) ** 2).sum(axis=1)).max()
            centres, passes, cost = moved, passes + 1, float(sums["squares"].to_numpy().sum())
            if step <= TOLERANCE:
                break
        return FittedMeans(centres, passes, cost)


def _of_rows(number: Callable[[np.ndarray], np.ndarray], kind: str) -> Callable[[Column], Column]:
    """A column function: what ``number`` gives for many rows of a struct of numbers at once."""

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.to_numpy(np.float64))
            if sum(map(len, held)) >= ROWS:
                yield pd.Series(number(np.concatenate(held)))
                held = []
        if held:
            yield pd.Series(number(np.concatenate(held)))

    return F.pandas_udf(numbers, kind)


def nearest_centre(centres: np.ndarray, columns: Sequence[str]) -> Column:
    """The number of the centre nearest to the row, of equally near ones the least."""
    return _of_rows(centre_tree(centres).nearest, "int")(F.struct(*(F.col(c).cast("double").alias(c) for c in columns)))
