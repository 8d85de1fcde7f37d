"""The best unrated items of every user, without scoring all pairs.

A prediction is the product of a user's factors and an item's, so it is at most the product of their lengths.
Items are sorted by the length of their factors and taken in blocks, the longest first. After a block a user is
done if the k-th best found is above what the longest item left could reach; only the others meet the next
block. Blocks have a bounded number of items and are sent to the tasks whole, users are never grouped. Items that
a user has rated are left out block by block, so a user with half of all ratings lengthens no other's work.

Products are summed factor by factor in 64 bits, so equal factors give equal predictions; of equal predictions
the smaller item comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.recommendation import ALSModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.operators.id_book import in_order
from staylens.session import Workspace, staged

# Items in the first block and in the largest; each block has twice the items of the one before.
FIRST_BLOCK = 1024
LARGEST_BLOCK = 65_536

# Predictions that a task holds at once.
HELD = 1 << 22

# Lengths are rounded; a bound is taken as a little higher.
SLACK = 1 + 1e-9

STATE = "user int, factors array<double>, length double, found array<struct<score: double, item: int>>"


def _length(factors: str) -> Column:
    return F.sqrt(F.aggregate(factors, F.lit(0.0), lambda a, x: a + x * x))


def sorted_items(model: ALSModel) -> DataFrame:
    """Items by falling length of their factors: item, factors, length, place."""
    doubles = F.transform("features", lambda x: x.cast("double"))
    items = model.itemFactors.select(F.col("id").alias("item"), doubles.alias("factors"))
    return in_order(items.withColumn("length", _length("factors")), F.desc("length"), "item")


def _best(scores: np.ndarray, items: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best finite scores with their items, of equals the smaller item first."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= least
        scores, items = scores[near], items[near]
    order = np.lexsort((items, -scores))[:k]
    order = order[np.isfinite(scores[order])]
    return scores[order], items[order]


def _products(users: np.ndarray, items: np.ndarray) -> np.ndarray:
    out = np.zeros((len(users), len(items)))
    for factor in range(items.shape[1]):
        out += users[:, factor, None] * items[None, :, factor]
    return out


def _scored(users: DataFrame, block: tuple[np.ndarray, np.ndarray], low: int, k: int) -> DataFrame:
    """Users (state and ``rated`` places) with the best of what they had and of the block."""
    items, factors = block

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, HELD // max(1, len(items)))
        for part in parts:
            for at in range(0, part.num_rows, step):
                rows = part.slice(at, step)
                own = np.array(rows.column("factors").to_pylist(), dtype=np.float64).reshape(rows.num_rows, -1)
                scores = _products(own, factors)
                found = []
                for i, (had, rated) in enumerate(
                    zip(rows.column("found").to_pylist(), rows.column("rated").to_pylist(), strict=True)
                ):
                    if rated:
                        scores[i, np.array(rated) - low] = -np.inf
                    all_scores = np.concatenate([[h["score"] for h in had], scores[i]])
                    all_items = np.concatenate([[h["item"] for h in had], items]).astype(np.int64)
                    best = _best(all_scores, all_items, k)
                    found.append([{"score": float(s), "item": int(x)} for s, x in zip(*best, strict=True)])
                columns = [rows.column(c) for c in ("user", "factors", "length")]
                kind = pa.list_(pa.struct([("score", pa.float64()), ("item", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(found, kind)], names=["user", "factors", "length", "found"]
                )

    return users.select("user", "factors", "length", "found", "rated").mapInArrow(batches, STATE)


def best_unrated(
    ratings: DataFrame,
    model: ALSModel,
    users: DataFrame,
    k: int,
    first_block: int = FIRST_BLOCK,
    largest_block: int = LARGEST_BLOCK,
) -> DataFrame:
    """(user, item, prediction, place): the ``k`` best items that each user has not rated; a written table.

    ``users`` has the column ``user``; users that the model does not know are left out, users who rated
    everything have no rows.
    """
    spark = ratings.sparkSession
    with Workspace(spark) as work:
        items = sorted_items(model)
        count = items.count()
        doubles = F.transform("features", lambda x: x.cast("double"))
        known = model.userFactors.select(F.col("id").alias("user"), doubles.alias("factors"))
        wanted = users.select(F.col("user").cast("int").alias("user")).distinct()
        none = F.array().cast("array<struct<score: double, item: int>>")
        open_users = staged(
            known.join(wanted, "user").select("user", "factors", _length("factors").alias("length"), none.alias("found")),
            "open-users",
        )
        pairs = ratings.select(F.col("user").cast("int").alias("user"), F.col("item").cast("int").alias("item")).distinct()
        rated = staged(
            pairs.join(wanted, "user", "left_semi").join(items.select("item", "place"), "item").select("user", "place"),
            "rated-places",
        )
        done: list[DataFrame] = []
        low, size = 0, first_block
        while low < count and not open_users.isEmpty():
            high = min(count, low + size)
            inside = items.filter((F.col("place") >= low) & (F.col("place") < high))
            rows = inside.orderBy("place").select("item", "factors").toArrow()
            block = (
                rows.column("item").to_numpy(),
                np.array(rows.column("factors").to_pylist(), dtype=np.float64).reshape(rows.num_rows, -1),
            )
            # A user's rated items in one block, at most as many as the block has.
            here = rated.filter((F.col("place") >= low) & (F.col("place") < high))
            lists = here.groupBy(F.col("user").alias("rater")).agg(F.collect_list("place").alias("rated"))
            joined = open_users.join(lists, F.col("user") == F.col("rater"), "left")
            scored = staged(_scored(joined, block, low, k), "scored-users")
            longest = items.filter(F.col("place") == high).select("length").first()
            stays_open = F.lit(False)
            if longest is not None:
                reach = F.col("length") * (longest[0] * SLACK)
                stays_open = (F.size("found") < k) | (F.get("found", F.lit(k - 1))["score"] <= reach)
            done.append(staged(scored.filter(~stays_open).select("user", "found"), "done-users"))
            following = staged(scored.filter(stays_open), "open-users")
            work.release(open_users, scored)
            open_users = following
            low, size = high, min(largest_block, 2 * size)
        result = _listed(done, spark)
        return work.keep(staged(result, "best-items"))


def _listed(done: list[DataFrame], spark: SparkSession) -> DataFrame:
    if not done:
        return spark.createDataFrame([], "user int, item int, prediction double, place int")
    union = done[0]
    for other in done[1:]:
        union = union.unionByName(other)
    rows = union.select("user", F.posexplode("found").alias("place", "best"))
    return rows.select(
        "user",
        F.col("best.item").alias("item"),
        F.col("best.score").alias("prediction"),
        (F.col("place") + 1).alias("place"),
    )
