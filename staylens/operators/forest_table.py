"""A fitted forest as a table of nodes and as plain SQL.

A saved forest is a table already: one row for each node. It is read from there, not from the driver's text of
the trees. From the table the whole forest compiles into nested CASE expressions, so that scoring is a
projection without vectors; the same text runs in any SQL engine that knows CASE and IN. The number of nodes is
bounded by the parameters of training, trees x 2 ** (depth + 1), whatever the rows were.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staylens.operators.forest import model_inputs, prepared, score
from staylens.session import fresh_path, remove_path, staged

# The columns of a saved forest's nodes.
NODE = """treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>,
rawCount: bigint, gain: double, leftChild: int, rightChild: int,
split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"""

# What stands for no child in a leaf.
LEAF = -1


def saved_nodes(spark: SparkSession, path: str, kind: str = "lead") -> DataFrame:
    """The nodes of a forest saved with its assembler: one row for each tree and node.

    ``feature`` is the input that divides an inner node, by ``threshold`` (left at or below it) or by
    ``categories`` (left if among them). A leaf has neither feature nor children. ``votes`` are its training rows
    by class, ``gain`` is what the division gained.
    """
    names = F.array(*(F.lit(n) for n in model_inputs(kind).values()))
    node, split = F.col("nodeData"), F.col("nodeData.split")
    inner = node["leftChild"] != LEAF
    numeric = split["numCategories"] == -1
    return spark.read.schema(NODE).parquet(f"{path}/stages/*/data").select(
        F.col("treeID").alias("tree"),
        node["id"].alias("node"),
        F.when(inner, F.get(names, split["featureIndex"])).alias("feature"),
        F.when(inner & numeric, F.get(split["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.when(inner & ~numeric, split["leftCategoriesOrThreshold"]).alias("categories"),
        F.when(inner, node["leftChild"]).alias("left"),
        F.when(inner, node["rightChild"]).alias("right"),
        F.when(inner, node["gain"]).alias("gain"),
        node["impurityStats"].alias("votes"),
    )


def forest_nodes(spark: SparkSession, model: PipelineModel, kind: str = "lead") -> DataFrame:
    """The nodes of a fitted forest, through its saved form; the table is staged."""
    path = fresh_path(spark, "forest-save")
    model.write().overwrite().save(path)
    try:
        return staged(saved_nodes(spark, path, kind), "forest-nodes")
    finally:
        remove_path(spark, path)


# -- SQL


def _number(value: float) -> str:
    """A double literal in Spark and in other engines; without an exponent it would be a decimal."""
    text = repr(float(value))
    return text if "e" in text else f"{text}e0"


@dataclass(frozen=True)
class ForestSql:
    """SQL texts over the model inputs: for each class the trees' summed votes."""

    votes: tuple[str, str]

    @property
    def probability(self) -> str:
        """Of class 1."""
        return f"({self.votes[1]}) / (({self.votes[0]}) + ({self.votes[1]}))"

    @property
    def prediction(self) -> str:
        """The class with more votes, 0 where they are equal."""
        return f"CASE WHEN ({self.votes[1]}) > ({self.votes[0]}) THEN 1 ELSE 0 END"


def forest_sql(nodes: DataFrame) -> ForestSql:
    """The forest compiled from its table of nodes. Each tree votes with the shares of its leaf's classes."""
    trees: dict[int, dict] = {}
    for row in nodes.collect():
        trees.setdefault(row.tree, {})[row.node] = row

    def text(tree: dict, at: int, label: int) -> str:
        row = tree[at]
        if row.feature is None:
            whole = sum(row.votes)
            return _number(row.votes[label] / whole if whole and label < len(row.votes) else 0.0)
        if row.categories is None:
            goes_left = f"{row.feature} <= {_number(row.threshold)}"
        else:
            goes_left = f"{row.feature} IN ({', '.join(map(_number, row.categories))})"
        return f"CASE WHEN {goes_left} THEN {text(tree, row.left, label)} ELSE {text(tree, row.right, label)} END"

    def votes(label: int) -> str:
        return " + ".join(text(trees[t], 0, label) for t in sorted(trees))

    return ForestSql((votes(0), votes(1)))


def score_sql(
    compiled: ForestSql,
    matrix: DataFrame,
    kind: str,
    categories: dict[str, int] | None = None,
    out_of_range: str = "error",
) -> DataFrame:
    """What ``forest.score`` gives, from the compiled forest: a projection without vectors."""
    kept = [c for c in matrix.columns if c not in model_inputs(kind)]
    ready = prepared(matrix, kind, categories, out_of_range)
    none, some = F.col("votes_0"), F.col("votes_1")
    voted = ready.select(*kept, *(F.expr(v).alias(f"votes_{i}") for i, v in enumerate(compiled.votes)))
    return voted.select(
        *kept,
        F.when(some > none, 1).otherwise(0).alias("prediction"),
        (some / (none + some)).alias("probability"),
    )


def score_with(
    model: PipelineModel | ForestSql, matrix: DataFrame, kind: str, out_of_range: str = "error"
) -> DataFrame:
    """Scores by a compiled forest or a fitted one; they are the same."""
    if isinstance(model, ForestSql):
        return score_sql(model, matrix, kind, out_of_range=out_of_range)
    return score(model, matrix, kind, out_of_range=out_of_range)


# -- the table itself


def walk(nodes: DataFrame, ready: DataFrame, ids: list[str], depth: int) -> DataFrame:
    """Scores found by walking the table: ids, ``prediction`` and ``probability``.

    ``ready`` holds the ids and the model inputs. The table, at most trees * 2 ** (depth + 1) rows, goes to the tasks
    as arrays; a batch of rows takes one step at a time through each tree, and nothing moves.
    """
    inputs = [c for c in ready.columns if c not in ids]
    table = sorted(nodes.collect(), key=lambda r: (r.tree, r.node))
    place = {(r.tree, r.node): i for i, r in enumerate(table)}
    inner = [r.feature is not None for r in table]
    feature = np.array([inputs.index(r.feature) if r.feature is not None else 0 for r in table])
    threshold = np.array([np.nan if r.threshold is None else r.threshold for r in table])
    chosen = np.zeros((len(table), 1 + int(max((max(r.categories) for r in table if r.categories), default=0))), bool)
    for i, r in enumerate(table):
        if r.categories:
            chosen[i, np.array(r.categories, int)] = True
    left, right = (
        np.array([place[r.tree, r[side]] if r.feature is not None else i for i, r in enumerate(table)])
        for side in ("left", "right")
    )
    shares = np.array([[r.votes[c] / sum(r.votes) if c < len(r.votes) and sum(r.votes) else 0.0 for c in (0, 1)] for r in table])
    roots = [i for i, r in enumerate(table) if r.node == 0]
    categorical = np.array([r.categories is not None for r in table])
    some_inner = any(inner)

    def walked(*columns: pd.Series) -> pd.DataFrame:
        rows = np.arange(len(columns[0]))
        every = np.stack([c.to_numpy(np.float64) for c in columns], axis=1)
        votes = np.zeros((len(rows), 2))
        for root in roots:
            at = np.full(len(rows), root)
            for _ in range(depth if some_inner else 0):
                value = every[rows, feature[at]]
                whole = (value >= 0) & (value < chosen.shape[1]) & (value == np.floor(value))
                among = whole & chosen[at, np.where(whole, value, 0).astype(int)]
                at = np.where(np.where(categorical[at], among, value <= threshold[at]), left[at], right[at])
            votes += shares[at]
        return pd.DataFrame({"votes_0": votes[:, 0], "votes_1": votes[:, 1]})

    found = F.pandas_udf(walked, "votes_0 double, votes_1 double")(*inputs)
    none, some = F.col("votes.votes_0"), F.col("votes.votes_1")
    return ready.select(*ids, found.alias("votes")).select(
        *ids, F.when(some > none, 1).otherwise(0).alias("prediction"), (some / (none + some)).alias("probability")
    )


def importances(nodes: DataFrame, kind: str = "lead") -> DataFrame:
    """The weight of each input: its gains times rows, as a share in each tree, then over the trees."""
    rows = F.aggregate("votes", F.lit(0.0), lambda a, x: a + x)
    gains = (
        nodes.filter("feature is not null")
        .withColumn("gain", F.col("gain") * rows)
        .groupBy("tree", "feature")
        .agg(F.sum("gain").alias("gain"))
    )
    # At most trees * inputs rows from here on.
    share = gains.withColumn("share", F.col("gain") / F.sum("gain").over(Window.partitionBy("tree")))
    summed = share.groupBy("feature").agg(F.sum("share").alias("share"))
    weight = F.col("share") / F.sum("share").over(Window.partitionBy(F.lit(1)))
    known = summed.select("feature", weight.alias("importance"))
    inputs = nodes.sparkSession.createDataFrame([(n,) for n in model_inputs(kind).values()], "feature string")
    return inputs.join(F.broadcast(known), "feature", "left").select(
        "feature", F.coalesce("importance", F.lit(0.0)).alias("importance")
    )

