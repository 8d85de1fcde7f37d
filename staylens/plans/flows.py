"""The three flows: train the value model, score searches, recommend."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.operators import cluster_tree, clusters, forest, forest_table, halving, value
from staylens.operators.affinity import user_feature_affinity
from staylens.operators.cleaning import hash_split
from staylens.operators.content import tfidf_long
from staylens.operators.hotels import SUPPORT_COLUMNS, support_table
from staylens.operators.joins import broadcast_if_small, fits_broadcast
from staylens.operators.ratings import distinct_items
from staylens.operators.recommender import completed
from staylens.operators.scaling import scaled_names
from staylens.operators.stays import LEAD, SEARCH, lead_features, search_features
from staylens.session import Workspace, staged

POINT_COLUMNS = scaled_names(clusters.CLUSTER_FEATURES)

ClusterModel = cluster_tree.ClusterTree | KMeansModel | halving.HalvedClusters


def hotel_clusters(
    support: DataFrame, k: int, seed: int = 1, axis: str = "row", method: str = "tree"
) -> tuple[ClusterModel, DataFrame]:
    """Fit clusters on the hotels and give each hotel its own (``z_*`` columns kept).

    ``tree`` compares a hotel with the centres of its own group alone and so suits very many clusters;
    ``kmeans`` compares it with all of them, ``bisecting`` halves groups.
    """
    points = staged(clusters.clustering_points(support, axis), "points")
    if method == "tree":
        tree = cluster_tree.fit_tree(points, POINT_COLUMNS, k=k, seed=seed)
        return tree, cluster_tree.assign_tree(tree, points)
    model = clusters.train_clusters(points, POINT_COLUMNS, k=k, seed=seed, method=method)
    return model, clusters.assign_clusters(model, points, POINT_COLUMNS)


@dataclass(frozen=True)
class ValueModel:
    """A fitted flow: the forest, the clusters, the support table and the held-out scores.

    ``compiled`` is the forest as SQL.
    """

    forest: PipelineModel
    clusters: ClusterModel | None
    support: DataFrame
    labelled: DataFrame
    held_out: DataFrame
    compiled: forest_table.ForestSql


def train_value_model(
    places: DataFrame,
    hotels: DataFrame,
    leads: DataFrame,
    k: int = clusters.DEFAULT_K,
    seed: int = 1,
    axis: str = "row",
    method: str = "tree",
    hotels_per_cluster: int | None = None,
    given: DataFrame | None = None,
    out_of_range: str = "error",
) -> ValueModel:
    """Support table, clusters, labels, then a forest on 70 % of all leads.

    ``hotels_per_cluster`` sets k by the number of hotels. ``given`` (hotel_id, cluster_id) takes the
    place of fitted clusters. ``out_of_range``: see ``forest.prepared``. Of the tables written on the way
    the support table, the train matrix and the centres stay, the others are removed.
    """
    spark = hotels.sparkSession
    with Workspace(spark) as work:
        support = work.keep(staged(support_table(places, hotels), "support"))
        if given is not None:
            means, assigned = None, given
        else:
            if hotels_per_cluster is not None:
                k = clusters.cluster_count(support, hotels_per_cluster)
            means, assigned = hotel_clusters(support, k, seed, axis, method)
        grouped = staged(value.clustered_hotels(support, assigned), "clustered-hotels")
        small = fits_broadcast(grouped, extra_columns=1)
        labelled = value.value_label(lead_features(leads), grouped, hotels_fit=small)
        split = hash_split(value.train_matrix(labelled), ["lead_id"], 0.7, seed)
        matrix = work.keep(staged(split, "train-matrix", rows_per_file=forest.FIT_ROWS))
        train = matrix.filter(F.col("split") == "train")
        model = forest.train_forest(train, LEAD, seed, out_of_range=out_of_range)
        compiled = forest_table.forest_sql(forest_table.forest_nodes(spark, model))
        if isinstance(means, cluster_tree.ClusterTree):
            work.keep(means.centres)
        if isinstance(means, halving.HalvedClusters):
            work.keep(means.nodes)
    held_out = forest_table.score_sql(
        compiled, matrix.filter(F.col("split") == "test"), LEAD, out_of_range=out_of_range
    )
    return ValueModel(model, means, support, matrix, held_out, compiled)


def score_searches(
    searches: DataFrame,
    support: DataFrame,
    model: PipelineModel | forest_table.ForestSql,
    out_of_range: str = "error",
    ids: Sequence[str] = (),
) -> DataFrame:
    """Every search with a known hotel: prediction 1 for great value, 0 for not, ids kept.

    A compiled forest scores in one projection, a fitted one through its vectors; the scores are the same.

    ``support`` is a written table; it is broadcast if its counted rows are few enough. ``ids``
    are further id columns to keep, such as ``usersearch_id``.
    """
    known = broadcast_if_small(support.select(*SUPPORT_COLUMNS))
    matrix = value.score_matrix(search_features(searches, ids=ids), known, ids)
    return forest_table.score_with(model, matrix, SEARCH, out_of_range)


def recommend_features(ratings: DataFrame, content: DataFrame, model, num_users: int) -> DataFrame:
    """Affinity of users 1..``num_users`` to features, from known and predicted ratings."""
    weights = tfidf_long(content, items=distinct_items(ratings))
    return user_feature_affinity(completed(ratings, model, num_users), weights)
