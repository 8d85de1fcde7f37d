"""Groups of comparable hotels."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.mllib.common import _py2java
from pyspark.mllib.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.functions.numbers import distance, squared_distance
from staylens.operators.cleaning import fill_numeric, numeric_cast
from staylens.operators.halving import HalvedClusters, assign_halves, fit_halves
from staylens.operators.joins import broadcast_if_small
from staylens.operators.lloyd import FittedMeans, fit_means, nearest_centre
from staylens.operators.scaling import scaled_names, zscore
from staylens.session import staged

# The columns hotels are compared by.
CLUSTER_FEATURES = [
    "effrat",
    "rating",
    "popularity",
    "property_type",
    "place_type_id",
    "rank",
    "tot_facilities",
    "tot_themes",
    "latitude",
    "longitude",
]

# Training parameters.
DEFAULT_K = 35_000
MAX_ITERATIONS = 15


def cluster_matrix(support: DataFrame) -> DataFrame:
    """One numeric row per hotel, nulls 0, the id kept and never cast."""
    narrow = support.select("hotel_id", *CLUSTER_FEATURES)
    return fill_numeric(numeric_cast(narrow, keep=("hotel_id",)), keep=("hotel_id",)).dropDuplicates()


def clustering_points(support: DataFrame, axis: str = "row") -> DataFrame:
    """The scaled matrix, ``z_*`` columns beside the hotel id."""
    scaled = zscore(cluster_matrix(support), CLUSTER_FEATURES, axis)
    return scaled.select("hotel_id", *scaled_names(CLUSTER_FEATURES))


def cluster_count(support: DataFrame, hotels_per_cluster: int) -> int:
    """So many clusters that each has about so many hotels; grows with the table."""
    return max(2, -(-support.count() // hotels_per_cluster))


def root_count(support: DataFrame) -> int:
    """The square root of the hotels: as many clusters as plain K-means, which compares all, can bear."""
    return max(2, math.isqrt(support.count()))


def _as_spark_model(fit: FittedMeans, points: DataFrame, columns: Sequence[str], **params) -> KMeansModel:
    """Spark ML's model of centres found here, with the parameters and the summary that its estimator gives."""
    spark = points.sparkSession
    ml, mllib = (spark._jvm.org.apache.spark.ml.clustering, spark._jvm.org.apache.spark.mllib.clustering)
    held = mllib.KMeansModel(_py2java(spark.sparkContext, [Vectors.dense(c) for c in fit.centres]))
    model = KMeansModel(ml.KMeansModel(f"KMeans_{uuid.uuid4().hex[:12]}", held))
    for name, value in params.items():
        model.set(model.getParam(name), value)
    assembled = VectorAssembler(inputCols=list(columns), outputCol=model.getFeaturesCol()).transform(points)
    told = model.transform(assembled)._jdf
    summary = ml.KMeansSummary(
        told, model.getPredictionCol(), model.getFeaturesCol(), len(fit.centres), fit.passes, fit.cost
    )
    model._java_obj.setSummary(spark._jvm.scala.Some(summary))
    return model


def train_clusters(
    points: DataFrame,
    columns: Sequence[str],
    k: int = DEFAULT_K,
    max_iterations: int = MAX_ITERATIONS,
    seed: int = 1,
    method: str = "kmeans",
) -> KMeansModel | HalvedClusters:
    """K-means from random starting centres, or by halving groups with ``method="bisecting"``.

    Plain K-means takes the nearest of all centres for every row in each pass and keeps the centres on the driver;
    a tree of the centres spares it most comparisons, how many depends on how the rows lie.
    Halving compares a row with two centres on each level, and its centres are a table.
    """
    if method == "bisecting":
        return fit_halves(points, columns, k, max_iterations, seed)
    if method != "kmeans":
        raise ValueError("method is 'kmeans' or 'bisecting'")
    fit = fit_means(points, columns, k, max_iterations, seed)
    return _as_spark_model(
        fit, points, columns, k=k, maxIter=max_iterations, initMode="random", seed=seed, predictionCol="cluster_id"
    )


def assign_clusters(
    model: KMeansModel | HalvedClusters, points: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """Add ``cluster_id``; every other column, the id among them, stays on its row."""
    if isinstance(model, HalvedClusters):
        return assign_halves(model, points)
    # A short table may lie in one file, yet looking its rows up is work for all tasks.
    tasks = points.sparkSession.sparkContext.defaultParallelism
    if points.rdd.getNumPartitions() < tasks:
        points = points.repartition(tasks, *columns)
    return points.withColumn("cluster_id", nearest_centre(np.array(model.clusterCenters()), columns))


def model_centres(spark: SparkSession, model: KMeansModel | HalvedClusters, columns: Sequence[str]) -> DataFrame:
    """The centres as rows (cluster_id, c_<column>...); as many as the model holds anyway."""
    if isinstance(model, HalvedClusters):
        return model.leaves()
    schema = T.StructType(
        [T.StructField("cluster_id", T.IntegerType())]
        + [T.StructField(f"c_{c}", T.DoubleType()) for c in columns]
    )
    rows = [(i, *map(float, centre)) for i, centre in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, schema)


def given_centres(points: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mean point of each given cluster; partial sums before the shuffle."""
    return points.groupBy("cluster_id").agg(*(F.avg(c).alias(f"c_{c}") for c in columns))


def cluster_cost(
    assigned: DataFrame, centres: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """One row: the sum of distances to the centre, the sum of squared ones, and the points.

    The centres are written once; if their counted rows are few enough they go to every task, so
    that the points, which have few clusters, need not shuffle by them.
    """
    lookup = broadcast_if_small(staged(centres, "centres"))
    here = [F.col(c).cast("double") for c in columns]
    there = [F.col(f"c_{c}") for c in columns]
    return assigned.join(lookup, "cluster_id").agg(
        F.sum(distance(here, there)).alias("sum_distance"),
        F.sum(squared_distance(here, there)).alias("sum_squared"),
        F.count("*").alias("points"),
    )
