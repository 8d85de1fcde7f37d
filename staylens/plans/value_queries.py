"""Registered queries on labels, clusters and the value model."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeansModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from staylens.operators import cleaning, cluster_tree, clusters, forest, forest_table, scaling, stays, value
from staylens.operators.joins import broadcast_if_small
from staylens.plans import flows
from staylens.plans import oracle_parts as parts
from staylens.plans.booking_queries import support
from staylens.plans.registry import query, rounded
from staylens.session import fresh_path, staged
from staylens.sources import files, standins

# Hotels for each fitted cluster: the number of clusters grows with the table.
HOTELS_PER_CLUSTER = 20


def _searches(spark, folder):
    return stays.search_features(standins.searches(spark, folder))


def _leads(spark, folder):
    return stays.lead_features(standins.leads(spark, folder))


def _branded(spark, folder):
    return value.clustered_hotels(support(spark, folder), standins.brand_clusters(spark, folder))


def _value_model(spark, folder, given=None):
    return flows.train_value_model(
        standins.places(spark, folder),
        standins.hotels(spark, folder),
        standins.leads(spark, folder),
        hotels_per_cluster=HOTELS_PER_CLUSTER,
        given=given,
    )


def _tree(spark, folder):
    known = support(spark, folder)
    return flows.hotel_clusters(known, clusters.cluster_count(known, HOTELS_PER_CLUSTER))


def _plain_clusters(spark, folder, method):
    """Clusters by Spark's own estimators, as many as the tree of clusters is asked for."""
    known = support(spark, folder)
    return flows.hotel_clusters(known, clusters.cluster_count(known, HOTELS_PER_CLUSTER), method=method)


def _gap(left, right):
    """Squared distance of two points whose columns bear the prefixes."""
    columns = [F.col(f"{left}{c}") - F.col(f"{right}{c}") for c in flows.POINT_COLUMNS]
    return reduce(add, [c * c for c in columns])


@query(
    "search_support_join",
    f"""WITH {parts.SUPPORT},{parts.stays("search")}
SELECT search.*, {parts.HOTEL_SIDE} FROM search JOIN support USING (hotel_id)""",
)
def search_support_join(spark, folder):
    return value.search_support_join(_searches(spark, folder), support(spark, folder))


@query(
    "score_matrix",
    f"""WITH {parts.SUPPORT},{parts.stays("search")}
SELECT search.*, coalesce(effrat, 0) AS effrat, rating, popularity, property_type, place_type_id,
       rank, coalesce(tot_facilities, 0) AS tot_facilities, coalesce(tot_themes, 0) AS tot_themes
FROM search JOIN support USING (hotel_id)""",
)
def score_matrix(spark, folder):
    return value.score_matrix(_searches(spark, folder), support(spark, folder))


@query(
    "cluster_leads_join",
    f"WITH {parts.LABELLED} SELECT * FROM clustered",
)
def cluster_leads_join(spark, folder):
    return value.cluster_leads_join(_leads(spark, folder), _branded(spark, folder))


@query(
    "cluster_mean",
    f"""WITH {parts.LABELLED}
SELECT cluster_id, round("meanUSD", 6) AS "meanUSD" FROM cluster_mean""",
)
def cluster_mean(spark, folder):
    means = value.cluster_mean(_leads(spark, folder), _branded(spark, folder))
    return rounded(means, 6, "meanUSD")


@query(
    "value_label",
    f"""WITH {parts.LABELLED}
SELECT * EXCLUDE ("meanUSD"), round("meanUSD", 6) AS "meanUSD" FROM labelled""",
)
def value_label(spark, folder):
    labelled = value.value_label(_leads(spark, folder), _branded(spark, folder))
    return rounded(labelled, 6, "meanUSD")


@query(
    "train_matrix",
    f"""WITH {parts.LABELLED}
SELECT lead_id, hotel_id, checkin_month, lead_month, leaddays, "effUSD",
       coalesce(effrat, 0) AS effrat, rating, popularity, property_type, place_type_id, rank,
       coalesce(tot_facilities, 0) AS tot_facilities, coalesce(tot_themes, 0) AS tot_themes,
       gooddeal
FROM labelled""",
)
def train_matrix(spark, folder):
    return value.train_matrix(value.value_label(_leads(spark, folder), _branded(spark, folder)))


@query("cluster_matrix", f"WITH {parts.CLUSTER_MATRIX} SELECT * FROM matrix")
def cluster_matrix(spark, folder):
    return clusters.cluster_matrix(support(spark, folder))


def _scores_sql(mean, sd):
    scores = ", ".join(
        f"round(({c} - {mean(c)}) / CASE WHEN {sd(c)} = 0 THEN 1 ELSE {sd(c)} END, 6)"
        f" + CAST(0 AS DOUBLE) AS z_{c}"
        for c in clusters.CLUSTER_FEATURES
    )
    return f"SELECT hotel_id, {scores}"


def _row_sql():
    names = clusters.CLUSTER_FEATURES
    mean = f"(({' + '.join(names)}) / {len(names)})"
    gaps = " + ".join(f"({c} - row_mean) * ({c} - row_mean)" for c in names)
    return f"""WITH {parts.CLUSTER_MATRIX},
with_mean AS (SELECT *, {mean} AS row_mean FROM matrix),
with_sd AS (SELECT *, sqrt(({gaps}) / {len(names)}) AS row_sd FROM with_mean)
{_scores_sql(lambda c: "row_mean", lambda c: "row_sd")} FROM with_sd"""


def _column_sql():
    names = clusters.CLUSTER_FEATURES
    moments = ", ".join(f"avg({c}) AS mean_{c}, stddev_pop({c}) AS sd_{c}" for c in names)
    return f"""WITH {parts.CLUSTER_MATRIX},
moments AS (SELECT {moments} FROM matrix)
{_scores_sql(lambda c: f"mean_{c}", lambda c: f"sd_{c}")} FROM matrix, moments"""


@query("rowwise_zscore", _row_sql())
def rowwise_zscore(spark, folder):
    points = clusters.clustering_points(support(spark, folder), axis="row")
    return rounded(points, 6, *flows.POINT_COLUMNS)


@query("column_zscore", _column_sql())
def column_zscore(spark, folder):
    points = clusters.clustering_points(support(spark, folder), axis="column")
    return rounded(points, 6, *flows.POINT_COLUMNS)


@query(
    "cluster_cost",
    f"""WITH long AS (
  SELECT vec_id, label, generate_subscripts(embedding, 1) AS i,
         CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings
),
centre AS (SELECT label, i, avg(x) AS c FROM long GROUP BY label, i),
gap AS (
  SELECT vec_id, sum((x - c) * (x - c)) AS squared FROM long JOIN centre USING (label, i)
  GROUP BY vec_id
)
SELECT round(sum(sqrt(squared)), 6) AS sum_distance, round(sum(squared), 6) AS sum_squared,
       count(*) AS points FROM gap""",
)
def cluster_cost(spark, folder):
    """Cost of the given clusters, their means as centres."""
    points, columns = standins.points(spark, folder), standins.point_columns()
    cost = clusters.cluster_cost(points, clusters.given_centres(points, columns), columns)
    return rounded(cost, 6, "sum_distance", "sum_squared")


@query(
    "test_error",
    """SELECT round(avg(CASE WHEN quality <> toxic THEN 1 ELSE 0 END), 6) AS test_error,
       count(*) AS rows FROM labels""",
)
def test_error(spark, folder):
    return rounded(forest.error_rate(standins.verdicts(spark, folder)), 6, "test_error")


@query(
    "mispredicted_rows",
    """SELECT doc_id, CAST(quality AS BIGINT) AS gooddeal, CAST(toxic AS BIGINT) AS prediction
FROM labels WHERE quality <> toxic""",
)
def mispredicted_rows(spark, folder):
    wrong = forest.mispredicted(standins.verdicts(spark, folder))
    return wrong.withColumns({c: F.col(c).cast("long") for c in ("gooddeal", "prediction")})


@query(
    "lead_sample",
    f"""WITH {parts.stays("lead")}
SELECT lead_id, hotel_id, total_usd FROM lead_raw
WHERE ('0x' || substr(md5(concat_ws('|', '0', lead_id)), 1, 8))::BIGINT % 10000 < 100""",
)
def lead_sample(spark, folder):
    """The 1 % sample of raw leads, by the hash of their ids."""
    sample = cleaning.sample_by_key(standins.leads(spark, folder), ["lead_id"], 0.01)
    return sample.select("lead_id", "hotel_id", "total_usd")


@query(
    "hash_split",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN ('0x' || substr(md5(concat_ws('|', '0', l_orderkey, l_linenumber, l_partkey,
            l_suppkey)), 1, 8))::BIGINT % 10000 < 7000 THEN 'train' ELSE 'test' END AS split
FROM lineitem""",
)
def hash_split(spark, folder):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return cleaning.hash_split(standins.table(spark, folder, "lineitem").select(*key), key)


# A fitted model has no SQL. The queries below work its results out a second, independent way and return
# where the two differ.


# Points and centres compared at once.
BATCH = 512


def _nearest_of_all(assigned, centres):
    """The sums of distances and of squared ones to the nearest of all centres. Each is met, by equal points once."""
    table = centres.select([f"c_{c}" for c in flows.POINT_COLUMNS]).toArrow()
    every = np.stack([c.to_numpy() for c in table.columns], axis=1)
    size = BATCH

    def least(*columns: pd.Series) -> pd.Series:
        points = np.stack([c.to_numpy(np.float64) for c in columns], axis=1)
        half = (every * every).sum(axis=1) / 2
        found = np.zeros(len(points))
        for row in range(0, len(points), size):
            here = points[row : row + size]
            gap, number = np.full(len(here), np.inf), np.zeros(len(here), np.int64)
            for low in range(0, len(every), size):
                # Half the squared distance, less the same for all centres.
                gaps = half[low : low + size] - here @ every[low : low + size].T
                near = gaps.argmin(axis=1)
                least_gap = gaps[np.arange(len(here)), near]
                better = least_gap < gap
                gap[better], number[better] = least_gap[better], low + near[better]
            found[row : row + size] = ((here - every[number]) ** 2).sum(axis=1)
        return pd.Series(found)

    tasks = assigned.sparkSession.sparkContext.defaultParallelism
    points = assigned.groupBy(*flows.POINT_COLUMNS).agg(F.count("*").alias("n"))
    nearest = points.repartition(tasks, *flows.POINT_COLUMNS).select(
        "n", F.pandas_udf(least, "double")(*flows.POINT_COLUMNS).alias("square")
    )
    return nearest.agg(F.sum(F.sqrt("square") * F.col("n")), F.sum(F.col("square") * F.col("n"))).first()


# Spark's K-means works distances out from norms, to about this precision.
FAST_DISTANCE = 1e-5


def _same(left, right, within=1e-9):
    """Equal but for the last digits, relative to the larger."""
    return F.abs(left - right) <= within * (1 + F.greatest(F.abs(left), F.abs(right)))


TREE_LEVELS = f"""WITH {parts.SUPPORT} SELECT hotel_id, true AS nearest FROM support"""


@query("kmeans_clusters", TREE_LEVELS)
def kmeans_clusters(spark, folder):
    """Every hotel, and whether each centre on its way down is the nearest of the group's."""
    tree, assigned = _tree(spark, folder)
    names = [f"c_{c}" for c in flows.POINT_COLUMNS]
    centres = staged(tree.centres.select("parent", "node", *names), "tree-check")
    family = centres.select("parent", "node", *names)
    # From the leaf up: the hotel's node on each level beside all nodes of the same parent.
    at = assigned.select("hotel_id", *flows.POINT_COLUMNS, F.col("cluster_id").alias("node"))
    checks = None
    for _ in range(tree.depth):
        own = at.join(family.filter("parent is not null"), "node").withColumn("own", _gap("", "c_")).drop(*names)
        others = own.join(family.withColumnRenamed("node", "other"), "parent").withColumn("gap", _gap("", "c_"))
        level = others.groupBy("hotel_id").agg((F.max("own") <= F.min("gap") + 1e-9).alias("nearest"))
        checks = level if checks is None else checks.unionByName(level)
        at = own.select("hotel_id", *flows.POINT_COLUMNS, F.col("parent").alias("node"))
    if checks is None:
        return at.select("hotel_id", F.lit(True).alias("nearest"))
    return checks.groupBy("hotel_id").agg(F.min("nearest").alias("nearest"))


@query("bisecting_clusters", f"WITH {parts.SUPPORT} SELECT hotel_id, true AS same_cost FROM support")
def bisecting_clusters(spark, folder):
    """Every hotel with clusters by halving, and whether distances to their centres sum to the model's own cost."""
    known = support(spark, folder)
    k = clusters.cluster_count(known, HOTELS_PER_CLUSTER)
    model, assigned = flows.hotel_clusters(known, k, method="bisecting")
    assigned = staged(assigned, "assigned")
    centres = clusters.model_centres(spark, model, flows.POINT_COLUMNS)
    cost = assigned.join(staged(centres, "centres"), "cluster_id").agg(F.sum(_gap("", "c_")))
    same = _same(cost.scalar(), F.lit(model.training_cost), FAST_DISTANCE)
    return assigned.select("hotel_id", same.alias("same_cost"))


@query(
    "kmeans_cost",
    f"WITH {parts.SUPPORT} SELECT count(*) AS points, true AS no_higher, true AS same FROM support",
)
def kmeans_cost(spark, folder):
    """The cost of plain K-means: the sum of distances of all hotels to their centre, and that of squared ones.

    ``no_higher``: the squares are within those of training, which states them before it moves the centres for the
    last time. ``same``: both sums are those of every hotel's nearest of all centres.
    """
    model, assigned = _plain_clusters(spark, folder, "kmeans")
    centres = staged(clusters.model_centres(spark, model, flows.POINT_COLUMNS), "centres")
    cost = clusters.cluster_cost(assigned, centres, flows.POINT_COLUMNS)
    distance, squared = _nearest_of_all(assigned, centres)
    own = model.summary.trainingCost
    same = _same(F.col("sum_distance"), F.lit(distance), FAST_DISTANCE) & _same(
        F.col("sum_squared"), F.lit(squared), FAST_DISTANCE
    )
    no_higher = F.col("sum_squared") <= own + 1e-9 * (1 + own)
    return cost.select("points", no_higher.alias("no_higher"), same.alias("same"))


@query(
    "kmeans_model_files",
    f"""WITH {parts.SUPPORT}
SELECT count(*) AS rows, CAST(0 AS BIGINT) AS differing FROM support""",
)
def kmeans_model_files(spark, folder):
    """Clusters from a saved and loaded model against those of the model itself."""
    model, assigned = _plain_clusters(spark, folder, "kmeans")
    path = fresh_path(spark, "kmeans")
    files.save_model(model, path)
    points = assigned.drop("cluster_id")
    again = clusters.assign_clusters(KMeansModel.load(path), points, flows.POINT_COLUMNS)
    return _differing(assigned, again)


@query(
    "cluster_tree_files",
    f"""WITH {parts.SUPPORT}
SELECT count(*) AS rows, CAST(0 AS BIGINT) AS differing FROM support""",
)
def cluster_tree_files(spark, folder):
    """Clusters from a saved and loaded tree of clusters against those of the tree itself."""
    tree, assigned = _tree(spark, folder)
    path = fresh_path(spark, "cluster-tree")
    cluster_tree.save_tree(tree, path)
    points = assigned.drop("cluster_id")
    return _differing(assigned, cluster_tree.assign_tree(cluster_tree.load_tree(spark, path), points))


def _differing(assigned, again):
    both = assigned.select("hotel_id", "cluster_id").join(
        again.select("hotel_id", F.col("cluster_id").alias("again")), "hotel_id"
    )
    differs = F.col("cluster_id") != F.col("again")
    return both.agg(F.count("*").alias("rows"), F.count_if(differs).alias("differing"))


HELD_OUT = f"""WITH {parts.LABELLED}
SELECT lead_id, gooddeal, true AS same FROM labelled
WHERE ('0x' || substr(md5(concat_ws('|', '1', lead_id)), 1, 8))::BIGINT % 10000 >= 7000"""


def _both_ways(model, matrix, kind):
    """The matrix' ids and whether the fitted forest and its SQL agree on the row."""
    kept = [c for c in matrix.columns if c not in forest.model_inputs(kind)]
    ready = forest.prepared(matrix, kind)
    votes = [F.expr(v).alias(f"votes_{i}") for i, v in enumerate(model.compiled.votes)]
    fitted = model.forest.transform(ready).select(
        *kept, *votes, "prediction", F.get(vector_to_array("probability"), F.lit(1)).alias("probability")
    )
    none, some = F.col("votes_0"), F.col("votes_1")
    same = _same(F.col("probability"), some / (none + some)) & (
        F.col("prediction") == F.when(some > none, 1.0).otherwise(0.0)
    )
    return fitted.select(*kept, same.alias("same"))


@query("rf_train_score", HELD_OUT)
def rf_train_score(spark, folder):
    """Held-out leads of the given clusters with their label, and whether the forest and its SQL agree."""
    model = _value_model(spark, folder, standins.brand_clusters(spark, folder))
    held = model.labelled.filter(F.col("split") == "test")
    return _both_ways(model, held, stays.LEAD).select("lead_id", "gooddeal", "same")


@query(
    "rf_model_files",
    f"""SELECT count(*) AS rows, CAST(0 AS BIGINT) AS differing FROM ({HELD_OUT})""",
)
def rf_model_files(spark, folder):
    """Scores of a saved and loaded forest against those of the compiled one."""
    model = _value_model(spark, folder, standins.brand_clusters(spark, folder))
    path = fresh_path(spark, "forest")
    files.save_model(model.forest, path)
    rows = model.labelled.filter(F.col("split") == "test")
    again = forest.score(PipelineModel.load(path), rows, stays.LEAD)
    both = model.held_out.select("lead_id", "probability").join(
        again.select("lead_id", F.col("probability").alias("again")), "lead_id"
    )
    differs = F.abs(F.col("probability") - F.col("again")) > 1e-9
    return both.agg(F.count("*").alias("rows"), F.count_if(differs).alias("differing"))


@query(
    "rf_tree_table",
    f"""SELECT count(*) AS rows, CAST(0 AS BIGINT) AS differing FROM ({HELD_OUT})""",
)
def rf_tree_table(spark, folder):
    """Scores found by walking the forest's table of nodes against those of the fitted forest."""
    model = _value_model(spark, folder, standins.brand_clusters(spark, folder))
    nodes = forest_table.forest_nodes(spark, model.forest)
    rows = model.labelled.filter(F.col("split") == "test")
    # The inputs stay beside the fitted forest's scores, so that nothing has to be joined again.
    beside = rows.withColumn("inputs", F.struct(*forest.model_inputs(stays.LEAD)))
    fitted = forest.score(model.forest, beside, stays.LEAD).select(
        "lead_id", F.col("prediction").alias("guess"), F.col("probability").alias("again"), "inputs.*"
    )
    ready = forest.prepared(fitted, stays.LEAD)
    both = forest_table.walk(nodes, ready, ["lead_id", "guess", "again"], forest.DEPTH)
    same = _same(F.col("probability"), F.col("again")) & (F.col("prediction") == F.col("guess"))
    return both.agg(F.count("*").alias("rows"), F.count_if(~same).alias("differing"))


@query(
    "rf_description",
    f"""SELECT unnest([{", ".join(f"'{n}'" for n in forest.model_inputs("lead").values())}]) AS feature,
       true AS same""",
)
def rf_description(spark, folder):
    """The inputs of the forest, and whether their weights follow from the gains in its table of nodes."""
    model = _value_model(spark, folder).forest
    stated = forest.describe_forest(spark, model)
    found = forest_table.importances(forest_table.forest_nodes(spark, model))
    both = stated.join(found.withColumnRenamed("importance", "again"), "feature")
    return both.select("feature", _same(F.col("importance"), F.col("again")).alias("same"))


@query(
    "score_search",
    f"""WITH {parts.SUPPORT},{parts.stays("search")}
SELECT search_id, hotel_id, true AS same FROM search JOIN support USING (hotel_id)""",
)
def score_search(spark, folder):
    """All searches scored by a model trained on all leads, and whether the forest and its SQL agree."""
    model = _value_model(spark, folder)
    known = broadcast_if_small(model.support)
    matrix = value.score_matrix(_searches(spark, folder), known)
    return _both_ways(model, matrix, stays.SEARCH).select("search_id", "hotel_id", "same")
