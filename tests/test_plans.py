"""The plans hold what the design promises: few shuffles, pruned scans, no all-pairs joins,
and hot keys divided."""

import contextlib
import re

import pytest
from pyspark.sql import functions as F

from staylens.operators import clusters, joins, ratings, stays, value
from staylens.operators.affinity import user_feature_affinity
from staylens.plans import value_queries
from staylens.plans.catalogue import QUERIES
from staylens.session import fresh_path
from staylens.sources import standins

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    """The executed plan as text, before running."""
    return df._jdf.queryExecution().executedPlan().toString()


def plan_after_run(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@contextlib.contextmanager
def settings(spark, **values):
    """Spark settings for the time of one test."""
    names = {k.replace("__", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def no_broadcast(spark):
    return settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold=-1,
        spark__sql__adaptive__autoBroadcastJoinThreshold=-1,
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB",
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )


def written(spark, df, parts):
    """``df`` as a table of several files, so that several tasks read it."""
    path = fresh_path(spark, "plan-input")
    df.repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


def hot_searches(spark, rows=60_000):
    """A third of all searches ask for hotel 0."""
    n = F.col("id")
    return written(
        spark,
        spark.range(rows).select(
            n.cast("string").alias("search_id"),
            F.when(n % 3 == 0, 0).otherwise(n % 997).cast("long").alias("hotel_id"),
            (n % 13).cast("int").alias("checkin_month"), (n % 12).cast("int").alias("search_month"),
            (n % 90).cast("int").alias("searchdays"), F.rand(3).alias("effUSD"),
        ),
        8,
    )


def known_hotels(spark):
    n = F.col("id")
    return written(
        spark,
        spark.range(997).select(
            n.alias("hotel_id"), n.cast("double").alias("effrat"), (n % 13).cast("int").alias("rating"),
            n.cast("double").alias("popularity"), (n % 3).cast("int").alias("property_type"),
            (n % 4).cast("int").alias("place_type_id"), n.cast("double").alias("rank"),
            (n % 9).alias("tot_facilities"), (n % 9).alias("tot_themes"),
            (n % 2).cast("int").alias("cluster_id"),
        ),
        2,
    )


def test_features_shuffle_once(spark):
    raw = standins.searches(spark, FOLDER)
    assert plan_of(stays.search_features(raw)).count("Exchange hashpartitioning") == 1
    assert "Exchange hashpartitioning" not in plan_of(stays.search_features(raw, dedupe=False))


def test_scans_read_only_what_is_used(spark):
    plan = plan_of(QUERIES["dedupe_rows"](spark, FOLDER))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan
    subset = plan_of(ratings.user_subset(standins.ratings(spark, FOLDER), 5))
    assert re.search(r"PushedFilters: \[.*LessThanOrEqual\(user_id,5\)", subset)


def test_hot_hotel_is_divided(spark):
    with no_broadcast(spark):
        joined = value.search_support_join(hot_searches(spark), known_hotels(spark))
        assert "SortMergeJoin(skew=true)" in plan_after_run(joined)
        assert joined.count() == 60_000


def test_hot_hotel_is_divided_for_labels(spark):
    leads = hot_searches(spark).withColumnsRenamed(
        {"search_id": "lead_id", "search_month": "lead_month", "searchdays": "leaddays"}
    )
    with no_broadcast(spark):
        labelled = value.value_label(leads, known_hotels(spark))
        plan = plan_after_run(labelled)
        assert "SortMergeJoin(skew=true)" in plan
        # Rows of the clusters meet in sums only: no shuffle of leads by cluster.
        assert labelled.count() == 60_000
    assert "Window" not in plan


def test_hot_item_is_divided_in_the_affinity(spark):
    n = F.col("id")
    known = written(
        spark,
        spark.range(40_000).select(
            (n % 5000).alias("user"), F.when(n % 3 == 0, 0).otherwise(n).cast("int").alias("item"),
            F.lit(1.0).alias("rating"), F.sha2(n.cast("string"), 256).alias("pad"),
        ),
        8,
    )
    weights = written(
        spark,
        spark.range(40_000).select(
            n.cast("int").alias("item"), (n % 7).cast("string").alias("feature"), F.lit(1.0).alias("tfidf")
        ),
        2,
    )
    with no_broadcast(spark), settings(
        spark, spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="5KB",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="5KB",
    ):
        found = user_feature_affinity(known, weights)
        assert "SortMergeJoin(skew=true)" in plan_after_run(found)
        assert found.agg(F.sum("affinity")).first()[0] == 40_000.0


def test_broadcast_is_checked_and_has_another_way(spark):
    hotels = known_hotels(spark)
    with settings(spark, spark__sql__autoBroadcastJoinThreshold=-1):
        fitting = joins.broadcast_if_small(hotels)
        assert "BroadcastHashJoin" in plan_of(value.search_support_join(hot_searches(spark), fitting))
        large = joins.broadcast_if_small(hotels, limit=997 * 8)
        assert "SortMergeJoin" in plan_of(value.search_support_join(hot_searches(spark), large))
    assert not joins.fits_broadcast(spark.createDataFrame([("text",)], "t string"))


def test_rank_limit_acts_before_the_shuffle(spark):
    plan = plan_of(ratings.top_k_items(standins.ratings(spark, FOLDER), 3))
    assert plan.index("Window [") < plan.index("WindowGroupLimit")
    assert "Final" in plan and "Partial" in plan


def test_sorted_limit_is_a_top_n(spark):
    assert "TakeOrderedAndProject" in plan_of(ratings.sorted_limit(standins.ratings(spark, FOLDER), 5))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_all_pairs_join(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["kmeans_cost", "kmeans_model_files"])
def test_plain_clusters_are_as_many_as_the_hotels_ask_for(spark, monkeypatch, name):
    asked, train = [], clusters.train_clusters
    monkeypatch.setattr(clusters, "train_clusters", lambda *a, **k: asked.append(k["k"]) or train(*a, **k))
    QUERIES[name](spark, FOLDER)
    hotels = standins.table(spark, FOLDER, "part").count()
    assert asked == [hotels // value_queries.HOTELS_PER_CLUSTER] and asked[0] > 4
