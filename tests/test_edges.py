"""Edge cases of scans, numbers, pairs, recommendations and carried ids."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_plans import FOLDER, plan_of

from staylens.functions.numbers import as_number
from staylens.functions.stay import guest_totals
from staylens.functions.text import positive_tokens
from staylens.operators import cleaning, clusters, content, ratings, recommender, stays, value
from staylens.plans import flows
from staylens.session import staged
from staylens.sources import files, standins

RATING = T.StructType(
    [
        T.StructField("user", T.LongType()),
        T.StructField("item", T.LongType()),
        T.StructField("rating", T.DoubleType()),
    ]
)


def test_folder_with_another_header_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("user,item,rating\n7,8,9.5\n")
    (tmp_path / "b.csv").write_text("user,item,rating\n1,2,3.5\n")
    rows = files.read_headed_csv(spark, str(tmp_path), RATING).collect()
    assert sorted(map(tuple, rows)) == [(1, 2, 3.5), (7, 8, 9.5)]
    (tmp_path / "c.csv").write_text("item,user,rating\n8,7,9.5\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_headed_csv(spark, str(tmp_path), RATING).collect()


def test_columns_by_name_in_any_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("rating,other,item,user\n9.5,x,8,7\n")
    assert tuple(files.read_headed_csv(spark, str(tmp_path), RATING).first()) == (7, 8, 9.5)


def test_text_that_states_no_number(spark):
    texts = ["nan", "1d", "inf", "x", "2", " 2.5 ", "-3", "+4", "2f", "1e3", "", ".5", "Infinity", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(as_number(F.col("t"))).collect()]
    assert got == [None, None, None, None, 2.0, 2.5, -3.0, 4.0, *[None] * 6]
    cast = [r[0] for r in cleaning.numeric_cast(df).collect()]
    assert cast == got
    one = spark.createDataFrame([("nan|1d|inf|x|2", "nan|2f:3|2")], "tokens string, rooms string")
    row = one.select(positive_tokens(F.col("tokens")).alias("n"), guest_totals(F.col("rooms")).alias("g")).first()
    assert row.n == 1 and (row.g.adults, row.g.kids) == (2.0, 1)


@pytest.mark.parametrize("users,block", [(0, 4), (-1, 4), (1, 4), (4, 4), (5, 4), (9, 4), (3, 1)])
def test_pairs_expand_in_blocks(spark, monkeypatch, users, block):
    monkeypatch.setattr(ratings, "USER_BLOCK", block)
    rated = spark.createDataFrame([(1, 10, 1.0), (2, 20, 1.0)], RATING)
    pairs = sorted(map(tuple, ratings.user_item_pairs(rated, users).select("user", "item").collect()))
    assert pairs == [(u, i) for u in range(1, users + 1) for i in (10, 20)]


def test_only_the_subset_is_read_for_its_own_ratings(spark):
    rated = spark.read.parquet(f"{FOLDER}/events.parquet").select(
        F.col("user_id").alias("user"), F.col("event_id").alias("item"), F.col("value").alias("rating")
    )
    own = ratings.user_subset(rated, 5)
    plan = plan_of(ratings.unrated_pairs(ratings.user_item_pairs(rated, 5), own))
    scans = [x for x in plan.splitlines() if "PushedFilters" in x]
    assert sum("LessThanOrEqual(user_id,5)" in x for x in scans) == 1


def test_recommended_items_are_unrated_and_best(spark):
    rows = [(u, i, float((u * i) % 5)) for u in range(1, 9) for i in range(1, 13) if (u + i) % 3]
    rated = spark.createDataFrame(rows, RATING)
    model = recommender.train_als(rated, rank=4, iterations=3)
    users = spark.createDataFrame([(1,), (2,), (2,), (99,)], "user long")
    found = recommender.recommend_items(rated, model, users, 3).collect()
    seen = {(u, i) for u, i, _ in rows}
    assert {r.user for r in found} == {1, 2} and len(found) == 6
    assert not any((r.user, r.item) in seen for r in found)
    guesses = recommender.predict(model, spark.createDataFrame([(u, i) for u in (1, 2) for i in range(1, 13)], "user long, item long"))
    best = {u: sorted((-g.prediction, g.item) for g in guesses.collect() if g.user == u and (u, g.item) not in seen)[:3] for u in (1, 2)}
    assert {(r.user, r.item) for r in found} == {(u, i) for u in best for _, i in best[u]}
    assert found[0].asDict().keys() == {"user", "item", "prediction", "place"}


def test_search_group_ids_are_carried(spark):
    searches = standins.searches(spark, FOLDER).withColumn("usersearch_id", F.substring_index("search_id", "-", 1))
    support = staged(flows.support_table(standins.places(spark, FOLDER), standins.hotels(spark, FOLDER)), "support")
    features = stays.search_features(searches, ids=["usersearch_id"])
    matrix = value.score_matrix(features, support, ["usersearch_id"])
    assert matrix.columns[:3] == ["usersearch_id", "search_id", "hotel_id"]
    assert matrix.filter(F.substring_index("search_id", "-", 1) != F.col("usersearch_id")).isEmpty()


def test_number_of_clusters_follows_the_hotels(spark):
    assert clusters.cluster_count(spark.range(2000), 20) == 100
    assert clusters.cluster_count(spark.range(3), 20) == 2
    points = spark.range(64).select("id", (F.col("id") % 8).cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("y"))
    model = clusters.train_clusters(points, ["x", "y"], k=4, method="bisecting")
    assigned = clusters.assign_clusters(model, points, ["x", "y"])
    assert assigned.select("cluster_id").distinct().count() == 4
    with pytest.raises(ValueError):
        clusters.train_clusters(points, ["x"], method="other")


def test_sample_by_key_is_the_same_on_every_run(spark):
    df = spark.range(5000)
    one = {r.id for r in cleaning.sample_by_key(df, ["id"], 0.1).collect()}
    other = {r.id for r in cleaning.sample_by_key(df.repartition(7), ["id"], 0.1).collect()}
    assert one == other and 400 < len(one) < 600


def test_weights_of_some_items_equal_those_of_all(spark):
    docs = standins.content(spark, FOLDER)
    some = docs.filter("item % 7 = 0").select("item")
    one = content.tfidf_long(docs, items=some)
    other = content.tfidf_long(docs).join(some, "item", "left_semi")
    assert one.select(*other.columns).exceptAll(other).isEmpty() and one.count() == other.count()
    # The texts are scanned for the word counts, which are written, and for the number of items.
    plan = plan_of(one)
    assert "term-frequency" in plan and "split(" not in plan


def test_pivot_splits_texts_once(spark):
    wide = content.feature_pivot(content.tfidf_long(standins.content(spark, FOLDER), carry=["lang"]), "lang", ["de", "en"])
    wide.collect()
    # Shuffles that are used again show once in the plan that ran.
    assert wide._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 1


def test_words_are_hashed_after_they_are_counted(spark):
    plan = plan_of(content.hashed_tfidf(standins.content(spark, FOLDER).select("item", "text")))
    assert "split(" not in plan and "term-frequency" in plan
