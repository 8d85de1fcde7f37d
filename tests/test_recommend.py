"""Ratings, recommender, content and affinity."""

import math

import pytest
from pyspark.sql import functions as F

from staylens.functions import text
from staylens.operators import content, joins, ratings, recommender
from staylens.operators.affinity import user_feature_affinity
from staylens.session import Workspace
from staylens.sources import files

RATING = "user bigint, item int, rating double"


@pytest.fixture(scope="module")
def rated(spark):
    return spark.createDataFrame([(1, 10, 4.0), (2, 20, 3.0), (2, 30, 5.0)], RATING)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_unrated_pairs(rated):
    pairs = ratings.user_item_pairs(rated, 2)
    assert pairs.count() == 6
    missing = ratings.unrated_pairs(pairs, rated).select("user", "item")
    assert rows(missing) == [(1, 20), (1, 30), (2, 10)]
    both = missing.union(rated.select("user", "item"))
    assert rows(both) == rows(pairs.select("user", "item"))


def test_subset_and_items(rated):
    assert rows(ratings.user_subset(rated, 1)) == [(1, 10, 4.0)]
    assert rows(ratings.distinct_items(rated)) == [(10,), (20,), (30,)]


def test_vectors_keep_items_with_their_ratings(spark):
    df = spark.createDataFrame([(1, 30, 1.0), (1, 10, 5.0), (1, 20, 3.0)], RATING)
    row = ratings.user_vectors(df, block=65_536).first()
    assert [tuple(e) for e in row["entries"]] == [(10, 5.0), (20, 3.0), (30, 1.0)]
    blocks = ratings.user_vectors(df, block=20)
    assert {r["block"]: [e["item"] for e in r["entries"]] for r in blocks.collect()} == {
        0: [10], 1: [20, 30],
    }


def test_sorted_limit_drops_incomplete_rows_first(spark):
    df = spark.createDataFrame([(2, 1, 1.0), (1, 2, None), (1, 3, 2.0)], RATING)
    assert [tuple(r) for r in ratings.sorted_limit(df, 1).collect()] == [(1, 3, 2.0)]
    assert ratings.sorted_limit(df).count() == 2


def test_top_k_breaks_ties_by_item(spark):
    df = spark.createDataFrame([(1, 3, 5.0), (1, 2, 5.0), (1, 1, 4.0), (2, 1, 1.0)], RATING)
    found = ratings.top_k_items(df, 2).select("user", "item", "place")
    assert rows(found) == [(1, 2, 1), (1, 3, 2), (2, 1, 1)]


def test_rmse_golden(spark):
    df = spark.createDataFrame([(3.0, 2.0), (5.0, 5.0), (1.0, 3.0)], "rating double, prediction double")
    row = ratings.rmse(df).first()
    assert row["rmse"] == pytest.approx(1.290994, abs=1e-6) and row["pairs"] == 3


def test_union_marks_its_source(spark, rated):
    guesses = spark.createDataFrame([(1, 20, 2.5)], "user bigint, item int, prediction double")
    both = ratings.rated_plus_predicted(rated, guesses)
    assert both.filter("source = 'predicted'").select("user", "item", "rating").first() == (1, 20, 2.5)
    assert both.count() == 4


def blocky(spark):
    """Odd users like odd items."""
    pairs = spark.range(1, 31).withColumnRenamed("id", "user").select(
        "user", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("item")
    )
    liked = F.when((F.col("user") + F.col("item")) % 2 == 0, 5.0).otherwise(1.0)
    return pairs.withColumn("rating", liked).filter((F.col("user") * 7 + F.col("item")) % 5 != 0)


def test_als_beats_the_mean_and_completes_all_pairs(spark, tmp_path):
    from pyspark.ml.recommendation import ALSModel

    known = blocky(spark)
    search = recommender.search_rank(known, ranks=(2, 3))
    scores = {r["rank"]: (r["rmse"], r["coverage"]) for r in search.scores.collect()}
    assert set(scores) == {2, 3} and search.best_rank == min(scores, key=lambda k: scores[k][0])
    spread = known.agg(F.stddev_pop("rating")).first()[0]
    assert scores[search.best_rank][0] < spread / 2
    assert scores[search.best_rank][1] == 1.0
    model = recommender.train_als(known)
    done = recommender.complete_ratings(known, model, 4)
    assert done.select("user", "item").distinct().count() == done.count() == 4 * 20
    kept = done.filter("source = 'rated'").select("user", "item", "rating")
    assert rows(kept) == rows(known.filter("user <= 4").select("user", "item", "rating"))
    assert recommender.complete_ratings(known, model, 4, limit=7).count() == 7
    path = str(tmp_path / "als")
    files.save_model(model, path)
    pairs = known.select("user", "item")
    before = recommender.predict(model, pairs)
    assert before.exceptAll(recommender.predict(ALSModel.load(path), pairs)).isEmpty()


def test_als_refuses_ids_it_cannot_hold(spark):
    big = spark.createDataFrame([(2**40, 1, 1.0), (1, 2, 2.0)], RATING)
    with pytest.raises(Exception):
        recommender.train_als(big)


def test_content_text_golden(spark):
    items = spark.createDataFrame(
        [
            (1, "José Padilha", "A B", "Gal Gadot", "Åsa Öst"),
            (2, "No One", None, "Some One", "Any One"),
        ],
        "item int, director string, actor2 string, actor3 string, actor1 string",
    )
    assert rows(content.content_text(items)) == [(1, "josepadilha galgadot asaost")]


def test_ascii_fold(spark):
    df = spark.createDataFrame([(1, "ﬁn ½ ß"), (2, "plain"), (3, None), (4, "naïve™")], "item int, text string")
    assert {r["item"]: r["text"] for r in content.ascii_fold(df).collect()} == {
        1: "fin 12 ", 2: "plain", 3: None, 4: "naiveTM",
    }


def test_words(spark):
    df = spark.createDataFrame([("A  b ",)], "t string")
    first = df.select(text.words(F.col("t")), text.words(F.col("t"), keep_blank=True)).first()
    assert list(first) == [["a", "b"], ["a", "", "b"]]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(1, "a b a"), (2, "b c")], "item int, text string")


def test_tfidf_golden(texts):
    found = {(r["item"], r["feature"]): r["tfidf"] for r in content.tfidf_long(texts).collect()}
    assert found == pytest.approx(
        {(1, "a"): 0.810930, (1, "b"): 0.0, (2, "b"): 0.0, (2, "c"): 0.405465}, abs=1e-6
    )


def test_common_and_rare_words_get_the_same_weights(spark, monkeypatch):
    docs = spark.range(200).select(
        "id",
        F.concat_ws(" ", F.lit("all"), F.concat(F.lit("w"), (F.col("id") % 40).cast("string")),
                    F.concat(F.lit("only"), F.col("id").cast("string"))).alias("text"),
    ).withColumnRenamed("id", "item")
    found = {}
    for most in (1, 20, 1000):
        monkeypatch.setattr(content, "COMMON_WORDS", most)
        found[most] = {(r["item"], r["feature"]): r["tfidf"] for r in content.tfidf_long(docs).collect()}
        assert len(found[most]) == 600
    assert found[1] == found[20] == found[1000]


def test_hashed_weights_follow_exact_ones(texts):
    exact = {(r["item"], r["feature"]): r["tfidf"] for r in content.tfidf_long(texts).collect()}
    hashed = {(r["item"], r["feature"]): r["value"] for r in content.hashed_tfidf(texts).collect()}
    assert hashed == pytest.approx(exact)
    tight = content.hashed_tfidf(texts, buckets=1).collect()
    assert {r["index"] for r in tight} == {0} and len(tight) == 4


def test_hashed_weights_follow_the_vectors(spark):
    """Few buckets, so that features collide; every weight must be that of the ML vector."""
    docs = spark.range(60).select(
        F.col("id").alias("item"),
        F.concat_ws(" ", *(F.concat(F.lit("w"), ((F.col("id") * k) % 23).cast("string")) for k in (1, 2, 3, 5))).alias("text"),
    )
    vectors, model = content.hashed_vectors(docs, buckets=8)
    expected = {r["item"]: r["features"].toArray() for r in vectors.collect()}
    found = content.hashed_tfidf(docs, buckets=8).collect()
    assert len(found) == content.term_frequency(docs).count()
    for row in found:
        assert row["value"] == pytest.approx(expected[row["item"]][row["index"]])
    assert model.numDocs == 60


def test_feature_index_matches_the_hash_of_spark(spark):
    from pyspark.ml.feature import HashingTF

    words = ["a", "héllo", "galgadot", ""]
    df = spark.createDataFrame([(w,) for w in words], "feature string")
    expected = {w: HashingTF(numFeatures=content.HASH_BUCKETS).indexOf(w) for w in words}
    assert {r["feature"]: r["index"] for r in content.feature_index(df).collect()} == expected


def test_pivot_and_vectors(texts):
    weights = content.tfidf_long(texts).withColumn("kind", F.concat(F.lit("i"), F.col("item")))
    wide = content.feature_pivot(weights, "kind", ["i1", "i2"])
    found = {r["feature"]: (r["i1"], r["i2"]) for r in wide.collect()}
    assert found["a"] == pytest.approx((0.810930, 0.0), abs=1e-6)
    assert found["c"] == pytest.approx((0.0, 0.405465), abs=1e-6)
    vectors = {r["feature"]: r["vector"].toArray().tolist() for r in content.feature_vectors(wide, ["i1", "i2"]).collect()}
    assert vectors["a"] == pytest.approx([0.810930, 0.0], abs=1e-6)


def test_affinity_golden_and_linear(spark, texts):
    known = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0), (1, 99, 3.0)], RATING)
    weights = content.tfidf_long(texts)
    found = {(r["user"], r["feature"]): r["affinity"] for r in user_feature_affinity(known, weights).collect()}
    assert found == pytest.approx({(1, "a"): 3.243721, (1, "b"): 0.0, (1, "c"): 0.810930}, abs=1e-6)
    twice = user_feature_affinity(known.withColumn("rating", F.col("rating") * 2), weights)
    assert {(r["user"], r["feature"]): r["affinity"] / 2 for r in twice.collect()} == pytest.approx(found)


def test_words_of_distinct_items_are_counted_without_a_shuffle(spark):
    rows = [(1, "a b a", "x"), (2, None, "x"), (3, "", "y"), (4, " C  c\tb ", "y")]
    texts = spark.createDataFrame(rows, "item long, text string, lang string")
    found = content.term_frequency(texts, carry=["lang"])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    expected = [(1, "x", "a", 2), (1, "x", "b", 1), (4, "y", "b", 1), (4, "y", "c", 2)]
    assert sorted(map(tuple, found.collect())) == expected
    blank = content.term_frequency(texts.filter("item = 4"), keep_blank=True).collect()
    assert {(r["feature"], r["tf"]) for r in blank} == {("", 2), ("c", 2), ("b", 1)}
    # Rows of one item meet.
    twice = content.term_frequency(texts.unionByName(texts)).collect()
    assert sorted(map(tuple, twice)) == [(i, f, 2 * n) for i, _, f, n in expected]


def test_weights_of_chosen_items_store_no_other_words(spark):
    texts = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "d e f g")], "item long, text string")
    with Workspace(spark) as work:
        found = content.tfidf_long(texts, items=texts.filter("item = 1").select("item"))
        stored = {p.split("/")[-1][: -33]: spark.read.parquet(p).count() for p in work.paths}
        assert stored == {"chosen-items": 1, "term-frequency": 2, "word-weights": 2}
        assert {(r["feature"], round(r["tfidf"], 6)) for r in found.collect()} == {
            ("a", round(2 * math.log(4 / 2), 6)), ("b", round(math.log(4 / 3), 6)),
        }


@pytest.mark.parametrize("limit", [10 * 1024 * 1024, 1000, 100])
def test_affinity_moves_ratings_and_not_products(spark, monkeypatch, limit):
    monkeypatch.setattr(joins, "broadcast_limit", lambda _: limit)
    n = F.col("id")
    known = spark.range(600).select((n % 20).alias("user"), (n % 30).alias("item"), (n * 1.0).alias("rating"))
    weights = spark.range(60).select(
        (n % 40).alias("item"), F.concat(F.lit("w"), (n % 7).cast("string")).alias("feature"), (n / 2).alias("tfidf")
    )
    found = user_feature_affinity(known, weights)
    plain = known.join(weights, "item").groupBy("user", "feature").agg(F.sum(F.col("rating") * F.col("tfidf")).alias("x"))
    assert {(r[0], r[1]): r[2] for r in found.collect()} == {(r[0], r[1]): r[2] for r in plain.collect()}
    joined = found._jdf.queryExecution().optimizedPlan().toString()
    assert ("RepartitionByExpression" in joined) == (limit > 100)


def test_word_counts_keep_to_their_row_in_large_batches(spark):
    n = F.col("id")
    texts = spark.range(4000, numPartitions=1).select(
        n.alias("item"), F.concat_ws(" ", *(F.concat(F.lit(c), (n % k).cast("string")) for c, k in
                                            (("a", 7), ("b", 900), ("c", 4000), ("b", 900)))).alias("text")
    )
    plain = content.token_explode(texts).groupBy("item", "feature").agg(F.count("*").alias("tf"))
    assert rows(content.term_frequency(texts)) == rows(plain)


def test_hashed_words_are_looked_up_once(spark):
    """Weights and values of buckets read the words of a bucket as written, without another split or hash."""
    texts = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "")], "item long, text string")
    found = content.hashed_tfidf(texts)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan and "split" not in plan
    assert sorted((r.item, r.feature, r.tf) for r in found.collect()) == [(1, "a", 2), (1, "b", 1), (2, "b", 1), (2, "c", 1)]
    vectors, _ = content.hashed_vectors(texts)
    again = {(r.item, int(i)): float(v) for r in vectors.collect() for i, v in zip(r.features.indices, r.features.values)}
    assert all(abs(again[r["item"], r["index"]] - r["value"]) < 1e-12 for r in found.collect())
