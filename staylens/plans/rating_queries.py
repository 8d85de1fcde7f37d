"""Registered queries on ratings and collaborative filtering."""

from __future__ import annotations

from pyspark.ml.recommendation import ALSModel
from pyspark.sql import functions as F

from staylens.operators import ratings as ops
from staylens.operators import recommender
from staylens.plans import oracle_parts as parts
from staylens.plans.registry import query, rounded
from staylens.session import fresh_path, staged
from staylens.sources import files, standins

# The threshold of the user subset: a parameter of the feature, users 1..n are completed.
NUM_USERS = 100
# Rows the sorted listing shows.
LISTED = 4160
TOP_K = 10
# Item numbers that one vector row covers; the given items take more than one block.
VECTOR_BLOCK = 64


def _ratings(spark, folder):
    return standins.ratings(spark, folder)


@query(
    "user_subset",
    f'WITH {parts.RATINGS} SELECT * FROM rated WHERE "user" <= {NUM_USERS}',
)
def user_subset(spark, folder):
    return ops.user_subset(_ratings(spark, folder), NUM_USERS)


@query("distinct_items", f"WITH {parts.RATINGS} SELECT DISTINCT item FROM rated")
def distinct_items(spark, folder):
    return ops.distinct_items(_ratings(spark, folder))


@query("user_item_pairs", f"WITH {parts.pairs(NUM_USERS)} SELECT * FROM pairs")
def user_item_pairs(spark, folder):
    return ops.user_item_pairs(_ratings(spark, folder), NUM_USERS)


@query("unrated_pairs", f"WITH {parts.pairs(NUM_USERS)} SELECT * FROM unrated")
def unrated_pairs(spark, folder):
    rated = _ratings(spark, folder)
    own = ops.user_subset(rated, NUM_USERS)
    return ops.unrated_pairs(ops.user_item_pairs(rated, NUM_USERS), own)


@query(
    "rmse",
    f"""WITH {parts.RATINGS},
guess AS (SELECT item, avg(rating) AS prediction FROM rated GROUP BY item)
SELECT round(sqrt(avg((rating - prediction) * (rating - prediction))), 6) AS rmse,
       count(*) AS pairs
FROM rated JOIN guess USING (item)""",
)
def rmse(spark, folder):
    """Error of predicting the mean of the item."""
    rated = _ratings(spark, folder)
    guesses = rated.select("user", "item").join(ops.item_means(rated), "item")
    return rounded(ops.rmse(ops.rating_errors(rated, guesses)), 6, "rmse")


@query(
    "rated_plus_predicted",
    f"""WITH {parts.pairs(NUM_USERS)},
guess AS (SELECT item, avg(rating) AS prediction FROM rated GROUP BY item)
SELECT "user", item, rating, 'rated' AS source
FROM rated WHERE "user" <= {NUM_USERS}
UNION ALL
SELECT "user", item, round(prediction, 4) AS rating, 'predicted' AS source
FROM unrated JOIN guess USING (item)""",
)
def rated_plus_predicted(spark, folder):
    rated = _ratings(spark, folder)
    own = ops.user_subset(rated, NUM_USERS)
    pairs = ops.unrated_pairs(ops.user_item_pairs(rated, NUM_USERS), own)
    guesses = rounded(pairs.join(ops.item_means(rated), "item"), 4, "prediction")
    return ops.rated_plus_predicted(own, guesses)


@query(
    "sorted_limit",
    f'WITH {parts.RATINGS} SELECT * FROM rated ORDER BY "user", item LIMIT {LISTED}',
)
def sorted_limit(spark, folder):
    return ops.sorted_limit(_ratings(spark, folder), LISTED)


@query(
    "top_k_items",
    f"""WITH {parts.RATINGS}
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY "user" ORDER BY rating DESC, item) AS INTEGER)
         AS place FROM rated)
WHERE place <= {TOP_K}""",
)
def top_k_items(spark, folder):
    return ops.top_k_items(_ratings(spark, folder), TOP_K)


@query(
    "user_vectors",
    f"""WITH {parts.RATINGS}
SELECT "user", CAST(item // {VECTOR_BLOCK} AS BIGINT) AS block, count(*) AS size,
       string_agg(concat(item, ':', CAST(round(rating * 100) AS BIGINT)), ' ' ORDER BY item)
         AS entries
FROM rated GROUP BY 1, 2""",
)
def user_vectors(spark, folder):
    """The arrays written as text, ratings in hundredths."""
    entry = lambda e: F.concat(
        e["item"].cast("string"), F.lit(":"), F.round(e["rating"] * 100).cast("long").cast("string")
    )
    vectors = ops.user_vectors(_ratings(spark, folder), VECTOR_BLOCK)
    return vectors.select(
        "user", "block", F.size("entries").cast("long").alias("size"),
        F.array_join(F.transform("entries", entry), " ").alias("entries"),
    )


# A fitted model has no SQL. The queries below work its results out a second, independent way, from the factors
# multiplied by hand, and return whether the two agree.

SPLIT = f"""{parts.RATINGS},
sided AS (
  SELECT *, ('0x' || substr(md5(concat_ws('|', '0', "user", item)), 1, 8))::BIGINT % 10000 < 7000
         AS train FROM rated
),
held AS (
  SELECT * FROM sided h WHERE NOT train
    AND EXISTS (SELECT 1 FROM sided t WHERE t.train AND t."user" = h."user")
    AND EXISTS (SELECT 1 FROM sided t WHERE t.train AND t.item = h.item)
)"""


def _as_by_hand():
    """The model multiplies in 32 bits."""
    return F.abs(F.col("prediction") - F.col("by_hand")) <= 1e-5 * (1 + F.abs("by_hand"))


def _finite(column):
    value = F.col(column)
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


@query(
    "als_predict",
    f"""WITH {SPLIT} SELECT "user", item, rating, true AS same FROM held""",
)
def als_predict(spark, folder):
    """Held-out ratings, and whether the prediction for each is the product of its factors."""
    train, check = recommender.split_ratings(_ratings(spark, folder))
    model = recommender.train_als(train)
    found = recommender.predict(model, check)
    return recommender.by_hand(model, found).select("user", "item", "rating", _as_by_hand().alias("same"))


@query(
    "als_any_ids",
    f"""WITH {SPLIT}
SELECT concat('user ', "user") AS "user", item + 1000000000000 AS item, rating, true AS same FROM held""",
)
def als_any_ids(spark, folder):
    """The same with users as text and items as numbers beyond 32 bits, through books of ids."""
    odd = {
        "user": F.concat(F.lit("user "), F.col("user").cast("string")),
        "item": F.col("item").cast("long") + 1_000_000_000_000,
    }
    train, check = (part.withColumns(odd) for part in recommender.split_ratings(_ratings(spark, folder)))
    found = recommender.train_with_ids(train)
    predicted = recommender.predict_with_ids(found, check)
    pairs = found.numbered(predicted.withColumnsRenamed({"user": "user_id", "item": "item_id"}).withColumns(
        {"user": F.col("user_id"), "item": F.col("item_id")}
    ))
    pairs = pairs.drop("user", "item").withColumnsRenamed({"user_number": "user", "item_number": "item"})
    checked = recommender.by_hand(found.model, pairs)
    return checked.select(
        F.col("user_id").alias("user"), F.col("item_id").alias("item"), "rating", _as_by_hand().alias("same")
    )


@query(
    "als_rank_search",
    f"""WITH {SPLIT},
share AS (
  SELECT round((SELECT count(*) FROM held)
               / CAST((SELECT count(*) FROM sided WHERE NOT train) AS DOUBLE), 6) AS coverage
)
SELECT rank, coverage, true AS same
FROM share, (SELECT unnest([{", ".join(map(str, recommender.RANKS))}]) AS rank)""",
)
def als_rank_search(spark, folder):
    """Each rank with its share of predicted held-out ratings, and whether its error bears a second look.

    The best rank's error is worked out again from factors multiplied by hand; no other may be less.
    """
    rated = _ratings(spark, folder)
    search = recommender.search_rank(rated)
    _, check = recommender.split_ratings(rated)
    gap = F.col("rating") - F.col("by_hand")
    again = recommender.by_hand(search.best, check).agg(F.sqrt(F.avg(gap * gap))).scalar()
    close = F.abs(F.col("rmse") - again) <= 1e-5
    same = F.when(F.col("rank") == search.best_rank, close).otherwise(F.col("rmse") >= again - 1e-5)
    scores = rounded(search.scores, 6, "coverage")
    return scores.select("rank", "coverage", same.alias("same"))


@query(
    "complete_ratings",
    f"""WITH {parts.pairs(NUM_USERS)}
SELECT "user", item, rating, 'rated' AS source FROM rated WHERE "user" <= {NUM_USERS}
UNION ALL
SELECT "user", item, CAST(NULL AS DOUBLE) AS rating, 'predicted' AS source
FROM unrated u WHERE EXISTS (SELECT 1 FROM rated r WHERE r."user" = u."user")""",
)
def complete_ratings(spark, folder):
    """All ratings of the user subset; of predicted ones the pair alone."""
    rated = _ratings(spark, folder)
    full = recommender.complete_ratings(rated, recommender.train_als(rated), NUM_USERS)
    known = F.when(F.col("source") == "rated", F.col("rating"))
    return full.filter(_finite("rating")).withColumn("rating", known)


@query(
    "recommend_items",
    f"""WITH {parts.RATINGS},
mine AS (SELECT "user", count(DISTINCT item) AS n FROM rated GROUP BY 1)
SELECT "user", least({TOP_K}, (SELECT count(DISTINCT item) FROM rated) - n) AS items,
       CAST(0 AS BIGINT) AS rated, CAST(0 AS BIGINT) AS differing
FROM mine WHERE (SELECT count(DISTINCT item) FROM rated) > n""",
)
def recommend_items(spark, folder):
    """For every user: items recommended, rated ones among them, and places that brute force fills otherwise.

    Brute force ranks all unrated pairs of the user subset by factors multiplied by hand.
    """
    rated = staged(_ratings(spark, folder), "ratings")
    model = recommender.train_als(rated)
    found = recommender.recommend_items(rated, model, rated.select("user").distinct(), TOP_K)
    own = ops.user_subset(rated, NUM_USERS)
    pairs = ops.unrated_pairs(ops.user_item_pairs(rated, NUM_USERS), own)
    scored = recommender.by_hand(model, pairs).select("user", "item", F.col("by_hand").alias("rating"))
    best = ops.top_k_items(scored, TOP_K).select("user", "place", F.col("item").alias("expected"))
    both = found.join(best, ["user", "place"], "full")
    seen = rated.select("user", "item", F.lit(1).alias("seen"))
    checked = both.join(seen, ["user", "item"], "left")
    differs = F.col("user").between(1, NUM_USERS) & ~F.col("item").eqNullSafe(F.col("expected"))
    return checked.groupBy("user").agg(
        F.countDistinct("item").alias("items"),
        F.count("seen").alias("rated"),
        F.count_if(differs).alias("differing"),
    )


@query("headerless_scan", f"WITH {parts.RATINGS} SELECT * FROM rated")
def headerless_scan(spark, folder):
    """Ratings written as CSV without a header and read back by position."""
    path = fresh_path(spark, "ratings-csv")
    rated = _ratings(spark, folder)
    files.write_csv(rated, path, header=False)
    return files.read_headerless_csv(spark, path, rated.schema)


@query(
    "als_model_files",
    f"""WITH {parts.RATINGS} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS differing FROM rated""",
)
def als_model_files(spark, folder):
    """Predictions of a saved and loaded model against those of the model itself."""
    rated = staged(_ratings(spark, folder), "ratings")
    model, path = recommender.train_als(rated), fresh_path(spark, "als")
    files.save_model(model, path)
    one = recommender.predict(model, rated)
    other = recommender.predict(ALSModel.load(path), rated).withColumnRenamed("prediction", "again")
    both = one.join(other.select("user", "item", "again"), ["user", "item"])
    differs = F.abs(F.col("prediction") - F.col("again")) > 1e-9
    return both.agg(F.count("*").alias("rows"), F.count_if(differs).alias("differing"))
