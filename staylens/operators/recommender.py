"""Collaborative filtering by alternating least squares."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.operators.best_items import best_unrated
from staylens.operators.cleaning import hash_split
from staylens.operators.id_book import grown_book, with_ids, with_numbers
from staylens.operators.ratings import (
    rated_plus_predicted,
    rating_errors,
    rmse,
    sorted_limit,
    unrated_pairs,
    user_item_pairs,
    user_subset,
)
from staylens.session import shared_folder, staged

# Training parameters.
RANKS = (8, 10, 12)
ITERATIONS = 10
REGULARISATION = 0.1
SEED = 1
TRAIN_SHARE = 0.7


def train_als(
    ratings: DataFrame,
    rank: int = RANKS[0],
    iterations: int = ITERATIONS,
    regularisation: float = REGULARISATION,
    seed: int = SEED,
    blocks: int | None = None,
) -> ALSModel:
    """Fit the factors. Spark refuses ids beyond the integer range; ``train_with_ids`` takes any.

    Spark checkpoints the factors while iterating, into the folder the session names.
    ``blocks`` sets how many parts the users and items are divided into.
    """
    shared_folder(ratings.sparkSession)
    als = ALS(
        userCol="user",
        itemCol="item",
        ratingCol="rating",
        rank=rank,
        maxIter=iterations,
        regParam=regularisation,
        seed=seed,
        coldStartStrategy="drop",
    )
    if blocks is not None:
        als = als.setNumBlocks(blocks)
    return als.fit(ratings)


def predict(model: ALSModel, pairs: DataFrame) -> DataFrame:
    """Add ``prediction``; pairs whose user or item the model has not seen are left out."""
    found = model.transform(pairs)
    # The model returns ids as integers; they go back to the types they came in.
    kept = {c: F.col(c).cast(pairs.schema[c].dataType) for c in ("user", "item")}
    return found.withColumns({**kept, "prediction": F.col("prediction").cast("double")})


def split_ratings(ratings: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    marked = hash_split(ratings, ["user", "item"], TRAIN_SHARE, seed)
    train = marked.filter(F.col("split") == "train").drop("split")
    test = marked.filter(F.col("split") == "test").drop("split")
    return train, test


@dataclass(frozen=True)
class RankSearch:
    """``scores``: one row per rank (rank, rmse, predicted share of the validation pairs)."""

    scores: DataFrame
    best: ALSModel
    best_rank: int


def search_rank(
    ratings: DataFrame, ranks: Sequence[int] = RANKS, seed: int = 0, **options
) -> RankSearch:
    """Fit each rank on the training part and keep the model with the least error."""
    spark = ratings.sparkSession
    table = staged(ratings.select("user", "item", "rating"), "ratings")
    train, check = split_ratings(table, seed)
    expected = check.count()
    rows, best, best_rank, least = [], None, None, float("inf")
    for rank in ranks:
        model = train_als(train, rank=rank, **options)
        found = rmse(rating_errors(check, predict(model, check.select("user", "item")))).first()
        error = float("inf") if found["rmse"] is None else found["rmse"]
        rows.append((rank, found["rmse"], found["pairs"] / expected if expected else 0.0))
        if best is None or error < least:
            best, best_rank, least = model, rank, error
    schema = T.StructType(
        [
            T.StructField("rank", T.IntegerType()),
            T.StructField("rmse", T.DoubleType()),
            T.StructField("coverage", T.DoubleType()),
        ]
    )
    return RankSearch(spark.createDataFrame(rows, schema), best, best_rank)


def completed(ratings: DataFrame, model: ALSModel, num_users: int) -> DataFrame:
    """Known ratings of users 1..``num_users`` and predictions for all their other items."""
    # All users' items are candidates; only the subset's own ratings are read to leave pairs out.
    rated = user_subset(ratings, num_users)
    pairs = unrated_pairs(user_item_pairs(ratings, num_users), rated)
    return rated_plus_predicted(rated, predict(model, pairs))


def recommend_items(ratings: DataFrame, model: ALSModel, users: DataFrame, k: int) -> DataFrame:
    """(user, item, prediction, place): the ``k`` best items that each user has not rated.

    ``users`` has the column ``user``. Not all pairs are scored: see ``best_items``.
    """
    found = best_unrated(ratings, model, users, k)
    return found.withColumns({c: F.col(c).cast(ratings.schema[c].dataType) for c in ("user", "item")})


@dataclass(frozen=True)
class IdRecommender:
    """A model of numbers with the books that say which user or item a number stands for."""

    model: ALSModel
    users: DataFrame
    items: DataFrame

    def numbered(self, rows: DataFrame) -> DataFrame:
        """Rows whose user and item the books have, with ``user_number`` and ``item_number``."""
        known = with_numbers(rows, "user", self.users, "user_number")
        return with_numbers(known, "item", self.items, "item_number")


def train_with_ids(
    ratings: DataFrame, users: DataFrame | None = None, items: DataFrame | None = None, **options
) -> IdRecommender:
    """``train_als`` for user and item ids of any type.

    ``users`` and ``items`` are the books of an earlier model; their ids keep their numbers.
    """
    users, items = grown_book(ratings, "user", users), grown_book(ratings, "item", items)
    books = IdRecommender(None, users, items)
    numbers = books.numbered(ratings).select(
        F.col("user_number").alias("user"), F.col("item_number").alias("item"), "rating"
    )
    return IdRecommender(train_als(numbers, **options), users, items)


def predict_with_ids(found: IdRecommender, pairs: DataFrame) -> DataFrame:
    """``predict`` for pairs of ids; pairs that the model has not seen are left out."""
    numbers = found.numbered(pairs).withColumnsRenamed({"user": "user_id", "item": "item_id"})
    numbers = numbers.withColumnsRenamed({"user_number": "user", "item_number": "item"})
    scored = predict(found.model, numbers).drop("user", "item")
    renamed = scored.withColumnsRenamed({"user_id": "user", "item_id": "item"})
    return renamed.select(*pairs.columns, "prediction")


def recommend_with_ids(found: IdRecommender, ratings: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """``recommend_items`` for ids of any type: (user, item, prediction, place)."""
    rated = found.numbered(ratings.select("user", "item")).select(
        F.col("user_number").alias("user"), F.col("item_number").alias("item")
    )
    wanted = with_numbers(users.select("user"), "user", found.users, "number").select(
        F.col("number").alias("user")
    )
    best = best_unrated(rated, found.model, wanted, k)
    named = best.withColumnsRenamed({"user": "user_number", "item": "item_number"})
    rows = with_ids(with_ids(named, "user_number", found.users, "user"), "item_number", found.items, "item")
    return rows.select("user", "item", "prediction", "place")


def by_hand(model: ALSModel, pairs: DataFrame) -> DataFrame:
    """Pairs that the model knows with ``by_hand``, the sum of their factors' products in 64 bits."""
    factors = lambda table, number, name: table.select(
        F.col("id").alias(number), F.transform("features", lambda x: x.cast("double")).alias(name)
    )
    joined = pairs.join(factors(model.userFactors, "user", "user_factors"), "user").join(
        factors(model.itemFactors, "item", "item_factors"), "item"
    )
    products = F.zip_with("user_factors", "item_factors", lambda a, b: a * b)
    total = F.aggregate(products, F.lit(0.0), lambda a, x: a + x)
    return joined.withColumn("by_hand", total).drop("user_factors", "item_factors")


def complete_ratings(
    ratings: DataFrame, model: ALSModel, num_users: int, limit: int | None = None
) -> DataFrame:
    """The same without incomplete rows, sorted by user and item, cut to ``limit`` if given."""
    return sorted_limit(completed(ratings, model, num_users), limit)
