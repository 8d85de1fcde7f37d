"""Tables of ratings: pairs, complements, vectors, rankings and errors.

Ratings are rows (user, item, rating), one per pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Users that one row expands into at once.
USER_BLOCK = 65_536


def user_subset(ratings: DataFrame, num_users: int) -> DataFrame:
    """Ratings of the users numbered up to ``num_users``; the filter reaches the scan."""
    return ratings.filter(F.col("user") <= num_users)


def distinct_items(ratings: DataFrame) -> DataFrame:
    return ratings.select("item").distinct()


def user_item_pairs(ratings: DataFrame, num_users: int) -> DataFrame:
    """Users 1..``num_users``, each with every item.

    The users are a range given by the caller, not a table, so each item row is expanded in
    place: no join, and the rows grow with the catalogue only. The item list is short where the
    pairs are many, so it is spread over all tasks before it expands.
    """
    tasks = int(ratings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    items = distinct_items(ratings).repartition(tasks, "item")
    blocks = F.sequence(F.lit(0), F.lit(max(0, (num_users - 1) // USER_BLOCK)))
    low = F.col("block").cast("long") * USER_BLOCK
    users = F.sequence(low + 1, F.least(low + USER_BLOCK, F.lit(max(1, num_users))))
    spread = items.select("item", F.explode(blocks).alias("block"))
    pairs = spread.select(F.explode(users).alias("user"), "item")
    return pairs.filter(F.col("user") <= num_users)


def unrated_pairs(pairs: DataFrame, ratings: DataFrame) -> DataFrame:
    """Pairs without a rating. Rated pairs are made distinct before they move."""
    rated = ratings.select("user", "item").distinct()
    return pairs.join(rated, ["user", "item"], "left_anti")


def rated_plus_predicted(ratings: DataFrame, predictions: DataFrame) -> DataFrame:
    """Known and predicted ratings in one table, ``source`` telling them apart."""
    columns = ["user", "item", "rating"]
    known = ratings.select(*columns, F.lit("rated").alias("source"))
    guessed = predictions.select(
        "user", "item", F.col("prediction").cast("double").alias("rating"),
        F.lit("predicted").alias("source"),
    )
    return known.unionByName(guessed)


def sorted_limit(ratings: DataFrame, limit: int | None = None) -> DataFrame:
    """Complete rows by user and item; with a limit this is a top-n, not a full sort."""
    ordered = ratings.na.drop().orderBy("user", "item")
    return ordered if limit is None else ordered.limit(limit)


def top_k_items(ratings: DataFrame, k: int) -> DataFrame:
    """The k best items of each user, ties by item.

    Spark applies the rank limit inside each map task first, so a user with very many ratings
    sends at most k rows per task to the one that ranks them.
    """
    best = Window.partitionBy("user").orderBy(F.col("rating").desc(), F.col("item"))
    return ratings.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)


def user_vectors(ratings: DataFrame, block: int) -> DataFrame:
    """Each user's items and ratings as ordered arrays of (item, rating), one for each block.

    Items and ratings share a struct, so they cannot lose their alignment. A vector row covers a
    range of ``block`` item numbers and so has a bounded size; a user has a row (user, block,
    entries) for every block with a rating. Only a catalogue within one block gives one row per user.
    """
    return (
        ratings.withColumn("block", F.floor(F.col("item") / F.lit(block)).cast("long"))
        .groupBy("user", "block")
        .agg(F.sort_array(F.collect_list(F.struct("item", "rating"))).alias("entries"))
    )


def item_means(ratings: DataFrame) -> DataFrame:
    """Mean rating of each item: a prediction that needs no model."""
    return ratings.groupBy("item").agg(F.avg("rating").alias("prediction"))


def rating_errors(ratings: DataFrame, predictions: DataFrame) -> DataFrame:
    """Known ratings beside the prediction for the same pair."""
    return ratings.join(predictions.select("user", "item", "prediction"), ["user", "item"])


def rmse(pairs: DataFrame) -> DataFrame:
    """One row: root of the mean squared error, and the pairs it covers."""
    gap = F.col("rating") - F.col("prediction")
    return pairs.agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.count("*").alias("pairs"))
