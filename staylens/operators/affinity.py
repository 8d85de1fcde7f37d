"""How much each user likes each feature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.operators.joins import broadcasts_needed
from staylens.session import staged

# Products of a rating and a weight that one task is to sum.
TASK_ROWS = 1_000_000

# Most broadcasts that the weights may be sent in.
PARTS = 16


def user_feature_affinity(
    ratings: DataFrame, weights: DataFrame, value: str = "tfidf"
) -> DataFrame:
    """(user, feature, affinity): the sum over items of rating times feature weight.

    The product of two sparse matrices as an equi-join on the item and one sum. An item absent
    from either side adds nothing. The products are far more than both sides, and nearly as many
    as the sums. So where the weights fit into a few broadcasts (of different features), ratings are
    dealt to tasks by user, as many as the products ask for, and each task sums all of its users':
    only ratings move. Otherwise rows join on the item and sums start before they move; the sum groups
    by other columns than the join, so the run-time split of a much-rated item costs no extra shuffle.
    """
    ratings = staged(ratings.select("user", "item", "rating"), "affinity-ratings")
    weights = staged(weights.select("item", "feature", F.col(value).alias("weight")), "affinity-weights")
    parts = broadcasts_needed(weights, PARTS)
    if parts is None:
        return _summed(ratings.join(weights, "item"))
    raters = ratings.groupBy("item").agg(F.count("*").alias("raters"))
    words = weights.groupBy("item").agg(F.count("*").alias("words"))
    products = raters.join(words, "item").agg(F.sum(F.col("raters") * F.col("words"))).first()[0] or 0
    dealt = ratings.repartition(-(-products // TASK_ROWS) or 1, "user")
    found = None
    for part in range(parts):
        here = weights.filter(F.pmod(F.xxhash64("feature"), F.lit(parts)) == part)
        sums = _summed(dealt.join(F.broadcast(here), "item"))
        found = sums if found is None else found.unionByName(sums)
    return found


def _summed(products: DataFrame) -> DataFrame:
    affinity = F.sum(F.col("rating") * F.col("weight")).alias("affinity")
    return products.groupBy("user", "feature").agg(affinity)
