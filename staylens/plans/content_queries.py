"""Registered queries on item texts and user-feature affinity."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.operators import content as ops
from staylens.operators import recommender
from staylens.operators.affinity import user_feature_affinity as affinity_of
from staylens.operators.ratings import (
    distinct_items,
    rated_plus_predicted,
    unrated_pairs,
    user_item_pairs,
    user_subset,
)
from staylens.plans import flows
from staylens.plans import oracle_parts as parts
from staylens.plans.rating_queries import NUM_USERS
from staylens.plans.registry import query, rounded
from staylens.sources import standins

# The languages of the given documents.
LANGUAGES = ["de", "en", "es", "fr"]


def _content(spark, folder):
    return standins.content(spark, folder).select("item", "text")


@query(
    "content_text",
    """SELECT p_partkey AS item,
       lower(concat_ws(' ', replace(p_name, ' ', ''), replace(p_type, ' ', ''),
                       replace(p_name, ' ', ''))) AS text
FROM part WHERE p_size % 10 <> 0""",
)
def content_text(spark, folder):
    return ops.content_text(standins.item_names(spark, folder))


@query(
    "ascii_fold",
    r"""SELECT doc_id AS item, regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g') AS text
FROM documents""",
)
def ascii_fold(spark, folder):
    return ops.ascii_fold(_content(spark, folder))


@query("token_explode", f"WITH {parts.TOKENS} SELECT * FROM token")
def token_explode(spark, folder):
    return ops.token_explode(_content(spark, folder))


@query("term_frequency", f"WITH {parts.TFIDF} SELECT * FROM tf")
def term_frequency(spark, folder):
    return ops.term_frequency(_content(spark, folder))


@query("idf", f"WITH {parts.TFIDF} SELECT feature, df, round(idf, 6) AS idf FROM idf")
def idf(spark, folder):
    return rounded(ops.idf(_content(spark, folder)), 6, "idf")


@query(
    "tfidf_long",
    f"WITH {parts.TFIDF} SELECT item, feature, tf, round(tfidf, 6) AS tfidf FROM tfidf",
)
def tfidf_long(spark, folder):
    return rounded(ops.tfidf_long(_content(spark, folder)), 6, "tfidf")


@query(
    "feature_pivot",
    f"""WITH {parts.TFIDF}
SELECT feature, {", ".join(
    f"round(coalesce(max(CASE WHEN lang = '{name}' THEN tfidf END), 0), 6) AS {name}"
    for name in LANGUAGES)}
FROM tfidf JOIN documents ON item = doc_id GROUP BY feature""",
)
def feature_pivot(spark, folder):
    """Largest weight of each word in each language."""
    weights = ops.tfidf_long(standins.content(spark, folder), carry=["lang"])
    return rounded(ops.feature_pivot(weights, "lang", LANGUAGES), 6, *LANGUAGES)


@query(
    "distinct_tokens",
    f"""WITH {parts.DISTINCT_TOKENS}
SELECT item, count(*) AS n, md5(string_agg(feature, ' ' ORDER BY first)) AS features
FROM first_use GROUP BY item""",
)
def distinct_tokens(spark, folder):
    """Each word of an item once, in order of first use; shown by its digest."""
    found = ops.distinct_tokens(_content(spark, folder)).filter(F.size("features") > 0)
    joined = F.md5(F.array_join("features", " "))
    return found.select("item", F.size("features").cast("long").alias("n"), joined.alias("features"))


@query(
    "hashed_tfidf",
    f"WITH {parts.TFIDF} SELECT item, feature, tf, true AS agrees FROM tf",
)
def hashed_tfidf(spark, folder):
    """Each word of an item, and whether its bucket's weight is that of the Spark ML vectors."""
    content = _content(spark, folder)
    if ops.repeats(content):
        # Vectors of rows, weights of items: they have to meet.
        vectors, _ = ops.hashed_vectors(content)
        cells = vectors.select("item", F.unwrap_udt(F.col("features")).alias("v")).select(
            "item", F.inline(F.arrays_zip("v.indices", "v.values"))
        )
        found = ops.hashed_tfidf(content).join(cells.toDF("item", "index", "beside"), ["item", "index"], "left")
    else:
        vectors, _ = ops.hashed_vectors(content, carry=["text"])
        found = ops.hashed_tfidf(vectors, beside="features")
    close = F.abs(F.col("value") - F.col("beside")) < 1e-9
    return found.select("item", "feature", "tf", F.coalesce(close, F.lit(False)).alias("agrees"))


@query(
    "user_feature_affinity",
    f"""WITH {parts.TFIDF},{parts.RATINGS}
SELECT "user", feature, round(sum(rating * tfidf), 4) AS affinity
FROM rated JOIN tfidf USING (item) GROUP BY "user", feature""",
)
def user_feature_affinity(spark, folder):
    rated = standins.ratings(spark, folder)
    weights = ops.tfidf_long(_content(spark, folder), items=distinct_items(rated))
    found = affinity_of(rated, weights)
    return rounded(found, 4, "affinity")


@query(
    "user_feature_affinity_als",
    f"""WITH {parts.TFIDF},{parts.pairs(NUM_USERS)},
done AS (
  SELECT "user", item FROM rated WHERE "user" <= {NUM_USERS}
  UNION ALL
  SELECT "user", item FROM unrated u WHERE EXISTS (SELECT 1 FROM rated r WHERE r."user" = u."user")
)
SELECT DISTINCT "user", feature, true AS same FROM done JOIN tf USING (item)""",
)
def user_feature_affinity_als(spark, folder):
    """Whom known and predicted ratings of the user subset give an affinity, and to which words.

    ``same`` tells whether predictions worked out from the factors by hand give the same affinity.
    """
    rated = standins.ratings(spark, folder)
    model = recommender.train_als(rated)
    content = _content(spark, folder)
    found = flows.recommend_features(rated, content, model, NUM_USERS)
    own = user_subset(rated, NUM_USERS)
    pairs = unrated_pairs(user_item_pairs(rated, NUM_USERS), own)
    by_hand = recommender.by_hand(model, pairs).withColumnRenamed("by_hand", "prediction")
    weights = ops.tfidf_long(content, items=distinct_items(rated))
    again = affinity_of(rated_plus_predicted(own, by_hand), weights).withColumnRenamed("affinity", "again")
    gap = F.abs(F.col("affinity") - F.col("again"))
    same = F.coalesce(gap <= 1e-4 * (1 + F.abs("again")), F.lit(False))
    return found.join(again, ["user", "feature"], "full").select("user", "feature", same.alias("same"))
