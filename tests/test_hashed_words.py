"""Words in their hash buckets, worked out in the row of their item."""

import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from staylens.functions import text
from staylens.operators import content
from staylens.plans.catalogue import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_buckets_are_those_of_spark(spark):
    words = ["", "a", "ab", "abc", "abcd", "abcde", "héllo", "ß", "日本語", "😀x", "ÿy", "x" * 1001]
    counts = F.array(*(F.struct(F.lit(w).alias("feature"), F.lit(1).cast("long").alias("tf")) for w in words))
    for buckets in (1, 7, content.HASH_BUCKETS):
        rows = spark.range(3).select("id", text.word_buckets(F.when(F.col("id") != 1, counts), buckets).alias("w"))
        found = rows.select("id", F.inline("w")).collect()
        hashing = HashingTF(numFeatures=buckets)
        assert [(r.id, r.feature, r["index"]) for r in found] == [(i, w, hashing.indexOf(w)) for i in (0, 2) for w in words]
        own = [hashing.indexOf(w) for w in words]
        assert [r.n for r in found[: len(words)]] == [own.count(i) for i in own]


def test_rows_get_the_entry_of_their_own_vector(spark):
    texts = spark.createDataFrame([(1, "a b a c"), (2, ""), (3, "b d"), (4, "a")], "item long, text string")
    vectors, _ = content.hashed_vectors(texts, buckets=5, carry=["text"])
    expected = {r["item"]: r["features"].toArray() for r in vectors.collect()}
    found = content.hashed_tfidf(vectors, buckets=5, beside="features").collect()
    assert sorted((r.item, r.feature, r.tf) for r in found) == [
        (1, "a", 2), (1, "b", 1), (1, "c", 1), (3, "b", 1), (3, "d", 1), (4, "a", 1)
    ]
    assert all(r.beside == expected[r["item"]][r["index"]] == pytest.approx(r.value) for r in found)
    # Another row's text beside a vector without its words.
    other = vectors.withColumn("text", F.lit("zzz yyy"))
    lone = content.hashed_tfidf(other, beside="features").collect()
    assert len(lone) == 8 and all(r.beside is None for r in lone)


def test_rows_of_one_item_meet(spark):
    texts = spark.createDataFrame([(1, "a b"), (1, "a"), (2, "b c"), (1, None)], "item long, text string")
    found = content.hashed_tfidf(texts).collect()
    exact = {(r["item"], r["feature"]): r["tfidf"] for r in content.tfidf_long(texts).collect()}
    assert {(r.item, r.feature): r.tf for r in found}[(1, "a")] == 2
    assert {(r.item, r.feature): r.value for r in found} == pytest.approx(exact)
    vectors = texts.withColumn("features", F.lit(None))
    with pytest.raises(ValueError, match="several rows"):
        content.hashed_tfidf(vectors, beside="features")


def test_words_of_an_item_stay_in_its_row(spark):
    """Weights join by bucket; no word or vector entry is dealt by its item."""
    found = QUERIES["hashed_tfidf"](spark, FOLDER)
    query = found._jdf.queryExecution()
    assert query.optimizedPlan().toString().count("Join ") == 1
    assert found.filter("not agrees").isEmpty() and found.count() > 1000
