"""Words of items and their weights, in long form (item, feature, weight).

A long table has no width limit: the vocabulary may grow without plans growing with it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import IDF, HashingTF, IDFModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions import text
from staylens.operators.joins import broadcast_if_small
from staylens.session import staged

# Whose names describe an item (the second actor is not among them).
NAME_COLUMNS = ("director", "actor3", "actor1")
HASH_BUCKETS = 1 << 18

# Most words that may be broadcast with their weight, and the longest that may.
COMMON_WORDS = 100_000
COMMON_CHARS = 256


def content_text(
    items: DataFrame, names: Sequence[str] = NAME_COLUMNS, squeeze: bool = True
) -> DataFrame:
    """(item, text): the names of complete rows as plain lower-case words, one per name."""
    parts = [text.squeezed(F.col(c)) if squeeze else F.col(c) for c in names]
    joined = F.concat_ws(" ", *parts)
    return items.na.drop().select("item", F.lower(text.ascii_folded(joined)).alias("text"))


def ascii_fold(items: DataFrame, column: str = "text") -> DataFrame:
    return items.withColumn(column, text.ascii_folded(F.col(column)))


def token_explode(
    content: DataFrame, keep_blank: bool = False, carry: Sequence[str] = ()
) -> DataFrame:
    """(item, feature): one row per word of the whole text, with the ``carry`` columns of its item.

    Blank words go by a row filter after the split, which keeps the scan, split and filter in
    one piece of generated code.
    """
    split = text.split_words(F.col("text"), keep_blank)
    tokens = content.select("item", *carry, F.explode(split).alias("feature"))
    return tokens if keep_blank else tokens.filter(F.col("feature") != "")


def distinct_tokens(content: DataFrame) -> DataFrame:
    """Each word of an item once, in order of first use."""
    return content.select("item", F.array_distinct(text.words(F.col("text"))).alias("features"))


def repeats(content: DataFrame) -> bool:
    """Whether an item has more than one row. Reads the ids alone."""
    return not content.groupBy("item").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def term_frequency(
    content: DataFrame, keep_blank: bool = False, carry: Sequence[str] = ()
) -> DataFrame:
    """(item, feature, tf).

    Where each item has one row, its words are counted in that row and nothing moves. Rows of items
    that come again have to meet: then words merge in each task before they shuffle.
    """
    if repeats(content):
        tokens = token_explode(content, keep_blank, carry)
        return tokens.groupBy("item", *carry, "feature").agg(F.count("*").alias("tf"))
    counts = text.word_counts(text.words(F.col("text"), keep_blank))
    return content.select("item", *carry, F.inline(counts))


def _item_count(content: DataFrame) -> Column:
    return content.agg(F.count("*").alias("items")).scalar()


def _idf_of(frequency: DataFrame, content: DataFrame) -> DataFrame:
    # Counting through tf keeps this branch's columns equal to those of the detail branch, so
    # both read one and the same shuffle of (item, feature, tf).
    holders = F.sum(F.when(F.col("tf") > 0, 1).otherwise(0)).alias("df")
    # No feature is null; said here, since joins would say it for some of the branches alone.
    known = frequency.filter(F.col("feature").isNotNull())
    counts = known.groupBy("feature").agg(holders).withColumn("items", _item_count(content))
    weight = F.log((F.col("items") + 1) / (F.col("df") + 1))
    return counts.withColumn("idf", weight)


def idf(content: DataFrame, keep_blank: bool = False) -> DataFrame:
    """(feature, df, idf) with idf = ln((items + 1) / (df + 1))."""
    return _idf_of(term_frequency(content, keep_blank), content).select("feature", "df", "idf")


def tfidf_long(
    content: DataFrame,
    keep_blank: bool = False,
    items: DataFrame | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(item, feature, tf, tfidf), with the ``carry`` columns of the item.

    Weights are joined to words by the word itself. A word is common when it is in at least
    1/COMMON_WORDS of all (item, feature) rows and has at most COMMON_CHARS characters, so there are
    at most COMMON_WORDS of them, of bounded size, whatever the texts. Those are broadcast: their
    many rows stay where they are, and no single word can fill a task. The rest shuffles by word,
    and only a very long word among it can be frequent.

    Word counts are written once, so that texts are not split again for each branch. With ``items``
    only those items get rows, but weights still come from all texts; the counts and the weights that
    those items need are written then.
    """
    if items is None:
        detail = staged(term_frequency(content, keep_blank, carry), "term-frequency")
        weights = _idf_of(detail, content)
    else:
        chosen = broadcast_if_small(staged(items.select("item").distinct(), "chosen-items"))
        wanted = content.join(chosen, "item", "left_semi")
        detail = staged(term_frequency(wanted, keep_blank, carry), "term-frequency")
        every = _idf_of(term_frequency(content, keep_blank), content)
        known = detail.select("feature").distinct()
        weights = staged(every.join(known, "feature", "left_semi"), "word-weights")
    rows = weights.agg(F.sum("df").alias("rows")).scalar()
    # One condition on df, so that no part of it is pushed below the sum that branches share.
    often = F.col("df") * F.lit(COMMON_WORDS) >= rows
    is_common = F.when(often, F.length("feature") <= COMMON_CHARS).otherwise(F.lit(False))
    common = weights.filter(is_common).select("feature", F.col("idf").alias("weight"))
    rare = weights.filter(~is_common).select("feature", F.col("idf").alias("rare_weight"))
    marked = detail.join(F.broadcast(common), "feature", "left")
    columns = ["item", *carry, "feature", "tf"]
    here = marked.filter(F.col("weight").isNotNull()).select(
        *columns, (F.col("tf") * F.col("weight")).alias("tfidf")
    )
    moved = (
        marked.filter(F.col("weight").isNull())
        .select(*columns)
        .join(rare, "feature")
        .select(*columns, (F.col("tf") * F.col("rare_weight")).alias("tfidf"))
    )
    return here.unionByName(moved)


def feature_pivot(
    weights: DataFrame, group: str, values: Sequence[str], value: str = "tfidf"
) -> DataFrame:
    """One row per feature and one column per given value of ``group``: the largest weight or 0.

    The values are named by the caller, so the width is known and no job looks for them. For an
    unbounded list of items use the long table.
    """
    wide = weights.groupBy("feature").pivot(group, list(values)).agg(F.max(value))
    return wide.na.fill(0.0)


def feature_vectors(wide: DataFrame, values: Sequence[str]) -> DataFrame:
    """The columns of a pivot as one Spark ML vector per feature."""
    assembler = VectorAssembler(inputCols=list(values), outputCol="vector")
    return assembler.transform(wide).select("feature", "vector")


def feature_index(features: DataFrame, buckets: int = HASH_BUCKETS) -> DataFrame:
    """Add ``index``, the hash bucket of each feature."""
    hashing = HashingTF(inputCol="one", outputCol="hashed", numFeatures=buckets)
    hashed = hashing.transform(features.withColumn("one", F.array("feature")))
    # Never null, so that no null check on it is pushed below the rows it is made for.
    index = F.coalesce(F.get(F.unwrap_udt(F.col("hashed"))["indices"], F.lit(0)), F.lit(0))
    return hashed.withColumn("index", index).drop("one", "hashed")


def hashed_vectors(
    content: DataFrame, buckets: int = HASH_BUCKETS, keep_blank: bool = False, carry: Sequence[str] = ()
) -> tuple[DataFrame, IDFModel]:
    """(item, features): one Spark ML vector of hashed weights per item, and the fitted weights.

    The hashed counts, and the ``carry`` columns, are dealt out and written once: fitting and weighing both read
    them, and not the texts, which may lie in few large row groups.
    """
    listed = content.select("item", *carry, text.words(F.col("text"), keep_blank).alias("words"))
    counts = HashingTF(inputCol="words", outputCol="counts", numFeatures=buckets).transform(listed)
    tasks = int(content.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = staged(counts.select("item", *carry, "counts").repartition(tasks), "hashed-counts")
    model = IDF(inputCol="counts", outputCol="features").fit(counts)
    return model.transform(counts).select("item", *carry, "features"), model


def hashed_tfidf(
    content: DataFrame, buckets: int = HASH_BUCKETS, keep_blank: bool = False, beside: str | None = None
) -> DataFrame:
    """(item, feature, tf, index, value): the weight of each feature's hash bucket in its item.

    Features of an item that share a bucket share its value, as in ``hashed_vectors``, but each
    stays matched to its own bucket. Where each item has one row, its words are counted, hashed and summed by
    bucket in that row, and nothing moves; the words of several rows of an item meet first. They are written
    once, so that weights and values do not look them up again. Bucket weights are at most ``buckets`` rows.

    ``beside`` is a column of sparse vectors by bucket, for content of one row an item: the entry of the feature's
    bucket in its own row's vector comes as ``beside``, null if there is none.
    """
    if repeats(content):
        if beside is not None:
            raise ValueError("an item with several rows has no vector of its own")
        long = term_frequency(content, keep_blank)
        counted = long.groupBy("item").agg(F.collect_list(F.struct("feature", "tf")).alias("counts"))
    else:
        counts = text.word_counts(text.words(F.col("text"), keep_blank)).alias("counts")
        counted = content.select("item", counts, *([] if beside is None else [beside]))
    words = text.word_buckets(F.col("counts"), buckets, None if beside is None else F.col(beside))
    grouped = staged(counted.select("item", words.alias("words")), "hashed-term-frequency")
    weights = (
        grouped.select(F.explode(F.array_distinct("words.index")).alias("index"))
        .groupBy("index")
        .agg(F.count("*").alias("df"))
        .withColumn("items", _item_count(content))
        .select("index", F.log((F.col("items") + 1) / (F.col("df") + 1)).alias("weight"))
    )
    if buckets <= HASH_BUCKETS:
        weights = F.broadcast(weights)
    return (
        grouped.select("item", F.inline("words"))
        .join(weights, "index")
        .select(
            "item", "feature", "tf", "index", (F.col("n") * F.col("weight")).alias("value"),
            *([] if beside is None else ["beside"]),
        )
    )
