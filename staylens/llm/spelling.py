"""Spelling variants of words, found by a dictionary of pairs of trie nodes.

The words stand in two tries, one of their prefixes and one of their suffixes (the words reversed); the nodes
are numbered. A pair (prefix node, suffix node) then says what a word is but for the stretch between the
two. Each word of length m gives m + 1 pairs that skip nothing (prefix of i, suffix of m - i) and m pairs that
skip the code point at i (prefix of i, suffix of m - i - 1). Two words differ by one replaced code point exactly
if they share a skipping pair, and by one inserted code point exactly if a skipping pair of the longer is a
whole pair of the shorter. So the join by pairs finds all near words and nothing else.

A pair is one text around at most one code point. The words that meet in it are therefore one whole word and at
most as many others as there are code points in ``LETTERS`` (90), however many words there are. They are not
multiplied: near words are counted from the sizes, and a word's best near word is the first in the pair that
is not itself. In a run of equal code points the skips give the same shorter word; only the first counts.

The words of a table are runs of ``LETTERS`` with A-Z lower-cased; of a run whose crc32 together with the
document's id is divisible by ``TYPO``, one code point is left out. They count with ``LEAST`` code points and
``COUNT`` occurrences in all. A word's form is its near word with the most occurrences (of equals the
smallest) if that has ``RATIO`` times its own; occurrences grow along forms, so the chain to the root ends.

A null text has no words, a null id is the empty text in the crc32. Rows are documents: copies and rows of equal ids
count each. Nodes deeper than ``DEEP`` are known by a digest chained along the word, so a word of m code
points takes work in proportion to m. Both sides of every join are words or their nodes, so they shuffle: Spark sizes
the nodes by the file of their words and would broadcast them. Without words there are no rows. Only the id and the text are read, so
other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import filled, let
from staylens.operators.joins import merged
from staylens.session import staged

# What words are made of, and which of them count.
LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TYPO = 199
LEAST = 6
COUNT = 5
RATIO = 5

# Code points of a prefix after which a digest stands for the stretch so far.
DEEP = 64

# Rows in a batch of nodes.
ROWS = 1 << 16


# -- words


def with_typo(run: Column, ids: Column) -> Column:
    """The run, without one of its code points where the crc32 of id and run says so."""
    crc = F.crc32(F.concat(ids, F.lit(":"), run).cast("binary"))
    at = (crc % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(crc % TYPO == 0, cut).otherwise(run)


def word_counts(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    least: int = LEAST,
    count: int = COUNT,
) -> DataFrame:
    """The words that count: ``word`` and its occurrences ``n``. Tasks sum before the shuffle."""
    lowered = F.translate(filled(F.col(text)), UPPER, LOWER)
    runs = docs.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lowered, F.lit(LETTERS), F.lit(0))).alias("run"),
    ).filter(F.length("run") >= least)
    return (
        runs.select(with_typo(F.col("run"), F.col("id")).alias("word"))
        .filter(F.length("word") >= least)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= count)
    )


# -- tries


def path_keys(word: str) -> list[str]:
    """A key for each node on the way to the word, without the root: its prefixes, deep ones by digest."""
    keys, known = [], ""
    for low in range(0, len(word), DEEP):
        piece = word[low : low + DEEP]
        keys += [known + piece[:i] for i in range(1, len(piece) + 1)]
        known = f"{low + DEEP}:{sha256((known + piece).encode()).hexdigest()}:"
    return keys


def _node_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, depth, trie, key) of the nodes of each word; trie 0 is of prefixes, 1 of suffixes."""
    names = ["id", "depth", "trie", "key"]

    def packed(rows: list[list]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=names)

    rows: list[list] = [[], [], [], []]
    for batch in batches:
        for number, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for trie, way in ((0, word), (1, word[::-1])):
                keys = path_keys(way)
                rows[0] += [number] * len(keys)
                rows[1] += range(1, len(keys) + 1)
                rows[2] += [trie] * len(keys)
                rows[3] += keys
            if len(rows[0]) >= ROWS:
                yield packed(rows)
                rows = [[], [], [], []]
    if rows[0]:
        yield packed(rows)


def numbered_paths(words: DataFrame) -> DataFrame:
    """Per word: ``id``, ``forward`` and ``backward``, the numbers of its nodes by depth, the root's 0 first.

    ``words`` has ``id`` and ``word`` and is a written table.
    """
    steps = words.select("id", "word").mapInArrow(_node_batches, "id long, depth int, trie int, key string")
    nodes = staged(
        steps.select("trie", "key").distinct().withColumn("node", F.monotonically_increasing_id() + 1),
        "spelling-nodes",
    )

    def path(trie: int) -> Column:
        found = F.collect_list(F.when(F.col("trie") == trie, F.struct("depth", "node")))
        ordered = F.transform(F.sort_array(found), lambda s: s["node"])
        return F.concat(F.array(F.lit(0).cast("long")), ordered)

    return (
        merged(steps).join(nodes, ["trie", "key"])
        .groupBy("id")
        .agg(path(0).alias("forward"), path(1).alias("backward"))
    )


# -- pairs


def node_pairs(words: DataFrame) -> DataFrame:
    """Per word and pair: ``prefix``, ``suffix``, and the ``member`` (rank, word, id, skips, first).

    ``rank`` is the negated number of occurrences, so members sort from the best on. ``skips`` tells skipping
    pairs from whole ones; ``first`` marks the first skip of a run of equal code points.
    """

    def member(skips: bool, first: Column) -> Column:
        return F.struct(
            (-F.col("n")).alias("rank"), F.col("word"), F.col("id"), F.lit(skips).alias("skips"), first.alias("first")
        )

    def pairs(points: Column) -> Column:
        m = F.size(points)
        whole = F.transform(
            F.sequence(F.lit(0), m),
            lambda i: F.struct(
                F.get("forward", i).alias("prefix"),
                F.get("backward", m - i).alias("suffix"),
                member(False, F.lit(False)).alias("member"),
            ),
        )
        skipping = F.transform(
            F.sequence(F.lit(0), m - 1),
            lambda i: F.struct(
                F.get("forward", i).alias("prefix"),
                F.get("backward", m - i - 1).alias("suffix"),
                member(True, (i == 0) | (F.get(points, i) != F.get(points, i - 1))).alias("member"),
            ),
        )
        return F.concat(whole, skipping)

    paths = numbered_paths(words)
    return merged(words).join(paths, "id").select(F.inline(let(F.split("word", ""), pairs)))


def met(pairs: DataFrame) -> DataFrame:
    """Per word and pair it meets others in: ``id``, how many are ``near``, and the ``best`` of them.

    Each pair has at most one whole member and one skipping member for each code point.
    """
    members = F.sort_array(F.collect_list("member"))
    places = pairs.groupBy("prefix", "suffix").agg(members.alias("members")).filter(F.size("members") > 1)
    places = places.select(
        F.filter("members", lambda x: ~x["skips"]).alias("whole"),
        F.filter("members", lambda x: x["skips"]).alias("skipping"),
        F.filter("members", lambda x: x["first"]).alias("firsts"),
    )

    def best(found: Column) -> Column:
        return F.when(found.isNotNull(), F.struct(found["rank"].alias("rank"), found["word"].alias("word")))

    def of_skipping(x: Column) -> Column:
        top = F.get("skipping", 0)
        other = F.when(top["id"] == x["id"], F.get("skipping", 1)).otherwise(top)
        shorter = F.when(x["first"], F.get("whole", 0))
        more = F.when(shorter.isNotNull(), 1).otherwise(0)
        return F.struct(
            x["id"].alias("id"),
            (F.size("skipping") - 1 + more).cast("long").alias("near"),
            F.least(best(other), best(shorter)).alias("best"),
        )

    def of_whole(x: Column) -> Column:
        return F.struct(
            x["id"].alias("id"),
            F.size("firsts").cast("long").alias("near"),
            best(F.get("firsts", 0)).alias("best"),
        )

    rows = F.concat(F.transform("skipping", of_skipping), F.transform("whole", of_whole))
    return places.select(F.inline(rows)).filter("near > 0")


def with_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Per word: ``word``, ``n``, ``n_near``, ``form`` and its ``form_n``."""
    near = met(node_pairs(words)).groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    taken = -F.col("best.rank") >= ratio * F.col("n")
    return words.join(merged(near), "id", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(taken, F.col("best.word")).alias("form"),
        F.when(taken, -F.col("best.rank")).alias("form_n"),
    )


# -- roots


def roots(forms: DataFrame) -> DataFrame:
    """Per word that has a form: ``word`` and ``root``, where its chain of forms ends.

    Each round follows the chains twice as far. Occurrences grow ``RATIO`` times at each step, so chains are
    short and rounds few. ``forms`` has ``word`` and ``form`` and is a written table.
    """
    current = forms.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = current.select(F.col("word").alias("at"), F.col("root").alias("further"))
        step = staged(
            current.join(merged(ahead), F.col("root") == F.col("at"), "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
            ),
            "spelling-roots",
        )
        current = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return current


def variants(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    least: int = LEAST,
    count: int = COUNT,
    ratio: int = RATIO,
) -> DataFrame:
    """Per word of the table: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``."""
    counted = word_counts(docs, id_column, text, least, count)
    words = staged(counted.withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    forms = staged(with_forms(words, ratio), "spelling-forms")
    return forms.join(merged(roots(forms)), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
