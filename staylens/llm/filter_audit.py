"""How the filters of a corpus interact, by sorted posting lists.

Each document has a number. For each filter, part and range of numbers there is a posting list: the sorted
numbers of the documents that fail the filter. Two more lists hold the documents labelled good and toxic.
What a filter removes after others is the difference between its list and the union of theirs; what
remains after all of them is what no list of the union holds. Unions and differences come from galloping
merges: the ids of the shorter list are located in the longer one by binary search, and the runs between
them are copied whole. A range gives one row of sizes for each filter and set of filters before it (80 for five
filters); sizes are summed over the ranges of a part, and every order of the filters reads its figures from
those sums.

A range holds at most ``RANGE`` documents, so no list grows with a part, however large; a range is a stretch of
one part within one partition of the written table of measures. Lists of different ranges never meet.

A null text is the empty text. A null part and an empty one are one part. Rows are documents: copies and
rows with an equal id each count. A text is a copy if an equal one has a smaller id; rows of equal ids are not
copies of each other, and a null id is neither smaller nor larger than another. Of several labels of one id any
that says 1 counts; a null label says nothing, and null ids have none. Texts are compared by a digest of 128
bits. Without documents there are no rows. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm.common import filled
from staylens.session import staged

# The filters in order of their lists, and the thresholds of A, B and C.
FILTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT = 65
MOST_CAPITALS = 5
COPIES, GOOD, TOXIC = 4, 5, 6

SYMBOLS = re.compile(rb"[#$%&*|]")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
CONTINUED = bytes(range(0x80, 0xC0))

# Bits of a number within a range.
RANGE_BITS = 16
RANGE = 1 << RANGE_BITS

# Texts above so many bytes are cut into words one by one.
LONG = 1 << 22


# -- measures


def word_counts(text: bytes) -> tuple[int, int]:
    """How many words a text has, and how many different ones."""
    if len(text) <= LONG:
        words = text.split()
        return len(words), len(set(words))
    count, seen = 0, set()
    for match in WORD.finditer(text):
        count += 1
        seen.add(match.group())
    return count, len(seen)


def own_failures(text: bytes) -> int:
    """A bit for each of the filters A to D that the text fails by itself."""
    words, distinct = word_counts(text)
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, CONTINUED))
    fails = (
        words < LEAST_WORDS,
        100 * distinct < LEAST_DISTINCT * words,
        100 * capitals > MOST_CAPITALS * points,
        SYMBOLS.search(text) is not None,
    )
    return sum(1 << bit for bit, failed in enumerate(fails) if failed)


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_py() for t in batch.column(2).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([own_failures(t) for t in texts], pa.int32()),
                pa.array([blake2b(t, digest_size=16).digest() for t in texts], pa.binary()),
            ],
            names=["id", "part", "fails", "digest"],
        )


def measured(docs: DataFrame, id_column: str, text: str, part: str) -> DataFrame:
    """Per document: ``number``, ``id``, ``part``, ``fails`` (a bit for each of A to D), ``digest``.

    The rows are written, so that every later read sees the same numbers.
    """
    rows = docs.select(
        F.col(id_column).alias("id"), filled(F.col(part)).alias("part"), filled(F.col(text)).alias("text")
    )
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_measure_batches, f"id {kind}, part string, fails int, digest binary")
    return staged(found.withColumn("number", F.monotonically_increasing_id()), "audit-measures")


# -- posting lists


def postings(rows: DataFrame, labels: DataFrame, id_column: str) -> DataFrame:
    """One row for each document on each list: part, number, list (0 to 6)."""
    bits = [F.when(F.col("fails").bitwiseAND(1 << k) != 0, F.lit(k)) for k in range(COPIES)]
    own = rows.select("part", "number", F.explode(F.array_compact(F.array(*bits))).alias("list"))
    # Written, so that a join with one hot text can be split at run time.
    first = staged(
        rows.groupBy("digest")
        .agg(F.min("id").alias("first"), F.max("id").alias("last"))
        .filter("first < last")
        .select("digest", "first"),
        "audit-copies",
    )
    copies = rows.select("part", "number", "id", "digest").join(first, "digest").filter("id > first")
    said = (
        labels.select(
            F.col(id_column).alias("id"),
            F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"),
            F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"),
        )
        .groupBy("id")
        .agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
        .filter("good or toxic")
    )
    marks = F.array(F.when(F.col("good"), F.lit(GOOD)), F.when(F.col("toxic"), F.lit(TOXIC)))
    marked = rows.filter("id is not null").select("part", "number", "id").join(said, "id")
    return own.unionByName(copies.select("part", "number", F.lit(COPIES).alias("list"))).unionByName(
        marked.select("part", "number", F.explode(F.array_compact(marks)).alias("list"))
    )


def posting_lists(found: DataFrame) -> DataFrame:
    """Per part and range: the seven sorted lists ``l0`` to ``l6``."""
    lists = [
        F.sort_array(F.collect_list(F.when(F.col("list") == k, F.col("number")))).alias(f"l{k}")
        for k in range(TOXIC + 1)
    ]
    return found.groupBy("part", F.shiftright("number", RANGE_BITS).alias("range")).agg(*lists)


# -- merges


def held(ids: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of the sorted ids the other sorted list holds; the shorter gallops through the longer."""
    if len(ids) == 0 or len(other) == 0:
        return np.zeros(len(ids), dtype=bool)
    if len(ids) <= len(other):
        at = np.searchsorted(other, ids)
        return other[np.minimum(at, len(other) - 1)] == ids
    at = np.searchsorted(ids, other)
    inside = at < len(ids)
    at, other = at[inside], other[inside]
    mask = np.zeros(len(ids), dtype=bool)
    mask[at[ids[at] == other]] = True
    return mask


def merged(lists: list[np.ndarray]) -> np.ndarray:
    """The union of sorted lists, the shortest first; runs of the longer are copied whole."""
    union = np.empty(0, dtype=np.int64)
    for ids in sorted(lists, key=len):
        short, long = (ids, union) if len(ids) <= len(union) else (union, ids)
        fresh = short[~held(short, long)]
        union = np.insert(long, np.searchsorted(long, fresh), fresh)
    return union


def differences(lists: list[np.ndarray], good: np.ndarray, toxic: np.ndarray) -> list[tuple]:
    """For each filter and set of others before it: what it removes, and the good and toxic among it."""
    rows = []
    for before in range(1 << len(lists)):
        union = merged([ids for k, ids in enumerate(lists) if before >> k & 1])
        for k, ids in enumerate(lists):
            if not before >> k & 1:
                fresh = ids[~held(ids, union)]
                rows.append((k, before, len(fresh), int(held(fresh, good).sum()), int(held(fresh, toxic).sum())))
    return rows


SIZES = ("filter", "before", "removed", "good", "toxic")


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            lists = [
                batch.column(k + 1).slice(i, 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                for k in range(TOXIC + 1)
            ]
            rows = differences(lists[:GOOD], lists[GOOD], lists[TOXIC])
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            part = pa.array([batch.column(0)[i].as_py()] * len(rows), pa.string())
            yield pa.RecordBatch.from_arrays([part, *columns], names=["part", *SIZES])


def range_sizes(lists: DataFrame) -> DataFrame:
    """Per part, range, filter and set of filters before it: documents removed, good and toxic ones."""
    columns = [f"l{k}" for k in range(TOXIC + 1)]
    schema = "part string, " + ", ".join(f"{c} long" for c in SIZES)
    return lists.select("part", *columns).mapInArrow(_merge_batches, schema)


def sizes(lists: DataFrame, parts: DataFrame) -> DataFrame:
    """``range_sizes`` summed by part, with zeros where nothing fails, and the part's ``documents``."""
    sets = F.transform(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1)), lambda s: s.cast("long"))
    nothing = parts.select(
        "part", "documents", F.explode(F.sequence(F.lit(0), F.lit(len(FILTERS) - 1))).alias("filter")
    ).select("part", "documents", F.col("filter").cast("long").alias("filter"), F.explode(sets).alias("before"))
    nothing = nothing.filter(~bit_set(F.col("before"), F.col("filter")))
    zeros = nothing.select("*", *(F.lit(0).cast("long").alias(c) for c in SIZES[2:]))
    counted = range_sizes(lists).withColumn("documents", F.lit(0).cast("long"))
    return (
        counted.unionByName(zeros)
        .groupBy("part", "filter", "before")
        .agg(*(F.sum(c).alias(c) for c in ("documents", *SIZES[2:])))
    )


def bit_set(bits: Column, place: Column) -> Column:
    return F.call_function("shiftright", bits, place.cast("int")).bitwiseAND(F.lit(1)) != 0


# -- orders


def orders() -> list[tuple[str, int, int, int]]:
    """Every step of every order of the filters: the order, the step, its filter, the set before it."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            rows.append(("".join(FILTERS[f] for f in order), step, k, before))
            before |= 1 << k
    return rows


def audit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    part: str = "source",
) -> DataFrame:
    """One row for each part, order of the filters and step, with what the step does there."""
    rows = measured(docs, id_column, text, part)
    parts = rows.groupBy("part").agg(F.count("*").alias("documents"))
    summed = sizes(posting_lists(postings(rows, labels, id_column)), parts)

    # A filter follows a set of s others in s! (4 - s)! orders.
    others = len(FILTERS) - 1
    ways = F.element_at(
        F.array(*(F.lit(factorial(s) * factorial(others - s)) for s in range(others + 1))),
        F.bit_count("before") + 1,
    )
    all_before = F.lit((1 << len(FILTERS)) - 1).cast("long").bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), F.col("filter").cast("int"))
    )
    own = Window.partitionBy("part", "filter")
    known = summed.select(
        "*",
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).over(own).alias("failing"),
        F.sum(F.when(F.col("before") == all_before, F.col("removed"))).over(own).alias("unique_fails"),
        F.sum(F.col("removed") * ways).over(own).alias("shapley"),
    )

    # The steps are a fixed table of 600 rows.
    steps = docs.sparkSession.createDataFrame(
        orders(), "filter_order string, step int, filter long, before long"
    )
    taken = known.join(F.broadcast(steps), ["filter", "before"])
    so_far = F.sum("removed").over(Window.partitionBy("part", "filter_order").orderBy("step"))
    return taken.select(
        "part",
        "filter_order",
        "step",
        (F.col("documents") - so_far).alias("kept"),
        "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails",
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        "shapley",
    )
