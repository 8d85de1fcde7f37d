"""Column helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

# Elements that one step of a running sum inside an array adds up.
BLOCK = 256


def filled(text: Column) -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The array of the words of a text."""
    return F.regexp_extract_all(filled(text), F.lit(WORD), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    """The sum of an array of whole numbers."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def starts(lengths: Column) -> Column:
    """For each element of an array of lengths, the sum of those before it.

    Sums run within blocks of 256 elements and then over the blocks, so that an array of n elements
    takes about 256 n steps and not n * n.
    """

    def in_block(offset: Column, block: Column) -> Column:
        return F.transform(block, lambda _, i: offset + total(F.slice(block, 1, i)))

    def over_blocks(blocks: Column) -> Column:
        return let(
            F.transform(blocks, total),
            lambda sums: F.flatten(
                F.transform(blocks, lambda b, i: in_block(total(F.slice(sums, 1, i)), b))
            ),
        )

    def split(all_lengths: Column) -> Column:
        last = F.floor((F.size(all_lengths) - 1) / BLOCK).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(0), last), lambda b: F.slice(all_lengths, b * BLOCK + 1, BLOCK)
        )
        return F.when(F.size(all_lengths) > 0, over_blocks(blocks)).otherwise(
            F.array().cast("array<bigint>")
        )

    return let(lengths, split)


def row_key(rows: DataFrame) -> Column:
    """A digest of the whole row: rows with the same key are copies of each other.

    Needed where a row must be found again in a second scan and its id may be null or repeated.
    """


    def field(name: str) -> Column:
        # Its length before it, so that no content can look like the end of a field.
        value = F.col(f"`{name}`").cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit("="), value), F.lit("-"))

    return F.sha2(F.concat(*(field(c) for c in rows.columns)), 256)


def unused(rows: DataFrame, name: str) -> str:
    """A column name like ``name`` that the rows do not have."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(rows: DataFrame) -> int:
    """How many partitions the session deals rows to."""
    return max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
