"""Typed cleaning steps: casts, null handling, duplicates, sampling and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions.numbers import as_number


# Parts into which keys are hashed.
BUCKETS = 10_000


def numeric_cast(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Every column to double except those in ``keep``; ids belong there, so they stay exact.

    Text that states no number, ``nan`` and ``inf`` among it, becomes null.
    """

    def cast(name: str, kind: str) -> Column:
        if name in keep:
            return F.col(name)
        value = as_number(F.col(name)) if kind == "string" else F.col(name).try_cast("double")
        return value.alias(name)

    return df.select(*(cast(name, kind) for name, kind in df.dtypes))


def fill_numeric(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Null numbers to 0. Text, dates and the ``keep`` columns keep their nulls."""
    return df.na.fill(0, subset=[c for c in df.columns if c not in keep])


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Only rows without any null."""
    return df.na.drop()


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Equal rows once. Copies merge before the shuffle, so a much-copied row stays cheap."""
    return df.dropDuplicates()


def one_row_per(df: DataFrame, key: str) -> DataFrame:
    """One row per key: the smallest in column order, the same on every run.

    An aggregate, not a window, so the copies of one key merge before the shuffle.
    """
    rest = [c for c in df.columns if c != key]
    return (
        df.groupBy(key)
        .agg(F.min(F.struct(*rest)).alias("row"))
        .select(key, "row.*")
        .select(*df.columns)
    )


def sample_rows(
    df: DataFrame, fraction: float, seed: int = 0, with_replacement: bool = False
) -> DataFrame:
    """A random share of the rows; with replacement a row may come several times."""
    return df.sample(with_replacement, fraction, seed)


def sample_by_key(df: DataFrame, key: Sequence[str], share: float, seed: int = 0) -> DataFrame:
    """The rows whose key's hash falls into the share: the same rows on every run."""
    return df.filter(_bucket(key, seed) < int(round(share * BUCKETS)))


def _bucket(key: Sequence[str], seed: int) -> Column:
    """A number from 0 to 9,999, decided by the key alone."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in key)))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(BUCKETS))


def hash_split(
    df: DataFrame, key: Sequence[str], train_share: float = 0.7, seed: int = 0
) -> DataFrame:
    """Add ``split``: ``train`` or ``test``, decided by the row's key alone.

    A row falls on the same side on every run and after any task is run again, which a
    random split of shuffled rows cannot promise.
    """
    inside = _bucket(key, seed) < int(round(train_share * BUCKETS))
    side = F.when(inside, "train").otherwise("test")
    return df.withColumn("split", side)
