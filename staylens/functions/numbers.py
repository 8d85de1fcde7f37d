"""Arithmetic over a fixed list of columns, all inside generated code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: how a number is written. Casting alone also takes nan, inf, 1d and 2f.
NUMBER = r"^\s*[+-]?[0-9]+(\.[0-9]+)?\s*$"


def as_number(text: Column) -> Column:
    """The number a text states, null if it states none."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def total(columns: Sequence[Column]) -> Column:
    return reduce(add, columns)


def distance(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Straight-line distance between two points given column by column."""
    return F.sqrt(squared_distance(left, right))


def squared_distance(left: Sequence[Column], right: Sequence[Column]) -> Column:
    gaps = [a - b for a, b in zip(left, right, strict=True)]
    return total([gap * gap for gap in gaps])
