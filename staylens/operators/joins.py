"""When the small side of a join may be sent to every task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.functions.numbers import total

# A table is broadcast only while it is known to be smaller than this, or than the session's own
# threshold where that is larger.
BROADCAST_BYTES = 10 * 1024 * 1024

# What a row costs in a hash table besides its values.
ROW_OVERHEAD = 64

FIXED_WIDTH = (T.NumericType, T.DateType, T.BooleanType)


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes that this session lets be broadcast."""
    own = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return max(BROADCAST_BYTES, own)


def fits_broadcast(table: DataFrame, limit: int | None = None, extra_columns: int = 0) -> bool:
    """Whether the whole table is small: its counted rows times the width of a row.

    Meant for written tables, where the count comes from file footers. A table with text or
    nested columns has no fixed width and never counts as small. ``extra_columns`` are numbers
    that will be added to its rows. ``limit`` takes the place of the session's.
    """
    if limit is None:
        limit = broadcast_limit(table.sparkSession)
    if not all(isinstance(f.dataType, FIXED_WIDTH) for f in table.schema):
        return False
    width = ROW_OVERHEAD + 8 * (len(table.columns) + extra_columns)
    return table.count() * width <= limit


def broadcast_if_small(table: DataFrame, limit: int | None = None) -> DataFrame:
    """The table with a broadcast hint if it fits; else as it is, for Spark to decide.

    Without the hint a large side is sorted and merged, and hot keys are split at run time.
    """
    return F.broadcast(table) if fits_broadcast(table, limit) else table


def merged(table: DataFrame) -> DataFrame:
    """The table with a hint that both sides of its next join are sorted and merged, whatever Spark takes for their size.

    For rows that Spark sizes by those they were made from, or by the packed bytes of a file of texts: these may
    be a hundred times as large in the driver, which builds a broadcast.
    """
    return table.hint("merge")


def broadcasts_needed(table: DataFrame, most: int) -> int | None:
    """Into how many parts of the size of a broadcast a written table of numbers and texts divides.

    None if there would be more than ``most``, a column is neither, or the session allows no broadcast.
    """
    if table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() < 0:
        return None
    if not all(isinstance(f.dataType, (*FIXED_WIDTH, T.StringType)) for f in table.schema):
        return None
    texts = [f.name for f in table.schema if isinstance(f.dataType, T.StringType)]
    chars = total([F.coalesce(F.octet_length(c).cast("long"), F.lit(0)) for c in texts]) if texts else F.lit(0)
    rows, long = table.agg(F.count("*"), F.coalesce(F.sum(chars), F.lit(0))).first()
    parts = -(-(rows * (ROW_OVERHEAD + 8 * len(table.columns)) + long) // broadcast_limit(table.sparkSession))
    return max(1, parts) if parts <= most else None
