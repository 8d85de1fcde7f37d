"""Standard scores by row or by column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions.numbers import total


def scaled_names(columns: Sequence[str]) -> list[str]:
    return [f"z_{c}" for c in columns]


def rowwise_zscore(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``z_<column>``: each value against the mean and deviation of its own row.

    The deviation is that of the population; a constant row scales to zeros. Plain arithmetic
    over named columns, so it stays in generated code.
    """
    values = [F.col(c).cast("double") for c in columns]
    size = F.lit(float(len(columns)))
    centred = df.withColumn("row_mean", total(values) / size)
    gaps = [(v - F.col("row_mean")) * (v - F.col("row_mean")) for v in values]
    spread = centred.withColumn("row_sd", F.sqrt(total(gaps) / size)).withColumn(
        "row_sd", F.when(F.col("row_sd") == 0, 1.0).otherwise(F.col("row_sd"))
    )
    scores = {
        name: (v - F.col("row_mean")) / F.col("row_sd")
        for name, v in zip(scaled_names(columns), values, strict=True)
    }
    return spread.withColumns(scores).drop("row_mean", "row_sd")


def column_zscore(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``z_<column>``: each value against the mean and deviation of its column.

    The means and deviations are one row, read as a scalar subquery of the same plan.
    """
    moments = df.agg(
        F.struct(
            *(F.avg(c).alias(f"mean_{c}") for c in columns),
            *(F.stddev_pop(c).alias(f"sd_{c}") for c in columns),
        ).alias("moments")
    ).scalar()
    known = df.withColumn("moments", moments)
    scores = {}
    for c, name in zip(columns, scaled_names(columns), strict=True):
        sd = F.col(f"moments.sd_{c}")
        gap = F.col(c) - F.col(f"moments.mean_{c}")
        scores[name] = gap / F.when(sd == 0, 1.0).otherwise(sd)
    return known.withColumns(scores).drop("moments")


def zscore(df: DataFrame, columns: Sequence[str], axis: str = "row") -> DataFrame:
    if axis not in ("row", "column"):
        raise ValueError("axis is 'row' or 'column'")
    return rowwise_zscore(df, columns) if axis == "row" else column_zscore(df, columns)
