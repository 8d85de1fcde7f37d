"""File scans and sinks.

CSV input is text; each column is cast with ``try_cast`` so that one bad field gives a null
instead of failing the scan, and lenient dates such as ``2018-1-5`` still parse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.session import staged


def read_headed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Columns are found by header name, so files may hold others and in any order.

    All files of a folder must have the same header; another one fails the scan, as Spark reads
    their fields by position.
    """
    named = spark.read.option("header", True).csv(path).schema
    raw = spark.read.schema(named).option("header", True).option("enforceSchema", False).csv(path)
    return raw.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema))


def read_headerless_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Columns are taken by position and named by ``schema``."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.schema(text).option("header", False).csv(path)
    return raw.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema))


REJECTS = "array<struct<column:string,value:string,reason:string>>"

# The column in which Spark keeps a line whose fields are not as many as the header's.
BAD_LINE = "_corrupt_record"


def _with_rejects(raw: DataFrame, schema: T.StructType, label: str) -> tuple[DataFrame, DataFrame]:
    """Typed rows and what was lost of them, from one pass over the text.

    The typed rows and their rejects are written as one table; both results read that.
    """
    faults = []
    for f in schema:
        text = F.col(f"`{f.name}`")
        lost = text.isNotNull() & (F.trim(text) != "") & text.try_cast(f.dataType).isNull()
        fault = F.struct(F.lit(f.name).alias("column"), text.alias("value"), F.lit(f.dataType.simpleString()).alias("reason"))
        faults.append(F.when(lost, fault))
    line = F.col(BAD_LINE)
    fields = F.struct(F.lit(None).cast("string").alias("column"), line.alias("value"), F.lit("number of fields").alias("reason"))
    rejects = F.array_compact(F.array(*faults, F.when(line.isNotNull(), fields))).cast(REJECTS)
    typed = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema]
    row = F.struct(*typed).alias("typed")
    table = staged(
        raw.select(
            F.col("_metadata.file_path").alias("file"),
            F.monotonically_increasing_id().alias("row"),
            row,
            rejects.alias("rejects"),
        ),
        label,
    )
    return table.select("typed.*"), table.select("file", "row", F.inline("rejects"))


def read_headed_csv_checked(
    spark: SparkSession, path: str, schema: T.StructType
) -> tuple[DataFrame, DataFrame]:
    """What ``read_headed_csv`` gives, and a table of the fields it could not take.

    Rejects are (file, row, column, value, reason): a field that does not read as its type, or a whole line
    (column null) with too few or too many fields. ``row`` rises with the lines of a file. Empty fields are
    nulls and no rejects. The files are read once; both tables lie in the shared folder.
    """
    named = spark.read.option("header", True).csv(path).schema
    raw = spark.read.schema(T.StructType([*named, T.StructField(BAD_LINE, T.StringType())]))
    return _with_rejects(
        raw.option("header", True).option("columnNameOfCorruptRecord", BAD_LINE).csv(path), schema, "headed-csv"
    )


def read_headerless_csv_checked(
    spark: SparkSession, path: str, schema: T.StructType
) -> tuple[DataFrame, DataFrame]:
    """What ``read_headerless_csv`` gives, and its rejects as in ``read_headed_csv_checked``."""
    text = [T.StructField(f.name, T.StringType()) for f in schema]
    raw = spark.read.schema(T.StructType([*text, T.StructField(BAD_LINE, T.StringType())]))
    return _with_rejects(
        raw.option("header", False).option("columnNameOfCorruptRecord", BAD_LINE).csv(path), schema, "headerless-csv"
    )


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.option("header", header).csv(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet sink; partition columns let later scans prune whole folders."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(model, path: str) -> None:
    """Any fitted Spark ML model or fitted chain of stages."""
    model.write().overwrite().save(path)
