"""Dense numbers for ids of any kind, and for rows in an order.

ALS takes whole numbers of 32 bits alone. An id book is a table (id, number): ids are sorted over all tasks, each
gets the number of ids before it. A book only grows: ids it has keep their numbers, new ones are numbered behind
them. Null ids get no number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.operators.joins import fits_broadcast
from staylens.session import Workspace, staged

# Low bits of a row's number within the task that wrote it, as Spark counts rows.
ROW_BITS = 33
LARGEST = 2**31 - 1


def in_order(rows: DataFrame, *order: Column | str, start: int = 0, name: str = "place") -> DataFrame:
    """The rows with ``place``, their number in the order given, from ``start`` on; a written table.

    Rows are sorted by range, each task's rows are counted, and the counts before it are added up: one number
    a task comes to the driver. Rows that are equal in the order are numbered in any order.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with Workspace(spark) as work:
        dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
        counted = staged(dealt.withColumn(name, F.monotonically_increasing_id()), "in-order")
        task = F.shiftrightunsigned(name, ROW_BITS).cast("int")
        sizes = counted.groupBy(task.alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect()
        before, offsets = start, []
        for r in sizes:
            offsets.append((r.task, before))
            before += r.n
        table = F.broadcast(spark.createDataFrame(offsets, "in_order_task int, in_order_before long"))
        within = F.col(name).bitwiseAND(F.lit((1 << ROW_BITS) - 1))
        numbered = counted.withColumn("in_order_of", task).join(
            table, F.col("in_order_of") == F.col("in_order_task")
        )
        result = numbered.withColumn(name, F.col("in_order_before") + within).select(*counted.columns)
        return work.keep(staged(result, "in-order"))


def grown_book(ids: DataFrame, column: str, book: DataFrame | None = None) -> DataFrame:
    """The book with numbers for all ids in the column; a written table. ``book`` None starts one."""
    found = ids.select(F.col(column).alias("id")).filter("id is not null").distinct()
    start = 0
    if book is not None:
        found = found.join(book, "id", "left_anti")
        last = book.agg(F.max("number")).first()[0]
        start = 0 if last is None else last + 1
    with Workspace(ids.sparkSession) as work:
        fresh = in_order(found, "id", start=start)
        too_many = F.raise_error(F.lit("more ids than 32-bit numbers")).cast("int")
        number = F.when(F.col("place") <= LARGEST, F.col("place").cast("int")).otherwise(too_many)
        numbered = fresh.select("id", number.alias("number"))
        return work.keep(staged(numbered if book is None else book.unionByName(numbered), "id-book"))


def with_numbers(rows: DataFrame, column: str, book: DataFrame, number: str) -> DataFrame:
    """The rows whose id the book has, with its number. A small book is broadcast, else hot ids are split."""
    known = book.select(F.col("id").alias("book_id"), F.col("number").alias("book_number"))
    known = F.broadcast(known) if fits_broadcast(book) else known
    joined = rows.join(known, F.col(column) == F.col("book_id")).drop("book_id")
    return joined.withColumnRenamed("book_number", number)


def with_ids(rows: DataFrame, number: str, book: DataFrame, column: str) -> DataFrame:
    """The rows with the id that stands behind a number."""
    known = book.select(F.col("id").alias("book_id"), F.col("number").alias("book_number"))
    known = F.broadcast(known) if fits_broadcast(book) else known
    joined = rows.join(known, F.col(number) == F.col("book_number")).drop("book_number")
    return joined.withColumnRenamed("book_id", column)
