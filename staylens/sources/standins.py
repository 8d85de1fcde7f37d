"""Maps the given star-schema tables to the entities of this library.

Every entity uses whole tables. The oracle SQL builds the same entities from the same rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _joined(*parts: Column) -> Column:
    return F.concat(*(p.cast("string") for p in parts))


def _rooms(line: Column, quantity: Column) -> Column:
    """Room text with kids, blank kids, two rooms, unreadable adults, and none at all."""
    lit = F.lit
    kind = quantity % 5
    return (
        F.when(quantity == 50, lit(None).cast("string"))
        .when(kind == 0, _joined(line, lit(":")))
        .when(kind == 1, _joined(line, lit(":"), quantity % 18, lit(","), line, lit("|1")))
        .when(kind == 2, _joined(1 + line % 3, lit("|2:"), quantity % 18))
        .when(kind == 3, _joined(lit("x"), line))
        .otherwise(_joined(line))
    )


def stays(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Searches or leads from order lines: ordered on ``date``, shipped on ``check_in``."""
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    line, quantity = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    arrive = F.to_date("l_shipdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws(
            "-", *(F.col(c).cast("string") for c in
                   ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
        ).alias(f"{kind}_id"),
        F.col("l_partkey").alias("hotel_id"),
        F.to_date("o_orderdate").alias("date"),
        arrive.alias("check_in"),
        F.date_add(arrive, line - 1).alias("check_out"),
        _rooms(line, quantity).alias("room_description"),
        F.col("l_extendedprice").alias("total_usd"),
        (1 + F.col("l_suppkey") % 3).cast("int").alias("nb_rooms"),
    )


def searches(spark: SparkSession, folder: str) -> DataFrame:
    return stays(spark, folder, "search")


def leads(spark: SparkSession, folder: str) -> DataFrame:
    return stays(spark, folder, "lead")


def _unless(missing: Column, value: Column) -> Column:
    return F.when(~missing, value)


def hotels(spark: SparkSession, folder: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    word = F.split("p_name", " ")
    brand = F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit(""))

    # Tokens that a cast takes for numbers though they are none.
    odd = F.get(F.array(*map(F.lit, ("nan", "1d", "inf", "2.5"))), (key % 4).cast("int"))

    def listed(*parts: Column) -> Column:
        return F.concat_ws("|", *(p.cast("string") for p in parts))

    return table(spark, folder, "part").select(
        key.alias("hotel_id"),
        (key % 25).alias("place_id"),
        _unless(size % 10 == 0, listed(size % 4, brand, F.get(word, F.lit(0)), odd, size)).alias("themes"),
        _unless(size % 7 == 0, listed(size % 3, F.get(word, F.lit(1)), size)).alias("facilities"),
        (size % 13).alias("rating"),
        _unless(size % 11 == 0, size * 10).alias("number_of_reviews"),
        F.length("p_type").alias("property_type"),
        (size % 11).cast("double").alias("cleanliness_rating"),
        ((size + 1) % 11).cast("double").alias("service_rating"),
        _unless(size % 9 == 0, (size % 7).cast("double")).alias("facilities_rating"),
        (F.col("p_retailprice") / F.lit(100.0)).alias("location_rating"),
        F.lit(10.0).alias("pricing_rating"),
        (size / F.lit(5.0)).alias("rooms_rating"),
        _unless(size % 8 == 0, F.lit(3.5)).alias("dining_rating"),
        ((size % 5) * F.lit(1.5)).alias("overall_rating"),
        size.cast("double").alias("popularity"),
        F.col("p_retailprice").alias("min_rate_usd"),
        _unless(
            size % 12 == 0,
            F.date_add(F.lit("2018-01-01").cast("date"), (key % 365).cast("int")),
        ).alias("cheapest_check_in"),
    )


def places(spark: SparkSession, folder: str) -> DataFrame:
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    return table(spark, folder, "nation").select(
        key.cast("long").alias("place_id"),
        region.alias("place_type_id"),
        (key * F.lit(1.5) - F.lit(20.0)).alias("latitude"),
        (region * F.lit(10.0)).alias("longitude"),
        (key % 7).cast("double").alias("rank"),
    )


def brand_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Brand number as the given cluster of each hotel."""
    number = F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")).cast("int")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("hotel_id"), number.alias("cluster_id")
    )


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """One rating per user and item: the mean of the values of their events.

    Summed as decimals, so the mean does not depend on the order of rows.
    """
    item = F.get_json_object("props", "$.k").cast("int")
    return (
        table(spark, folder, "events")
        .select(F.col("user_id").alias("user"), item.alias("item"), "value")
        .groupBy("user", "item")
        .agg(
            (F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count("value")).alias(
                "rating"
            )
        )
    )


def content(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents as item texts."""
    return table(spark, folder, "documents").select(F.col("doc_id").alias("item"), "text", "lang")


def item_names(spark: SparkSession, folder: str) -> DataFrame:
    """Items described by names; some rows lack the second actor."""
    brand = F.col("p_brand")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("item"),
        F.col("p_name").alias("director"),
        F.when(F.col("p_size") % 10 != 0, brand).alias("actor2"),
        F.col("p_type").alias("actor3"),
        F.col("p_name").alias("actor1"),
    )


VECTOR_SIZE = 64


def point_columns() -> list[str]:
    return [f"e{i}" for i in range(VECTOR_SIZE)]


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings, one column per dimension, with their label as the given cluster."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id"),
        F.col("label").alias("cluster_id"),
        *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(point_columns())),
    )


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Two 0/1 columns standing in for a label and a prediction."""
    return table(spark, folder, "labels").select(
        "doc_id", F.col("quality").alias("gooddeal"), F.col("toxic").alias("prediction")
    )
