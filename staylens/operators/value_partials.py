"""Cluster means from stored partial sums: a new day of leads does not read the days before.

Leads are summed once by day and hotel into a table (day, hotel_id, usd, leads), stored in a folder for each day,
or for each week, month or year where days are many and small. Such a period that is written again, because leads
came late or were corrected, takes the place of what was there. The mean of a cluster is the sum over the days and hotels of it, so clusters can be fitted anew, or days left out,
without touching a lead. Leads without a day stand under their own null day; a null price counts in no sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.operators.stays import LEAD, stay_id
from staylens.operators.value import gooddeal, matrix_features

PARTIALS = "hotel_id bigint, usd double, leads bigint, day date, period date"


def day_sums(leads: DataFrame, day: str) -> DataFrame:
    """(day, hotel_id, usd, leads): ``effUSD`` summed in the map tasks first."""
    return leads.groupBy(F.col(day).cast("date").alias("day"), "hotel_id").agg(
        F.sum("effUSD").alias("usd"), F.count("effUSD").alias("leads")
    )


def store_days(leads: DataFrame, day: str, path: str, period: str = "day") -> None:
    """Write the sums of the periods that ``leads`` hold; others of the table stay as they are.

    ``period`` is day, week, month or year; ``leads`` must hold whole ones. The leads are read once.
    """
    begin = F.col("day") if period == "day" else F.trunc("day", period)
    sums = day_sums(leads, day).select("hotel_id", "usd", "leads", "day", begin.alias("period"))
    # By range, so that a period lies in few files and a large one spreads over several tasks.
    writer = sums.repartitionByRange("period", "day", "hotel_id").write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)


def stored_days(spark: SparkSession, path: str) -> DataFrame:
    """The stored sums; a filter on ``period`` reads those folders alone."""
    return spark.read.schema(PARTIALS).parquet(path)


def mean_of_sums(sums: DataFrame, hotels: DataFrame) -> DataFrame:
    """(cluster_id, meanUSD) as ``value.cluster_mean`` gives it, from stored sums."""
    per_hotel = sums.groupBy("hotel_id").agg(F.sum("usd").alias("usd"), F.sum("leads").alias("leads"))
    return (
        per_hotel.join(hotels.select("hotel_id", "cluster_id"), "hotel_id")
        .groupBy("cluster_id")
        .agg((F.sum("usd") / F.sum("leads")).alias("meanUSD"))
    )


def label_by_sums(leads: DataFrame, hotels: DataFrame, sums: DataFrame) -> DataFrame:
    """``value.value_label`` for some leads, with the means of all stored days."""
    priced = hotels.join(mean_of_sums(sums, hotels), "cluster_id")
    return (
        leads.join(priced, "hotel_id")
        .withColumn("gooddeal", gooddeal(F.col("meanUSD"), F.col("effUSD")))
        .select(stay_id(LEAD), "hotel_id", "cluster_id", *matrix_features(LEAD), "meanUSD", "gooddeal")
    )
