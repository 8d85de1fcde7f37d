"""Good-value labels and the matrices that train and score them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.operators.cleaning import fill_numeric
from staylens.operators.hotels import SUPPORT_COLUMNS
from staylens.operators.stays import LEAD, SEARCH, feature_columns, stay_id

HOTEL_SIDE = [c for c in SUPPORT_COLUMNS if c != "hotel_id"]


def matrix_features(kind: str) -> list[str]:
    """The twelve model inputs in their fixed order."""
    return [c for c in feature_columns(kind) if not c.endswith("_id")] + HOTEL_SIDE


def search_support_join(searches: DataFrame, support: DataFrame) -> DataFrame:
    """Search features with what is known about their hotel.

    One equi-join. A support table found small may be passed with a broadcast hint (see
    ``joins``), and Spark broadcasts one it knows to be small by itself; otherwise searches
    shuffle by hotel and the run-time skew split divides a hot hotel. Nothing after it needs the
    rows grouped by hotel, so that split is always free to act.
    """
    return searches.join(support, "hotel_id", "inner").select(*searches.columns, *HOTEL_SIDE)


def score_matrix(
    searches: DataFrame, support: DataFrame, ids: Sequence[str] = ()
) -> DataFrame:
    """The model inputs of each search, with its ids and the further ``ids`` it carries."""
    joined = search_support_join(searches, support)
    kept = (*ids, "search_id", "hotel_id")
    return fill_numeric(joined.select(*kept, *matrix_features(SEARCH)), keep=kept)


def clustered_hotels(support: DataFrame, clusters: DataFrame) -> DataFrame:
    """Hotel features with their cluster, joined by id."""
    return support.select(*SUPPORT_COLUMNS).join(
        clusters.select("hotel_id", "cluster_id"), "hotel_id"
    )


def cluster_leads_join(leads: DataFrame, hotels: DataFrame) -> DataFrame:
    """Leads with the features and cluster of their hotel."""
    return leads.join(hotels, "hotel_id", "inner").select(
        stay_id(LEAD), "hotel_id", "cluster_id", *matrix_features(LEAD)
    )


def cluster_mean(leads: DataFrame, hotels: DataFrame) -> DataFrame:
    """Mean ``effUSD`` of each cluster.

    Leads are summed per hotel first, so only one row per hotel meets the join and the
    clusters; how many leads a hotel or a cluster has no longer matters.
    """
    per_hotel = leads.groupBy("hotel_id").agg(
        F.sum("effUSD").alias("usd"), F.count("effUSD").alias("leads")
    )
    return (
        per_hotel.join(hotels.select("hotel_id", "cluster_id"), "hotel_id")
        .groupBy("cluster_id")
        .agg((F.sum("usd") / F.sum("leads")).alias("meanUSD"))
    )


def gooddeal(mean: Column, price: Column) -> Column:
    """1 when the price is at or below the mean of its cluster."""
    return F.when(mean >= price, 1).otherwise(0)


def value_label(leads: DataFrame, hotels: DataFrame, hotels_fit: bool = False) -> DataFrame:
    """Each lead with its cluster's mean price and the label ``gooddeal``.

    The mean travels on the hotel row. Leads are joined once, by hotel, and never grouped by
    cluster: a cluster holding a third of all leads is no larger a group than any other.
    ``hotels_fit`` says that the hotels were found small enough to broadcast, which saves the
    shuffle of leads.
    """
    priced = hotels.join(cluster_mean(leads, hotels), "cluster_id")
    if hotels_fit:
        priced = F.broadcast(priced)
    return (
        leads.join(priced, "hotel_id")
        .withColumn("gooddeal", gooddeal(F.col("meanUSD"), F.col("effUSD")))
        .select(
            stay_id(LEAD), "hotel_id", "cluster_id", *matrix_features(LEAD), "meanUSD", "gooddeal"
        )
    )


def train_matrix(labelled: DataFrame) -> DataFrame:
    """The twelve inputs and the label, nulls 0, ids kept."""
    narrow = labelled.select(stay_id(LEAD), "hotel_id", *matrix_features(LEAD), "gooddeal")
    return fill_numeric(narrow, keep=(stay_id(LEAD), "hotel_id"))
