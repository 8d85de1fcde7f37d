"""Features of hotels and the support table that scoring joins to.

Counts and ratings are row expressions, so hotel features need one pass and one shuffle (to
make sure of one row per hotel). The outer joins stay available for counts that come from
tables of their own.

No join here carries a broadcast hint: Spark broadcasts a side whose size it knows to be small
(from file sizes, or from the written shuffle at run time) and otherwise sorts and merges, where
the run-time skew split divides a hot place or hotel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions import stay, text
from staylens.functions.numbers import total
from staylens.operators.cleaning import one_row_per

# The sub-ratings that make up the mean (the pricing one is left out).
MEAN_OF = [
    "cleanliness_rating",
    "service_rating",
    "facilities_rating",
    "location_rating",
    "rooms_rating",
    "dining_rating",
    "overall_rating",
]

# What scoring needs to know about a hotel.
SUPPORT_COLUMNS = [
    "hotel_id",
    "effrat",
    "rating",
    "popularity",
    "property_type",
    "place_type_id",
    "rank",
    "tot_facilities",
    "tot_themes",
]

HOTEL_COLUMNS = [
    "hotel_id",
    "place_id",
    "rating",
    "number_of_reviews",
    "popularity",
    "property_type",
    "min_rate_usd",
]


def theme_counts(hotels: DataFrame, any_token: bool = False) -> DataFrame:
    """``tot_themes`` of each hotel that has a theme list."""
    count = text.positive_tokens(F.col("themes"), any_token=any_token)
    return hotels.filter(F.col("themes").isNotNull()).select("hotel_id", count.alias("tot_themes"))


def facility_counts(hotels: DataFrame, any_token: bool = False) -> DataFrame:
    """``tot_facilities`` of each hotel that has a facility list."""
    count = text.positive_tokens(F.col("facilities"), any_token=any_token)
    return hotels.filter(F.col("facilities").isNotNull()).select(
        "hotel_id", count.alias("tot_facilities")
    )


def token_counts(hotels: DataFrame, any_token: bool = False) -> DataFrame:
    """Both counts of every hotel in one pass; null where the list is missing."""
    return hotels.select(
        "hotel_id",
        text.positive_tokens(F.col("themes"), any_token=any_token).alias("tot_themes"),
        text.positive_tokens(F.col("facilities"), any_token=any_token).alias("tot_facilities"),
    )


def outer_counts(facilities: DataFrame, themes: DataFrame) -> DataFrame:
    """Two count tables side by side; a hotel in either is kept."""
    return facilities.join(themes, "hotel_id", "full_outer").dropDuplicates()


def counts_onto_hotels(counts: DataFrame, hotels: DataFrame) -> DataFrame:
    """Every hotel with its counts, null where it has none."""
    return counts.join(hotels, "hotel_id", "right_outer").dropDuplicates()


def mean_rating_of() -> Column:
    """Sum of the seven sub-ratings over seven; a missing one counts as 0."""
    return total([F.coalesce(F.col(c), F.lit(0.0)) for c in MEAN_OF]) / F.lit(7.0)


def mean_rating(hotels: DataFrame) -> DataFrame:
    return hotels.select("hotel_id", mean_rating_of().alias("mean_rating"))


def hotel_features(
    hotels: DataFrame, any_token: bool = False, with_week: bool = False
) -> DataFrame:
    """Counts, mean rating, cheapest month and ``effrat`` (mean rating times reviews)."""
    cheapest = stay.as_day(F.col("cheapest_check_in"))
    used = ["themes", "facilities", "cheapest_check_in", *MEAN_OF, *HOTEL_COLUMNS[1:]]
    columns = [
        *HOTEL_COLUMNS,
        F.month(cheapest).alias("cheapest_month"),
        *([F.weekofyear(cheapest).alias("cheapest_week")] if with_week else []),
        mean_rating_of().alias("mean_rating"),
        text.positive_tokens(F.col("themes"), any_token=any_token).alias("tot_themes"),
        text.positive_tokens(F.col("facilities"), any_token=any_token).alias("tot_facilities"),
        (mean_rating_of() * F.col("number_of_reviews")).alias("effrat"),
    ]
    return one_row_per(hotels.select("hotel_id", *used), "hotel_id").select(*columns)


def place_hotel_join(places: DataFrame, hotels: DataFrame) -> DataFrame:
    return places.join(hotels, "place_id", "inner")


def support_table(places: DataFrame, hotels: DataFrame) -> DataFrame:
    """Places joined to hotel features: the table kept for scoring and clustering."""
    used = places.select("place_id", "place_type_id", "latitude", "longitude", "rank")
    return place_hotel_join(used, hotel_features(hotels))
