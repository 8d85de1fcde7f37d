"""Typed schemas of the input tables. Files are read as text and cast by these."""

from __future__ import annotations

from pyspark.sql import types as T


TYPES = {
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(),
    "DATE": T.DateType(),
}


def _struct(spec: str) -> T.StructType:
    """A schema from ``name TYPE, ...``; needs no session, so it can be built on import."""
    fields = (field.split() for field in spec.split(","))
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in fields])


STAY_COLUMNS = """
    hotel_id BIGINT, date DATE, check_in DATE, check_out DATE,
    room_description STRING, total_usd DOUBLE, nb_rooms INT
"""

SEARCH = _struct("search_id STRING, usersearch_id STRING, " + STAY_COLUMNS)
LEAD = _struct("lead_id STRING, " + STAY_COLUMNS)

PLACE = _struct(
    "place_id BIGINT, place_type_id INT, latitude DOUBLE, longitude DOUBLE, rank DOUBLE"
)

HOTEL = _struct(
    """
    hotel_id BIGINT, place_id BIGINT, themes STRING, facilities STRING, rating INT,
    number_of_reviews INT, property_type INT,
    cleanliness_rating DOUBLE, service_rating DOUBLE, facilities_rating DOUBLE,
    location_rating DOUBLE, pricing_rating DOUBLE, rooms_rating DOUBLE,
    dining_rating DOUBLE, overall_rating DOUBLE,
    popularity DOUBLE, min_rate_usd DOUBLE, cheapest_check_in DATE
    """
)

SUPPORT = _struct(
    """
    hotel_id BIGINT, effrat DOUBLE, rating INT, popularity DOUBLE, property_type INT,
    place_type_id INT, rank DOUBLE, tot_facilities BIGINT, tot_themes BIGINT
    """
)

# Headerless files: the order of the fields is the order of the columns.
RATINGS = _struct("item INT, user INT, rating DOUBLE")
ITEM_CONTENT = _struct(
    "item INT, director STRING, actor2 STRING, actor3 STRING, actor1 STRING"
)
