"""Registered queries on searches, leads, hotels and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.operators import cleaning, hotels, stays
from staylens.plans import oracle_parts as parts
from staylens.plans.registry import query
from staylens.schemas import HOTEL
from staylens.session import fresh_path
from staylens.sources import files, standins

ROUGH_HOTELS = f"""WITH {parts.HOTEL_RAW}
SELECT * EXCLUDE (cheapest_check_in),
       strftime(cheapest_check_in, '%Y-%m-%d') AS cheapest_check_in
FROM hotel_raw"""


def _iso(df, *columns):
    """Dates as text, so that both engines show them alike."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in columns})


@query("csv_typed_scan", ROUGH_HOTELS)
def csv_typed_scan(spark, folder):
    """Hotels written as headed CSV and read back with their types."""
    path = fresh_path(spark, "hotel-csv")
    files.write_csv(standins.hotels(spark, folder), path)
    return _iso(files.read_headed_csv(spark, path, HOTEL), "cheapest_check_in")


@query(
    "timeline_features",
    f"""WITH {parts.stays("search")}
SELECT search_id, strftime(date, '%Y-%m-%d') AS search_date,
       strftime(check_in, '%Y-%m-%d') AS checkin_date,
       strftime(check_out, '%Y-%m-%d') AS checkout_date,
       search_month, checkin_month, bookdays, searchdays,
       CAST(week(check_in) AS INTEGER) AS checkin_week
FROM search_time""",
)
def timeline_features(spark, folder):
    timed = stays.timeline_features(standins.searches(spark, folder), "search", with_week=True)
    dates = ("search_date", "checkin_date", "checkout_date")
    return _iso(
        timed.select(
            "search_id", *dates, "search_month", "checkin_month", "bookdays", "searchdays",
            "checkin_week",
        ),
        *dates,
    )


@query(
    "room_guests",
    f"""WITH {parts.stays("search")}
SELECT search_id, tot_adults, tot_kids, kids_eq, tot_guests FROM search_priced""",
)
def room_guests(spark, folder):
    return stays.room_guests(standins.searches(spark, folder)).select(
        "search_id", "tot_adults", "tot_kids", "kids_eq", "tot_guests"
    )


@query(
    "effective_price",
    f"""WITH {parts.stays("search")}
SELECT search_id, coalesce(price, 0) AS "effUSD", price IS NOT NULL AS price_valid
FROM search_priced""",
)
def effective_price(spark, folder):
    timed = stays.timeline_features(standins.searches(spark, folder), "search")
    return stays.effective_price(stays.room_guests(timed)).select(
        "search_id", "effUSD", "price_valid"
    )


@query("search_features", f"WITH {parts.stays('search')} SELECT * FROM search")
def search_features(spark, folder):
    return stays.search_features(standins.searches(spark, folder))


@query("lead_features", f"WITH {parts.stays('lead')} SELECT * FROM lead")
def lead_features(spark, folder):
    return stays.lead_features(standins.leads(spark, folder))


@query("dedupe_rows", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def dedupe_rows(spark, folder):
    return cleaning.dedupe_rows(
        standins.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    )


@query(
    "fill_numeric_nulls",
    f"""WITH {parts.HOTEL_RAW}
SELECT hotel_id, place_id, themes, facilities, rating,
       coalesce(number_of_reviews, 0) AS number_of_reviews, property_type, cleanliness_rating,
       service_rating, coalesce(facilities_rating, 0) AS facilities_rating, location_rating,
       pricing_rating, rooms_rating, coalesce(dining_rating, 0) AS dining_rating, overall_rating,
       popularity, min_rate_usd, strftime(cheapest_check_in, '%Y-%m-%d') AS cheapest_check_in
FROM hotel_raw""",
)
def fill_numeric_nulls(spark, folder):
    filled = cleaning.fill_numeric(standins.hotels(spark, folder), keep=("hotel_id", "place_id"))
    return _iso(filled, "cheapest_check_in")


@query(
    "drop_incomplete",
    f"""SELECT * FROM ({ROUGH_HOTELS})
WHERE themes IS NOT NULL AND facilities IS NOT NULL AND number_of_reviews IS NOT NULL
  AND facilities_rating IS NOT NULL AND dining_rating IS NOT NULL
  AND cheapest_check_in IS NOT NULL""",
)
def drop_incomplete(spark, folder):
    return _iso(cleaning.drop_incomplete(standins.hotels(spark, folder)), "cheapest_check_in")


@query(
    "bulk_numeric_cast",
    f"""WITH {parts.HOTEL_RAW}
SELECT hotel_id, CAST(place_id AS DOUBLE) AS place_id, TRY_CAST(themes AS DOUBLE) AS themes,
       CAST(rating AS DOUBLE) AS rating, CAST(number_of_reviews AS DOUBLE) AS number_of_reviews,
       CAST(property_type AS DOUBLE) AS property_type, min_rate_usd
FROM hotel_raw""",
)
def bulk_numeric_cast(spark, folder):
    columns = ["hotel_id", "place_id", "themes", "rating", "number_of_reviews", "property_type",
               "min_rate_usd"]
    return cleaning.numeric_cast(
        standins.hotels(spark, folder).select(*columns), keep=("hotel_id",)
    )


@query(
    "token_counts",
    f"""WITH {parts.HOTEL_RAW},{parts.THEMES},{parts.FACILITIES}
SELECT hotel_id, tot_themes, tot_facilities FROM hotel_raw
LEFT JOIN theme USING (hotel_id) LEFT JOIN facility USING (hotel_id)""",
)
def token_counts(spark, folder):
    return hotels.token_counts(standins.hotels(spark, folder))


@query(
    "mean_rating",
    f"WITH {parts.HOTEL_RAW} SELECT hotel_id, {parts.MEAN_RATING} AS mean_rating FROM hotel_raw",
)
def mean_rating(spark, folder):
    return hotels.mean_rating(standins.hotels(spark, folder))


@query(
    "facility_theme_outer",
    f"""WITH {parts.HOTEL_RAW},{parts.THEMES},{parts.FACILITIES}
SELECT hotel_id, tot_facilities, tot_themes FROM facility FULL JOIN theme USING (hotel_id)""",
)
def facility_theme_outer(spark, folder):
    raw = standins.hotels(spark, folder)
    return hotels.outer_counts(hotels.facility_counts(raw), hotels.theme_counts(raw))


@query(
    "hotel_right_outer",
    f"""WITH {parts.HOTEL_RAW},{parts.THEMES},{parts.FACILITIES},
counts AS (SELECT * FROM facility FULL JOIN theme USING (hotel_id))
SELECT hotel_id, tot_facilities, tot_themes, place_id, rating, min_rate_usd
FROM counts RIGHT JOIN hotel_raw USING (hotel_id)""",
)
def hotel_right_outer(spark, folder):
    raw = standins.hotels(spark, folder)
    counts = hotels.outer_counts(hotels.facility_counts(raw), hotels.theme_counts(raw))
    return hotels.counts_onto_hotels(
        counts, raw.select("hotel_id", "place_id", "rating", "min_rate_usd")
    )


@query(
    "place_hotel_join",
    f"""WITH {parts.HOTEL_RAW},{parts.PLACE}
SELECT place_id, place_type_id, latitude, longitude, rank, hotel_id, rating, popularity
FROM place JOIN hotel_raw USING (place_id)""",
)
def place_hotel_join(spark, folder):
    return hotels.place_hotel_join(
        standins.places(spark, folder),
        standins.hotels(spark, folder).select("place_id", "hotel_id", "rating", "popularity"),
    )


@query("hotel_features", f"WITH {parts.HOTEL} SELECT * FROM hotel")
def hotel_features(spark, folder):
    return hotels.hotel_features(standins.hotels(spark, folder))


def support(spark, folder):
    return hotels.support_table(standins.places(spark, folder), standins.hotels(spark, folder))


@query("support_table", f"WITH {parts.SUPPORT} SELECT * FROM support")
def support_table(spark, folder):
    """The table as written to and read back from its sink."""
    path = fresh_path(spark, "support")
    files.write_table(support(spark, folder), path)
    return files.read_table(spark, path)
