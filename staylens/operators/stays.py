"""Features of searches and leads.

One function serves both: a search is a stay someone looked at, a lead is one someone asked to
book. They differ in the name of the id and in the prefix of the request columns.

Every derived column comes from the same row, so all of them are one projection over the scan;
only the final removal of copies moves rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions import stay
from staylens.operators.cleaning import fill_numeric

SEARCH = "search"
LEAD = "lead"


def stay_id(kind: str) -> str:
    return f"{kind}_id"


def feature_columns(kind: str) -> list[str]:
    return [stay_id(kind), "hotel_id", "checkin_month", f"{kind}_month", f"{kind}days", "effUSD"]


def timeline_features(df: DataFrame, kind: str, with_week: bool = False) -> DataFrame:
    """Add the three dates, two months, nights (``bookdays``) and days of notice."""
    made, arrive, leave = (stay.as_day(F.col(c)) for c in ("date", "check_in", "check_out"))
    added = {
        f"{kind}_date": made,
        "checkin_date": arrive,
        "checkout_date": leave,
        f"{kind}_month": F.month(made),
        "checkin_month": F.month(arrive),
        "bookdays": stay.days_from(arrive, leave),
        f"{kind}days": stay.days_from(made, arrive),
    }
    if with_week:
        added["checkin_week"] = F.weekofyear(arrive)
    return df.withColumns(added)


def room_guests(df: DataFrame, blank_kids_is_zero: bool = False) -> DataFrame:
    """Add adults, kids, kids as half guests, and guests. Rows without a description go."""
    totals = stay.guest_totals(F.col("room_description"), blank_kids_is_zero)
    return (
        df.filter(F.col("room_description").isNotNull())
        .withColumn("guests", totals)
        .withColumns(
            {
                "tot_adults": F.col("guests.adults"),
                "tot_kids": F.col("guests.kids"),
                "kids_eq": F.col("guests.kids") / F.lit(2.0),
                "tot_guests": F.col("guests.kids") / F.lit(2.0) + F.col("guests.adults"),
            }
        )
        .drop("guests")
    )


def effective_price(df: DataFrame) -> DataFrame:
    """Add ``effUSD``, the price per night, room and guest, 0 where it cannot be computed.

    ``price_valid`` tells such a 0 from a real price.
    """
    price = stay.price_per_guest_night(
        F.col("total_usd"), F.col("bookdays"), F.col("nb_rooms"), F.col("tot_guests")
    )
    return (
        df.withColumn("price", price)
        .withColumns(
            {
                "effUSD": F.coalesce(F.col("price"), F.lit(0.0)),
                "price_valid": F.col("price").isNotNull(),
            }
        )
        .drop("price")
    )


def stay_features(
    df: DataFrame,
    kind: str,
    dedupe: bool = True,
    blank_kids_is_zero: bool = False,
    ids: Sequence[str] = (),
) -> DataFrame:
    """The feature row of each stay. ``dedupe=False`` saves the shuffle when ids are unique.

    ``ids`` are further id columns to carry, such as ``usersearch_id``, which groups the offers
    of one user's search.
    """
    full = effective_price(timeline_features(room_guests(df, blank_kids_is_zero), kind))
    narrow = fill_numeric(
        full.select(*ids, *feature_columns(kind)), keep=(*ids, stay_id(kind), "hotel_id")
    )
    return narrow.dropDuplicates() if dedupe else narrow


def search_features(df: DataFrame, **options) -> DataFrame:
    return stay_features(df, SEARCH, **options)


def lead_features(df: DataFrame, **options) -> DataFrame:
    return stay_features(df, LEAD, **options)
