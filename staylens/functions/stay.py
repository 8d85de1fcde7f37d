"""Stay expressions: dates, guests in a room description, price per guest night."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from staylens.functions.numbers import as_number


def as_day(column: Column) -> Column:
    """Text or timestamp to date; text that is no date gives null."""
    return column.try_cast("date")


def days_from(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def guest_totals(description: Column, blank_kids_is_zero: bool = False) -> Column:
    """Struct (adults, kids) for text such as ``2:4,6|1``: rooms by ``|``, ages after ``:``.

    Adults that are no number are skipped, and are null when no room has one. ``3:`` counts
    one kid, as its age list splits into one blank entry; the flag counts it as none.
    """

    def kids_in(room: Column) -> Column:
        ages = F.split(F.get(F.split(room, ":"), F.lit(1)), ",")
        if blank_kids_is_zero:
            ages = F.filter(ages, lambda age: F.trim(age) != "")
        return F.greatest(F.coalesce(F.size(ages), F.lit(0)), F.lit(0)).cast("long")

    def add_room(totals: Column, room: Column) -> Column:
        adults = as_number(F.substring_index(room, ":", 1))
        return F.struct(
            F.when(adults.isNull(), totals["adults"])
            .otherwise(F.coalesce(totals["adults"], F.lit(0.0)) + adults)
            .alias("adults"),
            (totals["kids"] + kids_in(room)).alias("kids"),
        )

    start = F.struct(
        F.lit(None).cast("double").alias("adults"), F.lit(0).cast("long").alias("kids")
    )
    return F.aggregate(F.split(description, r"\|"), start, add_room)


def price_per_guest_night(total: Column, nights: Column, rooms: Column, guests: Column) -> Column:
    """Null when a divisor is zero or missing; the caller decides what null means."""
    return F.try_divide(F.try_divide(F.try_divide(total, nights), rooms), guests)
