"""Column expressions over numbers, prices and dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Price cuts in EUR and band labels from cheapest to dearest.
ROOM_CUTS = [100, 175, 300]
PLACE_CUTS = [40, 70, 120]
BANDS = ["€", "€€", "€€€", "€€€€"]
# Assumed occupancies and rates; each is a parameter of the operators that use it.
DWELLING_OCCUPANCY = 0.383
DWELLING_OCCUPANCY_HIGH = 0.48
HOTEL_ROOM_OCCUPANCY = 0.802
HOTEL_PLACE_OCCUPANCY = 0.679
PLACES_PER_BEDROOM = 2.0
DWELLING_FOOD_WEIGHT = 0.5
DWELLING_STAY_NIGHTS = 3
MONTHS = {"Jan": 1, "Feb": 2, "Mar": 3, "Apr": 4, "May": 5, "Jun": 6,
          "Jul": 7, "Aug": 8, "Sep": 9, "Oct": 10, "Nov": 11, "Dec": 12}


def to_number(text: Column) -> Column:
    """Number, or null for anything else; NaN is null too."""
    n = text.cast("string").try_cast("double")
    return F.when(~F.isnan(n), n)


def money(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, r"[^0-9.]", ""), F.lit("")).try_cast("double")


def locale_number(text: Column) -> Column:
    return F.regexp_replace(text, ",", ".").try_cast("double")


def clip(value: Column, low=None, high=None) -> Column:
    """Keeps null null: greatest and least skip nulls."""
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(value.isNotNull(), out)


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom)


def change_pct(now: Column, later: Column) -> Column:
    return ratio((later - now) * 100.0, now)


def capacity_units(bedrooms: Column, places: Column, per_room: float = PLACES_PER_BEDROOM) -> Column:
    """Bedrooms, or half the places rounded half to even; never below one."""
    rooms = F.coalesce(F.when(bedrooms > 0, bedrooms.cast("double")), F.bround(places / F.lit(per_room), 0))
    return clip(rooms, low=1.0)


def inside_box(lat: Column, lon: Column, box: Sequence[float]) -> Column:
    south, north, west, east = box
    return lat.between(south, north) & lon.between(west, east)


def left_closed(value: Column, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """``cut[i] <= x < cut[i+1]``; null stays null."""
    chosen = F.when(value.isNull() | F.isnan(value), F.lit(None).cast("string"))
    for cut, label in zip(cuts, labels):
        chosen = chosen.when(value < cut, F.lit(label))
    return chosen.otherwise(F.lit(labels[len(cuts)]))


def right_closed(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """``edge[i] < x <= edge[i+1]``; outside the edges and null give null."""
    chosen = F.when(value <= edges[0], F.lit(None).cast("string"))
    for edge, label in zip(edges[1:], labels):
        chosen = chosen.when(value <= edge, F.lit(label))
    return chosen


def price_band(price: Column, cuts: Sequence[float] = tuple(PLACE_CUTS)) -> Column:
    return left_closed(price.cast("double"), cuts, BANDS)


def band_rank(band: Column) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(b) for b in BANDS]), band), F.lit(0)) - 1


def occupied_nights(availability: Column) -> Column:
    return clip(F.lit(365) - availability, 0, 365)


def to_date(text: Column, pattern: str | None = None) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern) if pattern else None).cast("date")


def month_label_date(text: Column) -> Column:
    """``Jan 2013`` → the first day of that month; anything else is null."""
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    month = F.try_element_at(months, F.regexp_extract(text, r"([A-Za-z]{3})\s*(\d{4})", 1))
    year = F.regexp_extract(text, r"([A-Za-z]{3})\s*(\d{4})", 2).try_cast("int")
    return F.when(month.isNotNull() & year.isNotNull(), F.make_date(year, month, F.lit(1)))


def utc_month(text: Column) -> Column:
    return F.date_format(F.try_to_timestamp(text), "yyyy-MM")


def case_year(text: Column) -> Column:
    return F.regexp_extract(text, r"-(\d{4})-", 1).try_cast("int")
