"""Prices on one axis: official category average, per place, bands, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostelry.functions.numeric import BANDS, PLACE_CUTS, ROOM_CUTS, price_band, ratio
from hostelry.functions.text import fold_lower, lookup
from hostelry.operators.quantiles import exact_quantiles

# Stars by registry category, and official category by stars.
STARS = {
    "gran luxe": 5.0, "5 estrelles": 5.0, "4 estrelles superior": 4.5, "4 estrelles": 4.0,
    "3 estrelles": 3.0, "2 estrelles": 2.0, "1 estrella": 1.0,
}
OFFICIAL = {
    "1 and 2 gold stars and silver stars": [1.0, 2.0], "3 gold stars": [3.0],
    "4 gold stars": [4.0, 4.5], "5 gold stars": [5.0],
}
LOWEST_OFFICIAL = "1 and 2 gold stars and silver stars"


def stars(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in STARS.items() for x in pair])
    return F.try_element_at(table, fold_lower(category))


def lodging_kind(category: Column, kind: Column) -> Column:
    uncategorised = (kind == "apartament_turistic") | (fold_lower(category) == "sense categoritzar")
    return F.when(stars(category).isNotNull(), "hotel_stars").when(uncategorised, "apartments").otherwise("no_stars")


def official_category(category: Column, kind: Column) -> Column:
    by_star = {str(s): name for name, values in OFFICIAL.items() for s in values}
    known = F.try_element_at(lookup(by_star), stars(category).cast("string"))
    return F.when(lodging_kind(category, kind) == "no_stars", LOWEST_OFFICIAL).otherwise(known)


def price_lodgings(lodgings: DataFrame, averages: DataFrame) -> DataFrame:
    """Official average of the category, its band, and the price per place through the category's
    median places per room, so that one category has one price. ``lodgings`` has ``category, kind,
    places, rooms``; ``averages`` has ``official, adr``."""
    rows = lodgings.withColumn("official", official_category(F.col("category"), F.col("kind")))
    per_room = exact_quantiles(
        rows.withColumn("__r", ratio(F.col("places").cast("double"), F.col("rooms"))).filter(F.col("official").isNotNull()),
        ["official"], "__r", {"places_per_room": 0.5})
    table = averages.join(per_room, "official", "full_outer").filter(F.col("official").isin(*OFFICIAL))
    out = rows.join(F.broadcast(table), "official", "left")  # as many rows as the fixed list has names
    return out.withColumns({
        "room_band": price_band(F.col("adr"), ROOM_CUTS),
        "place_price": F.round(ratio(F.col("adr"), F.col("places_per_room")), 2),
    }).withColumn("place_band", price_band(F.col("place_price"), PLACE_CUTS)).withColumn(
        "price_origin", F.when(F.col("adr").isNotNull(), "official_category"))


def annual_place_price(rows: DataFrame, price: str, factors: DataFrame, month: int, out: str = "annual_price") -> DataFrame:
    """Price per place over the mean seasonal factor of the month it was seen in."""
    factor = factors.filter(F.col("month") == month).select(F.avg("factor")).scalar()
    return rows.withColumn(out, F.round(F.col(price) / factor, 2))


def compare_populations(a: DataFrame, b: DataFrame, price: str, names: tuple[str, str]) -> DataFrame:
    """Share of each population by band, in percent, every band present."""
    def shares(rows, name):
        band = price_band(F.col(price))
        sums = rows.filter(F.col(price).isNotNull()).agg(
            F.count(F.lit(1)).alias("__n"), *[F.count(F.when(band == x, 1)).alias(f"__{i}") for i, x in enumerate(BANDS)])
        return sums.select(F.inline(F.array(*[
            F.struct(F.lit(x).alias("band"), F.round(F.col(f"__{i}") * 100.0 / F.col("__n"), 1).alias(name))
            for i, x in enumerate(BANDS)])))
    return shares(a, names[0]).join(shares(b, names[1]), "band")


def median_position(a: DataFrame, b: DataFrame, price: str) -> DataFrame:
    """Medians of both, and the share of ``b`` below the median of ``a``."""
    ma = exact_quantiles(a, [], price, {"m": 0.5}).scalar()
    mb = exact_quantiles(b, [], price, {"m": 0.5}).scalar()
    known = b.filter(F.col(price).isNotNull())
    return known.agg(F.avg((F.col(price) < ma).cast("double")).alias("below")).select(
        ma.alias("median_a"), mb.alias("median_b"), "below")
