"""Area facts, dashboards and pages built from lodgings, dwellings and food sites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostelry.functions.numeric import (
    BANDS, DWELLING_OCCUPANCY, DWELLING_OCCUPANCY_HIGH, DWELLING_STAY_NIGHTS, HOTEL_PLACE_OCCUPANCY,
    HOTEL_ROOM_OCCUPANCY, change_pct, price_band, ratio,
)
from hostelry.operators.aggregates import mode
from hostelry.operators.projection import publishable
from hostelry.operators.quantiles import exact_quantiles


def area_facts(dwellings: DataFrame, hotels: DataFrame, food: DataFrame, *, hotel_operator_min: int = 2, host_min: int = 5, brand_min: int = 2) -> DataFrame:
    """One row per area seen in any table, zero where a table has nothing there.

    Dwellings: ``area, places, place_price, price, nights, host_name``; hotels: ``area, places, rooms,
    band, owner``; food: ``area, brand, now, later, high``. Aggregates by area, joined to the union of their areas.
    """
    low, high = DWELLING_OCCUPANCY, DWELLING_OCCUPANCY_HIGH
    d = dwellings.groupBy("area").agg(
        F.count(F.lit(1)).alias("dwellings"), F.sum("places").alias("dwelling_places"),
        F.avg("place_price").alias("place_price"),
        F.sum(F.coalesce(F.col("price") * F.col("nights"), F.lit(0.0))).alias("revenue_low"),
        (F.sum(F.coalesce("price", F.lit(0.0))) * 365 * high).alias("revenue_high"))
    middle = exact_quantiles(dwellings, ["area"], "price", {"median_price": 0.5})
    per_place = exact_quantiles(dwellings, ["area"], "place_price", {"__mp": 0.5}).select(
        "area", price_band(F.round("__mp", 1)).alias("dwelling_band"))
    h = hotels.groupBy("area").agg(
        F.count(F.lit(1)).alias("hotels"), F.sum(F.coalesce("places", F.lit(0))).alias("hotel_places"),
        F.sum(F.coalesce("rooms", F.lit(0))).alias("hotel_rooms"))
    f = food.groupBy("area").agg(
        F.count(F.lit(1)).alias("food_sites"), F.sum(F.col("high").cast("long")).alias("high"),
        F.sum("now").alias("demand_now"), F.sum("later").alias("demand_later"))
    parts = [
        d, middle, per_place, h, f,
        mode(hotels, ["area"], "band", out="hotel_band", n="__hb").drop("__hb"),
        mode(food, ["area"], "brand", brand_min, out="main_brand", n="brand_sites"),
        mode(hotels, ["area"], "owner", hotel_operator_min, out="hotel_operator", n="hotel_operator_n"),
        mode(dwellings, ["area"], "host_name", host_min, out="host", n="host_n"),
    ]
    domain = reduce(DataFrame.unionByName, [p.select("area") for p in (d, h, f)]).filter(F.col("area").isNotNull()).distinct()
    out = reduce(lambda a, b: a.join(b, "area", "left"), parts, domain)
    out = out.na.fill(0, ["dwellings", "dwelling_places", "revenue_low", "revenue_high", "hotels", "hotel_places",
                          "hotel_rooms", "food_sites", "high", "demand_now", "demand_later"])
    return out.withColumns({
        "dwelling_guests_low": F.col("dwelling_places") * low, "dwelling_guests_high": F.col("dwelling_places") * high,
        "hotel_guests": F.col("hotel_places") * HOTEL_PLACE_OCCUPANCY})


def dashboard(dwellings: DataFrame, hotels: DataFrame, new_guests: float, absorbed_rooms: float) -> DataFrame:
    """Headline figures as one row: totals, bands including missing, occupancy before and after."""
    d = dwellings.agg(
        F.count(F.lit(1)).alias("dwellings"), F.sum("places").alias("dwelling_places"),
        *[F.count(F.when(price_band(F.col("place_price")) == b, 1)).alias(f"dwellings_band_{i}") for i, b in enumerate(BANDS)],
        F.count(F.when(F.col("place_price").isNull(), 1)).alias("dwellings_no_band"),
        F.sum(F.coalesce(F.col("price") * F.col("nights"), F.lit(0.0))).alias("revenue_low"),
        (F.sum(F.coalesce("price", F.lit(0.0))) * 365 * DWELLING_OCCUPANCY_HIGH).alias("revenue_high"))
    h = hotels.agg(
        F.count(F.lit(1)).alias("hotels"), F.sum("rooms").alias("hotel_rooms"), F.sum("places").alias("hotel_places"),
        *[F.count(F.when(F.col("band") == i, 1)).alias(f"hotels_band_{i}") for i in range(len(BANDS))],
        F.count(F.when(F.col("band").isNull(), 1)).alias("hotels_no_band"))
    guests = F.col("hotel_places") * HOTEL_PLACE_OCCUPANCY
    both = d.withColumn("__one", F.lit(1)).join(h.withColumn("__one", F.lit(1)), "__one").drop("__one")
    return both.withColumns({
        "hotel_guests_now": guests, "new_guests": F.lit(new_guests), "new_guests_pct": F.lit(new_guests) * 100.0 / guests,
        "occupancy_now": F.lit(HOTEL_ROOM_OCCUPANCY * 100),
        "occupancy_later": (F.col("hotel_rooms") * HOTEL_ROOM_OCCUPANCY + F.lit(absorbed_rooms)) * 100.0 / F.col("hotel_rooms")})


def leading_owners(hotels: DataFrame, k: int = 5) -> DataFrame:
    sums = hotels.filter(F.col("owner").isNotNull()).groupBy("owner").agg(
        F.count(F.lit(1)).alias("n"), F.sum("places").alias("places"))
    return sums.orderBy(F.col("n").desc(), F.col("places").desc(), "owner").limit(k)


def leading_hosts(dwellings: DataFrame, minimum: int = 20, k: int = 5) -> DataFrame:
    """By identifier, named only from the minimum up."""
    return publishable(dwellings, "host_id", "host_name", "places", minimum, k)


def occupancy_by_band(hotels: DataFrame, absorbed: DataFrame) -> DataFrame:
    """Rooms in use by band, now and with what each site received, every band present."""
    rows = hotels.join(absorbed.select(F.col("sid").alias("id"), F.col("rooms").alias("__got")), "id", "left")
    rooms = [F.coalesce(F.sum(F.when(F.col("band") == i, F.col("rooms"))), F.lit(0)) for i in range(len(BANDS))]
    got = [F.coalesce(F.sum(F.when(F.col("band") == i, F.col("__got"))), F.lit(0.0)) for i in range(len(BANDS))]
    sums = rows.agg(*[r.alias(f"r{i}") for i, r in enumerate(rooms)], *[g.alias(f"g{i}") for i, g in enumerate(got)])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("band"), F.col(f"r{i}").alias("rooms"), (F.col(f"r{i}") * HOTEL_ROOM_OCCUPANCY).alias("now"),
                 (F.col(f"r{i}") * HOTEL_ROOM_OCCUPANCY + F.col(f"g{i}")).alias("later")) for i in range(len(BANDS))])))


def sites_by_category(hotels: DataFrame, missing: str = "Sin categoria") -> DataFrame:
    return hotels.groupBy(F.coalesce("category", F.lit(missing)).alias("category")).agg(
        F.count(F.lit(1)).alias("hotels"), F.sum("rooms").alias("rooms")).orderBy(F.col("rooms").desc(), "category")


def area_growth(hotels: DataFrame, extra: DataFrame) -> DataFrame:
    """Guests now and new ones by area. ``extra`` has ``sid, guests``."""
    rows = hotels.join(extra.select(F.col("sid").alias("id"), "guests"), "id", "left")
    sums = rows.groupBy("area").agg(
        F.count(F.lit(1)).alias("hotels"), F.sum("rooms").alias("rooms"),
        (F.sum("places") * HOTEL_PLACE_OCCUPANCY).alias("now"), F.coalesce(F.sum("guests"), F.lit(0.0)).alias("new"))
    return sums.withColumn("more_pct", ratio(F.col("new") * 100.0, F.col("now")))


def brand_table(food: DataFrame, k: int = 10) -> DataFrame:
    sums = food.filter(F.col("brand").isNotNull()).groupBy("brand").agg(
        F.count(F.lit(1)).alias("sites"), F.sum("now").alias("now"), F.sum("later").alias("later"))
    return sums.withColumn("change_pct", change_pct(F.col("now"), F.col("later"))).orderBy(F.col("sites").desc(), "brand").limit(k)


def biggest_gains(food: DataFrame, key: str, k: int = 5, losing: bool = False) -> DataFrame:
    gain = F.col("later") - F.col("now")
    return food.withColumn("gain", gain).orderBy(F.col("gain").asc() if losing else F.col("gain").desc(), key).limit(k)


def food_totals(food: DataFrame) -> DataFrame:
    return food.agg(
        F.count(F.lit(1)).alias("sites"), F.count(F.when(F.col("now") > 0, 1)).alias("with_guests"),
        F.sum("now").alias("now"), F.sum("later").alias("later"),
        F.count(F.when(F.col("later") > F.col("now"), 1)).alias("gain"), F.count(F.when(F.col("later") < F.col("now"), 1)).alias("lose"))


def against_official(dwellings: DataFrame, hotels: DataFrame, official: DataFrame) -> DataFrame:
    """Own nightly and yearly totals beside the official ones, converted by the official mean stay.
    ``official`` is one row with ``mean_stay, nights_per_day``."""
    one = F.lit(1).alias("__one")
    h = hotels.agg((F.sum("places") * HOTEL_PLACE_OCCUPANCY).alias("hotel_night")).select("*", one)
    d = dwellings.agg((F.sum("places") * DWELLING_OCCUPANCY).alias("flat_night"), (F.sum("places") * DWELLING_OCCUPANCY_HIGH).alias("flat_night_high")).select("*", one)
    both = h.join(d, "__one").join(official.select("mean_stay", "nights_per_day", one), "__one").drop("__one")
    return both.select(
        "hotel_night", (F.col("hotel_night") * 365).alias("hotel_nights_year"), "flat_night", "flat_night_high",
        (F.col("flat_night") * 365).alias("flat_nights_year"),
        (F.col("flat_night") * 365 / DWELLING_STAY_NIGHTS).alias("flat_guests_year"),
        (F.col("hotel_night") * 365 / F.col("mean_stay")).alias("hotel_guests_equivalent"),
        ((F.col("hotel_night") / F.col("nights_per_day") - 1) * 100).alias("gap_pct"))
