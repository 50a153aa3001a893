"""Preparation of establishments and of food sites, as compositions of the operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostelry.functions import geo, text
from hostelry.operators import dedup
from hostelry.operators.linkage import require_unique
from hostelry.operators.projection import select_by_category
from hostelry.operators.spatial import keep_newest_apart, on_plane
from hostelry.plans.pricing import lodging_kind, price_lodgings, stars


def establishments(rows: DataFrame, averages: DataFrame, centre: tuple[float, float]) -> DataFrame:
    """Stars, kind, subtype, chain, distance to the centre, official price, probable duplicates.
    ``rows`` has ``id, name, owner, category, kind, lat, lon, places, rooms, road_name, number``."""
    names = text.both_names(F.col("name"), F.col("owner"))
    key = F.concat_ws("|", text.name_key(F.col("name")), text.name_key(F.col("road_name")), F.col("number").cast("string"))
    out = rows.withColumns({
        "stars": stars(F.col("category")), "lodging": lodging_kind(F.col("category"), F.col("kind")),
        "subtype": text.first_label(names, text.SUBTYPES, "sin_indicio"),
        "chain": text.first_label(names, text.CHAINS, "Independiente"),
        "centre_km": F.round(geo.haversine_km(F.lit(centre[0]), F.lit(centre[1]), F.col("lat"), F.col("lon")), 3),
        "__key": key,
    }).withColumn("in_chain", F.col("chain") != "Independiente")
    out = dedup.flag_repeats(out, ["__key"], "probable_duplicate").drop("__key")
    return price_lodgings(out, averages)


def food_sites(rows: DataFrame, activity: str, wanted: Mapping[str, str], radius: float = 10.0) -> DataFrame:
    """Select by activity, normalise, keep the latest visit, merge corners, require unique ids.
    ``rows`` has ``id, name, address, visited, lat, lon`` and the activity."""
    chosen = select_by_category(rows, activity, wanted, "site_type")
    tidy = chosen.withColumns({
        "id": text.identifier(F.col("id").cast("string")), "name": text.without_sentinel(F.col("name")),
        "identified": ~F.col("address").endswith("LOC NA")})
    latest = dedup.latest_visit(tidy, ["name", "address", "site_type"], "visited", "identified", "id")
    placed = on_plane(latest, plane=geo.FLAT).withColumn("__n", text.fold_lower(F.col("name")))
    placed = placed.withColumn("__n", F.when(F.col("name").isNotNull(), F.col("__n")))
    merged = keep_newest_apart(placed, "__n", "id", [F.col("visited")], radius).drop("__n", "x", "y")
    require_unique(merged, "id", "food sites")
    return merged
