"""Scenario jobs: food demand today and later, allocation and its summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostelry.functions.numeric import (
    DWELLING_FOOD_WEIGHT, DWELLING_OCCUPANCY, HOTEL_ROOM_OCCUPANCY, capacity_units, change_pct, ratio,
)
from hostelry.operators.allocation import agent_rank, allocate
from hostelry.operators.demand import spread
from hostelry.operators.quantiles import exact_quantiles
from hostelry.session import durable


def food_demand(hotels: DataFrame, dwellings: DataFrame, food: DataFrame, radius: float, flat_weight: float = DWELLING_FOOD_WEIGHT) -> DataFrame:
    """Guests near each food site now and later. Hotels bring ``w`` now and ``extra`` later;
    dwellings bring ``w`` now, weighed down because they cook, and nothing later."""
    none = F.lit(None).cast("double")
    sources = hotels.select("x", "y", F.col("w").alias("hotel"), none.alias("flat"), "extra").unionByName(
        dwellings.select("x", "y", none.alias("hotel"), F.col("w").alias("flat"), none.alias("extra")))
    got = spread(sources, food, radius, ["hotel", "flat", "extra"])
    out = got.select("sid", *[F.col(f"received_{n}").alias(n) for n in ("hotel", "flat", "extra")])
    out = out.withColumns({
        "now": F.col("hotel") + F.lit(flat_weight) * F.col("flat"), "later": F.col("hotel") + F.col("extra")})
    return durable(out.withColumn("change_pct", change_pct(F.col("now"), F.col("later"))))


@dataclass(frozen=True)
class Run:
    """One allocation: its name, the seed of the serving order, an optional distance preference."""

    name: str
    seed: int
    limit_m: float | None = None


def demand_and_capacity(
    dwellings: DataFrame, hotels: DataFrame, runs: Sequence[Run], *, occupancy: float = DWELLING_OCCUPANCY,
    hotel_occupancy: float = HOTEL_ROOM_OCCUPANCY,
) -> tuple[DataFrame, DataFrame]:
    """Agents and sites of the allocation, once per run so that all runs are one plan.

    Dwellings: ``id, x, y, band, bedrooms, places``; hotels: ``id, x, y, band, rooms``. Rooms are the
    unit; guests per room are counted afterwards.
    """
    each = F.explode(F.array(*[
        F.struct(F.lit(r.name).alias("run"), F.lit(r.seed).alias("seed"), F.lit(r.limit_m).cast("double").alias("limit_m"))
        for r in runs])).alias("__run")
    units = capacity_units(F.col("bedrooms"), F.col("places"))
    agents = dwellings.select("*", each).select(
        "__run.run", F.col("id").alias("agent"), "x", "y", "band",
        agent_rank(F.col("__run.seed"), F.col("id")).alias("rank"), "__run.limit_m",
        (units * occupancy).alias("qty"), (F.col("places") / units).alias("guests_per_room"))
    sites = hotels.filter(F.col("rooms").isNotNull() & F.col("band").isNotNull()).select("*", each).select(
        "__run.run", F.col("id").alias("sid"), F.col("x").alias("sx"), F.col("y").alias("sy"), "band",
        (F.col("rooms") * (1 - hotel_occupancy)).alias("cap"))
    return agents, sites


def placed(agents: DataFrame, sites: DataFrame) -> DataFrame:
    """Allocation with guests, kilometres and bands of both ends."""
    pairs = allocate(agents.drop("guests_per_room"), sites)
    ends = agents.select("run", "agent", "guests_per_room", F.col("band").alias("from_band"))
    goal = sites.select("run", "sid", F.col("band").alias("to_band"))
    return pairs.join(ends, ["run", "agent"]).join(goal, ["run", "sid"], "left").select(
        "run", "agent", "sid", "qty", (F.col("qty") * F.col("guests_per_room")).alias("guests"),
        (F.col("d") / 1000.0).alias("km"), "from_band", "to_band")


def summary(pairs: DataFrame, far_km: float = 2.0) -> DataFrame:
    """Per run: guests placed and not, shares by band change, weighted distances, sites used."""
    pairs = durable(pairs.select("run", "sid", "guests", "from_band", "to_band", "km"))  # read three times below
    inside = F.col("sid").isNotNull()
    g, jump = F.col("guests"), F.col("to_band") - F.col("from_band")

    def share(mask: Column) -> Column:
        return F.coalesce(F.sum(F.when(inside & mask, g)), F.lit(0.0)) * 100.0 / F.sum(F.when(inside, g))

    sums = pairs.groupBy("run").agg(
        F.sum(F.when(inside, g)).alias("placed"), F.coalesce(F.sum(F.when(~inside, g)), F.lit(0.0)).alias("unplaced"),
        share(jump == 0).alias("own_band_pct"), share(jump == 1).alias("one_up_pct"), share(jump >= 2).alias("two_up_pct"),
        share(jump < 0).alias("cheaper_pct"), share(F.col("km") > far_km).alias("far_pct"),
        (F.sum(F.when(inside, g * F.col("km"))) / F.sum(F.when(inside, g))).alias("mean_km"),
        F.max("km").alias("longest_km"), F.count_distinct("sid").alias("sites_used"))
    middle = exact_quantiles(pairs.filter(inside), ["run"], "km", {"median_km": 0.5, "p90_km": 0.9}, weight=g, rule="reach")
    return sums.join(middle, "run")


def band_matrix(pairs: DataFrame, bands: int = 4) -> DataFrame:
    """Guests by band of origin and destination, every cell present, as a long table."""
    inside = pairs.filter(F.col("sid").isNotNull())
    cells = [F.coalesce(F.sum(F.when((F.col("from_band") == i) & (F.col("to_band") == j), F.col("guests"))), F.lit(0.0)).alias(f"m{i}{j}")
             for i in range(bands) for j in range(bands)]
    lines = [F.struct(F.lit(i).alias("from_band"), F.lit(j).alias("to_band"), F.col(f"m{i}{j}").alias("guests"))
             for i in range(bands) for j in range(bands)]
    return inside.groupBy("run").agg(*cells).select("run", F.inline(F.array(*lines)))


def sensitivity(summaries: DataFrame, variant: Column) -> DataFrame:
    """Lowest and highest of the headline figures over the seeds of each variant."""
    return summaries.groupBy(variant.alias("variant")).agg(
        F.min("median_km").alias("median_km_min"), F.max("median_km").alias("median_km_max"),
        F.min("own_band_pct").alias("own_band_min"), F.max("own_band_pct").alias("own_band_max"))


def supply_and_demand(agents: DataFrame, sites: DataFrame) -> DataFrame:
    """Free rooms and rooms asked for, by run and band."""
    free = sites.groupBy("run", "band").agg(F.sum("cap").alias("free"))
    asked = agents.groupBy("run", "band").agg(F.sum("qty").alias("asked"))
    return free.join(asked, ["run", "band"], "full_outer").na.fill(0.0, ["free", "asked"])


def absorbed(pairs: DataFrame, sites: DataFrame) -> DataFrame:
    """Per site: rooms and guests received and from how many dwellings; zero where none."""
    got = pairs.filter(F.col("sid").isNotNull()).groupBy("run", "sid").agg(
        F.sum("qty").alias("rooms"), F.sum("guests").alias("guests"), F.count_distinct("agent").alias("dwellings"))
    return sites.select("run", "sid").join(got, ["run", "sid"], "left").na.fill(0, ["rooms", "guests", "dwellings"])


def area_balance(pairs: DataFrame, agent_area: DataFrame, site_area: DataFrame, today: DataFrame) -> DataFrame:
    """Per area: guests now, leaving, arriving, net and change. ``today`` has ``area, hotel, flat``."""
    inside = pairs.filter(F.col("sid").isNotNull())
    leave = inside.join(agent_area, "agent").groupBy("area").agg(F.sum("guests").alias("leaving"))
    arrive = inside.join(site_area, "sid").groupBy("area").agg(F.sum("guests").alias("arriving"))
    flows = reduce(lambda a, b: a.join(b, "area", "full_outer"), [today, leave, arrive]).na.fill(
        0.0, ["hotel", "flat", "leaving", "arriving"])
    now, later = F.col("hotel") + F.col("flat"), F.col("hotel") + F.col("arriving")
    return flows.select(
        "area", now.alias("now"), later.alias("later"), "leaving", "arriving",
        (F.col("arriving") - F.col("leaving")).alias("net"), ratio((later - now) * 100.0, now).alias("change_pct"))
