"""Distances and grid cells as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius, plane scale, reference latitude.
EARTH_KM = 6371.0
REFERENCE_LATITUDE = 41.39


@dataclass(frozen=True)
class Plane:
    """Local plane in metres: good over a city, where a degree has one length."""

    lat_m: float = 110_570.0
    lon_m: float = 111_320.0
    latitude: float = REFERENCE_LATITUDE

    def x(self, lon: Column) -> Column:
        return lon * F.lit(self.lon_m * math.cos(math.radians(self.latitude)))

    def y(self, lat: Column) -> Column:
        return lat * F.lit(self.lat_m)


#: Equal metres on both axes, as map clients use it.
FLAT = Plane(lat_m=111_320.0)
PLANE = Plane()


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(
        dlon / 2
    ) * F.sin(dlon / 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(a))


def cell(v: Column, side: float) -> Column:
    return F.floor(v / F.lit(float(side))).cast("long")


def around(cx: Column, cy: Column, reach: int) -> Column:
    """Array of the cells within ``reach`` steps, the cell itself included."""
    steps = range(-reach, reach + 1)
    return F.array(
        *[F.struct((cx + dx).alias("cx"), (cy + dy).alias("cy")) for dx in steps for dy in steps]
    )
