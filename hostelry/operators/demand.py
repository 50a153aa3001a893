"""Spreading demand over the sites around it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostelry.operators.spatial import nearest, totals_within
from hostelry.session import durable


def spread(sources: DataFrame, sites: DataFrame, radius: float, weight: str | Sequence[str] = "w") -> DataFrame:
    """Each source's weight split equally among the sites within the radius, or given whole to the
    nearest one when there is none: every site with what it receives, and nothing is lost.

    ``sources`` has ``x, y`` and the weight, ``sites`` has ``sid, sx, sy``. Sources and sites standing
    on the same spot are one. The result is ``received``; with several weights it is ``received_<weight>`` for each,
    and all of them ride on the same two distance joins, one to count and one to share.
    """
    names = [weight] if isinstance(weight, str) else list(weight)
    known = sources.filter(reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in names]))
    spots = known.groupBy("x", "y").agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(f"__w{i}") for i, n in enumerate(names)])
    held = [f"__w{i}" for i in range(len(names))]
    places = sites.groupBy(F.col("sx").alias("x"), F.col("sy").alias("y")).agg(F.count(F.lit(1)).alias("__k"))
    asking = spots.select(F.struct("x", "y").alias("sid"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    seen = totals_within(places, asking, radius, ["__k"]).select("sid.x", "sid.y", "__k")
    counted = durable(spots.join(seen, ["x", "y"], "left"))
    shares = counted.filter(F.col("__k").isNotNull()).select("x", "y", *[(F.col(c) / F.col("__k")).alias(c) for c in held])
    standing = places.select(F.struct("x", "y").alias("sid"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    per_place = totals_within(shares, standing, radius, held).select(
        F.col("sid.x").alias("sx"), F.col("sid.y").alias("sy"), *[F.col(c).alias(f"__s{c}") for c in held])
    lonely = counted.filter(F.col("__k").isNull()).select(F.struct("x", "y").alias("pid"), "x", "y", *held)
    closest = nearest(lonely, sites).join(lonely.select("pid", *held), "pid")
    direct = closest.groupBy("sid").agg(*[F.sum(c).alias(f"__d{c}") for c in held])
    got = {n: F.coalesce(f"__s{c}", F.lit(0.0)) + F.coalesce(f"__d{c}", F.lit(0.0)) for n, c in zip(names, held)}
    out = sites.join(per_place, ["sx", "sy"], "left").join(direct, "sid", "left")
    named = {"received": got[names[0]]} if isinstance(weight, str) else {f"received_{n}": v for n, v in got.items()}
    return out.withColumns(named).drop(*[f"__{k}{c}" for k in "sd" for c in held])


def nearest_beyond(sources: DataFrame, sites: DataFrame, radius: float) -> DataFrame:
    """For sources with no site within the radius: the nearest site and its distance.
    ``sources`` has ``pid, x, y``."""
    asking = sources.select("x", "y").distinct().select(F.struct("x", "y").alias("sid"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    places = sites.groupBy(F.col("sx").alias("x"), F.col("sy").alias("y")).agg(F.count(F.lit(1)).alias("__k"))
    hit = totals_within(places, asking, radius, ["__k"]).select("sid.x", "sid.y")
    lonely = sources.join(hit, ["x", "y"], "left_anti")
    return nearest(lonely, sites)
