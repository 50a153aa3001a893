"""Polygons as tables of edges: containment, nesting, area, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostelry.functions.geo import cell
from hostelry.operators.distribution import spread_join
from hostelry.session import durable


def rings(features: DataFrame, key: str, coordinates: str) -> DataFrame:
    """Every ring of a multipolygon (parts → rings → points), with no outer or hole meaning."""
    parts = features.select(key, F.posexplode(coordinates).alias("part", "__rings"))
    return parts.select(key, "part", F.posexplode("__rings").alias("ring", "points")).select(
        key, (F.shiftleft(F.col("part").cast("long"), 32) + F.col("ring")).alias("ring"), "points")


def edges(ring_rows: DataFrame, key: str) -> DataFrame:
    """One row per side: ``key, ring, x1, y1, x2, y2``; points are arrays ``[lon, lat]``."""
    sides = F.arrays_zip(
        F.slice("points", 1, F.size("points") - 1).alias("a"), F.slice("points", 2, F.size("points") - 1).alias("b"))
    rows = ring_rows.select(key, "ring", F.explode(sides).alias("s"))
    return rows.select(
        key, "ring", F.col("s.a")[0].alias("x1"), F.col("s.a")[1].alias("y1"),
        F.col("s.b")[0].alias("x2"), F.col("s.b")[1].alias("y2"))


#: Part of a cell's side by which an edge counts as near it: far more than rounding, far less than a cell.
NEAR = 1e-6


def cover(edge_rows: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Cells over polygons, each polygon at its own scale: ``*by, scale, cx, cy`` and ``polygons``, the ones that matter there.

    A cell's side is ``2^scale``. A polygon of n edges is cut into about the root of n rows and columns (scales are even,
    so few are in use), so its cells follow its edges and not its size beside other polygons. A border cell carries the
    edges near it and the few beyond it, to the right, that begin or end in its row; the other edges beyond it cross all
    of the row and count as one bit. A cell inside has the bit alone, a cell outside does not come.
    """
    keys = [*by, key]
    x_low, x_high, y_low, y_high = (f(a, b) for a, b in (("x1", "x2"), ("y1", "y2")) for f in (F.least, F.greatest))
    sizes = edge_rows.groupBy(*keys).agg(
        F.greatest(F.max(x_high) - F.min(x_low), F.max(y_high) - F.min(y_low)).alias("__extent"), F.count(F.lit(1)).alias("__n"))
    scale = (2 * F.round(F.log2(F.greatest(F.col("__extent"), F.lit(1e-12)) / (F.sqrt("__n") / 2 + 1)) / 2)).cast("int")
    scaled = spread_join(edge_rows, sizes.select(*keys, scale.alias("scale")), keys)
    side, bottom = F.pow(F.lit(2.0), "scale"), F.col("cy") * F.pow(F.lit(2.0), "scale")
    rowed = scaled.withColumn("cy", F.explode(F.sequence(F.floor(y_low / side), F.floor(y_high / side))))

    def x_at(y):
        return F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))

    one, two = x_at(F.greatest(y_low, bottom)), x_at(F.least(y_high, bottom + side))
    flat = F.col("y1") == F.col("y2")
    strips = rowed.groupBy(*keys, "scale", "cy").agg(F.collect_list(F.struct(
        "x1", "y1", "x2", "y2", F.when(flat, x_low).otherwise(F.least(one, two)).alias("a"), F.when(flat, x_high).otherwise(F.greatest(one, two)).alias("b"),
        ((y_low <= bottom) & (y_high >= bottom + side)).alias("through"))).alias("__strip"))
    placed = strips.withColumn("cx", F.explode(F.sequence(
        F.floor(F.array_min("__strip.a") / side - NEAR), F.floor(F.array_max("__strip.b") / side + NEAR))))
    left = F.col("cx") * side
    near = F.filter("__strip", lambda e: (e["a"] <= left + side * (1 + NEAR)) & (e["b"] >= left - side * NEAR))
    beyond = F.filter("__strip", lambda e: e["a"] > left + side * (1 + NEAR))
    cut = placed.select(*keys, "scale", "cx", "cy", near.alias("__near"), beyond.alias("__beyond"))
    middle_x, middle_y = F.col("cx") * side + side / 2, F.col("cy") * side + side / 2
    border = F.size("__near") > 0
    plain = F.transform(
        F.concat("__near", F.filter("__beyond", lambda e: ~e["through"])), lambda e: F.struct(*[e[n].alias(n) for n in ("x1", "y1", "x2", "y2")]))
    crossed = F.aggregate("__beyond", F.lit(0), lambda n, e: n + _crosses(middle_x, middle_y, e))
    cells = cut.select(
        *by, "scale", "cx", "cy", F.col(key).alias("__id"), F.when(border, plain).otherwise(F.slice(plain, 1, 0)).alias("edges"),
        (F.when(border, F.size(F.filter("__beyond", lambda e: e["through"]))).otherwise(crossed) % 2).alias("odd")).where("odd = 1 or size(edges) > 0")
    return cells.groupBy(*by, "scale", "cx", "cy").agg(F.array_sort(F.collect_list(F.struct(F.col("__id").alias("id"), "odd", "edges"))).alias("polygons"))


def _crosses(x: Column, y: Column, e: Column) -> Column:
    """1 if the ray to the right of the point crosses the edge, which holds its lower end only."""
    hit = ((e["y1"] > y) != (e["y2"] > y)) & (
        x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])
    return F.when(F.coalesce(hit, F.lit(False)), 1).otherwise(0)


def _inside(x: Column, y: Column, polygon: Column) -> Column:
    """Strictly inside by the even–odd rule over all rings; on the border is outside."""
    def touches(e):
        flat = (e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"])
        within = x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(
            F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        return flat & within

    odd = F.aggregate(polygon["edges"], polygon["odd"], lambda n, e: n + _crosses(x, y, e)) % 2 == 1
    return odd & ~F.exists(polygon["edges"], touches)


def containing(
    points: DataFrame, edge_rows: DataFrame, key: str, x: str = "lon", y: str = "lat", out: str = "inside", by: Sequence[str] = (),
) -> DataFrame:
    """Adds the sorted ids of the polygons that hold each point (and equal it on ``by``), empty when none does.

    One left join per scale in use (a few, whatever the number of polygons). The cell table decides whether it is
    broadcast by its run-time size; otherwise the join is by cell, where crowded cells are cut up. The test itself
    needs no further shuffle. Runs two jobs: the cells are written, and their scales come to the driver.
    """
    cells = durable(cover(edge_rows, key, by))
    scales = sorted(r["scale"] for r in cells.select("scale").distinct().collect())
    kind = edge_rows.schema[key].dataType.simpleString()
    found = points.withColumn(out, F.array().cast(f"array<{kind}>"))
    for scale in scales:
        known = ~F.isnan(x) & ~F.isnan(y)
        placed = found.withColumns({"cx": F.when(known, cell(F.col(x), 2.0**scale)), "cy": F.when(known, cell(F.col(y), 2.0**scale))})
        met = spread_join(placed, cells.where(F.col("scale") == scale).drop("scale"), [*by, "cx", "cy"], how="left")
        hits = F.transform(F.filter("polygons", lambda p: _inside(F.col(x), F.col(y), p)), lambda p: p["id"])
        found = met.withColumn(out, F.concat(out, F.coalesce(hits, F.array().cast(f"array<{kind}>")))).drop("cx", "cy", "polygons")
    return found.withColumn(out, F.array_sort(out))


def locate(points: DataFrame, edge_rows: DataFrame, key: str, x: str = "lon", y: str = "lat", out: str = "polygon") -> DataFrame:
    """Left point-in-polygon: the lowest id wins; points without a finite coordinate get null."""
    found = containing(points, edge_rows, key, x, y, "__in")
    return found.withColumn(out, F.try_element_at("__in", F.lit(1))).drop("__in")


def verify_place(located: DataFrame, declared: str, found: str) -> DataFrame:
    """Adds whether the declared place is the one found, trimmed and case-blind; null when unplaced."""
    return located.withColumn(
        "place_agrees",
        F.when(F.col(found).isNotNull(), F.coalesce(F.lower(F.trim(declared)) == F.lower(F.trim(found)), F.lit(False))))


def ring_areas(edge_rows: DataFrame, key: str) -> DataFrame:
    """Absolute shoelace area per ring."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    return edge_rows.groupBy(key, "ring").agg(F.abs(F.sum(cross) / 2).alias("area"))


def nest(edge_rows: DataFrame, key: str) -> DataFrame:
    """Role of each ring by containment: even depth is a part, odd depth a hole of its parent.

    A ring meets the cells of rings of its own feature only: the feature is part of the join key.
    """
    # a point just inside the ring's own boundary would do; a vertex does, as rings do not touch
    vertex = edge_rows.groupBy(key, "ring").agg(F.min(F.struct("x1", "y1")).alias("v")).select(
        key, "ring", F.col("v.x1").alias("vx"), F.col("v.y1").alias("vy"))
    held = containing(vertex, edge_rows.withColumnRenamed("ring", "around"), "around", "vx", "vy", "__around", by=[key])
    areas = ring_areas(edge_rows, key)
    around = held.select(key, "ring", F.explode("__around").alias("around"))
    sized = around.join(areas.withColumnsRenamed({"ring": "around", "area": "around_area"}), [key, "around"])
    depth = sized.groupBy(key, "ring").agg(
        F.count(F.lit(1)).alias("depth"), F.min_by("around", "around_area").alias("parent"))
    out = areas.join(depth, [key, "ring"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    hole = F.col("depth") % 2 == 1
    return out.withColumn("role", F.when(hole, "hole").otherwise("part")).withColumn("parent", F.when(hole, F.col("parent")))


def feature_areas(nested: DataFrame, key: str) -> DataFrame:
    """Area of the rebuilt feature: parts minus holes."""
    signed = F.when(F.col("role") == "hole", -F.col("area")).otherwise(F.col("area"))
    return nested.groupBy(key).agg(F.sum(signed).alias("area"), F.count(F.lit(1)).alias("rings"))


def area_offenders(areas: DataFrame, declared: DataFrame, key: str, stated: str, tolerance: float = 0.02) -> DataFrame:
    """Features whose rebuilt area departs from the stated one by more than the tolerance."""
    both = areas.join(declared.select(key, stated), key)
    gap = F.abs(F.col("area") - F.col(stated)) / F.col(stated)
    return both.withColumn("gap", gap).filter(F.col("gap") > tolerance)


def ring_faults(ring_rows: DataFrame, key: str) -> DataFrame:
    """Rings that are open, have fewer than four points, or enclose nothing."""
    flat = F.aggregate(
        F.sequence(F.lit(1), F.size("points") - 1), F.lit(0.0),
        lambda s, i: s + F.element_at("points", i)[0] * F.element_at("points", i + 1)[1]
        - F.element_at("points", i + 1)[0] * F.element_at("points", i)[1])
    fault = (
        F.when(F.size("points") < 4, "fewer than four points")
        .when(F.element_at("points", 1) != F.element_at("points", -1), "not closed")
        .when(F.abs(flat) < 1e-15, "no area")
    )
    return ring_rows.select(key, "ring", fault.alias("fault")).filter(F.col("fault").isNotNull())


# Zone groups by code prefix.
ZONE_PREFIXES = {"ZE1": "ze1", "ZE2": "ze2", "ZE3": "ze3", "ZE4": "ze4"}


def zone_group(code: Column, otherwise: str = "exclo") -> Column:
    chosen = F.when(F.lit(False), F.lit(""))
    for start, label in ZONE_PREFIXES.items():
        chosen = chosen.when(F.upper(code).startswith(start), F.lit(label))
    return chosen.otherwise(F.lit(otherwise))
