"""Joins by distance on a local plane.

No pair table is ever shuffled: a distance join feeds straight into an aggregate, copies of a
location are one location, and searches for the nearest descend a pyramid of occupied cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostelry.functions.geo import PLANE, Plane, around, cell, distance
from hostelry.operators.distribution import spread_join
from hostelry.session import discard, durable

SLACK = 1e-6
#: Bytes of a row of the pyramid, at most.
SITE_BYTES = 200
#: Sites a leaf cell may hold before it is cut further.
LEAF_SITES = 32
ALWAYS_OPEN = "\uffff"


def on_plane(rows: DataFrame, lat: str = "lat", lon: str = "lon", plane: Plane = PLANE) -> DataFrame:
    """Adds x and y in metres; rows without a finite coordinate are left out."""
    known = F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return rows.filter(known).withColumns({"x": plane.x(F.col(lon)), "y": plane.y(F.col(lat))})


def pairs_within(points: DataFrame, sites: DataFrame, radius: float, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs at most ``radius`` apart (and equal on ``keys``), with their distance ``d``.

    Points fall in one cell of side ``radius``, sites are copied to the nine cells around theirs, so
    the join is an equality. Columns other than keys must differ between the sides; sites carry
    ``sx`` and ``sy``. Aggregate the result, do not store it. The copies are shuffled: by a file's size the planner
    takes nine copies of a table for a small one and would broadcast them whole.
    """
    placed = points.withColumns({"__cx": cell(F.col("x"), radius), "__cy": cell(F.col("y"), radius)})
    near = sites.withColumn("__c", F.explode(around(cell(F.col("sx"), radius), cell(F.col("sy"), radius), 1)))
    near = near.withColumns({"__cx": F.col("__c.cx"), "__cy": F.col("__c.cy")}).drop("__c")
    d = distance(F.col("x"), F.col("y"), F.col("sx"), F.col("sy"))
    joined = spread_join(placed, near.hint("merge"), [*keys, "__cx", "__cy"], condition=d <= radius)
    return joined.drop("__cx", "__cy").withColumn("d", d)


@dataclass(frozen=True)
class Grid:
    """Where a pyramid over sites starts, how many levels it has, and whether it is below the session's broadcast size."""

    x: float
    y: float
    levels: int
    leaf: float
    small: bool = False


def grid_over(sites: DataFrame, by: Sequence[str] = (), leaf: float = 16.0) -> Grid | None:
    """A grid whose leaves hold few sites: cells are quartered until the fullest is light enough or
    as small as ``leaf`` metres. Only counts come to the driver. None when there are no sites."""
    seen = sites.agg(
        F.count(F.lit(1)).alias("n"), F.min("sx").alias("x"), F.min("sy").alias("y"),
        F.greatest(F.max("sx") - F.min("sx"), F.max("sy") - F.min("sy")).alias("e"),
    ).first()
    if not seen["n"]:
        return None
    levels, side = 0, max(seen["e"] * 1.001, leaf)
    while side > leaf:
        cells = sites.groupBy(*by, cell(F.col("sx") - seen["x"], side), cell(F.col("sy") - seen["y"], side))
        if cells.count().agg(F.max("count").alias("top")).first()["top"] <= LEAF_SITES:
            break
        levels, side = levels + 1, side / 4
    return Grid(seen["x"], seen["y"], levels, side, seen["n"] * SITE_BYTES <= broadcast_limit(sites))


def broadcast_limit(rows: DataFrame) -> int:
    """Bytes that the session lets a join broadcast."""
    text = rows.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    return int(rows.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text)) if not text.startswith("-") else -1


def _meet(front: DataFrame, cells: DataFrame, keys: Sequence[str], condition: Column | None, small: bool) -> DataFrame:
    """The same join on either way. Cells whose counted size is within the session's limit are broadcast, as the
    engine does with a table it knows the size of; others are shuffled, and hot cells cut up."""
    return spread_join(front, F.broadcast(cells) if small else cells, keys, condition=condition)


def nearest(
    points: DataFrame, sites: DataFrame, by: Sequence[str] = (), *, gate: str | None = None,
    leaf: float = 16.0, grid: Grid | None = None,
) -> DataFrame:
    """Nearest site per point among those equal on ``by``: ``pid, *by, sid, d``.

    ``points`` has ``pid``, ``x``, ``y``; ``sites`` has ``sid``, ``sx``, ``sy``. With ``gate``, a site
    whose gate is not null is open only to points whose gate is smaller. Ties go to the lower site.
    Points with no open site are left out.

    Sites stand in a pyramid of cells with one row per occupied cell and level, each with the box of
    what it holds. A point starts at the root and keeps only cells that could hold something nearer
    than the worst case of its best cell, so its candidates stay few however crowded a place is.
    """
    grid = grid or grid_over(sites, by, leaf)
    base = points.select(*by, "pid", "x", "y", *([F.col(gate).alias("__gate")] if gate else []))
    if grid is None:
        none = F.lit(None).cast(sites.schema["sid"].dataType).alias("sid")
        return base.filter(F.lit(False)).select("pid", *by, none, F.lit(0.0).alias("d"))
    gates = [F.max("g").alias("g")] if gate else []
    placed = sites.select(
        *by, "sid", "sx", "sy",
        cell(F.col("sx") - grid.x, grid.leaf).alias("cx"), cell(F.col("sy") - grid.y, grid.leaf).alias("cy"),
        *([F.coalesce(F.col(gate), F.lit(ALWAYS_OPEN)).alias("g")] if gate else []),
    )
    if not gate:
        placed = placed.groupBy(*by, "sx", "sy", "cx", "cy").agg(F.min("sid").alias("sid"))
    open_to = (F.col("g") > F.col("__gate")) if gate else None
    front = base.withColumns({"pcx": F.lit(0).cast("long"), "pcy": F.lit(0).cast("long")})
    keep = [*by, "pid", "x", "y", *(["__gate"] if gate else [])]
    mine = Window.partitionBy("pid", *by)
    at = [*by, "pcx", "pcy"]
    for level in reversed(range(grid.levels)):
        cells = placed.groupBy(
            *by, F.shiftright("cx", 2 * level).alias("cx"), F.shiftright("cy", 2 * level).alias("cy")
        ).agg(F.min("sx").alias("x0"), F.max("sx").alias("x1"), F.min("sy").alias("y0"), F.max("sy").alias("y1"), *gates)
        cells = cells.withColumns({"pcx": F.shiftright("cx", 2), "pcy": F.shiftright("cy", 2)})
        met = _meet(front, cells, at, open_to, grid.small)
        dx = F.greatest(F.col("x0") - F.col("x"), F.lit(0.0), F.col("x") - F.col("x1"))
        dy = F.greatest(F.col("y0") - F.col("y"), F.lit(0.0), F.col("y") - F.col("y1"))
        fx = F.greatest(F.abs(F.col("x") - F.col("x0")), F.abs(F.col("x") - F.col("x1")))
        fy = F.greatest(F.abs(F.col("y") - F.col("y0")), F.abs(F.col("y") - F.col("y1")))
        scored = met.withColumns({"lo": F.sqrt(dx * dx + dy * dy), "hi": F.sqrt(fx * fx + fy * fy)})
        kept = scored.withColumn("ub", F.min("hi").over(mine)).filter(F.col("lo") <= F.col("ub") + SLACK)
        front = kept.select(*keep, F.col("cx").alias("pcx"), F.col("cy").alias("pcy"))
    leaves = placed.withColumnsRenamed({"cx": "pcx", "cy": "pcy"})
    met = _meet(front, leaves, at, open_to, grid.small)
    d = distance(F.col("x"), F.col("y"), F.col("sx"), F.col("sy"))
    best = met.groupBy("pid", *by).agg(F.min(F.struct(d.alias("d"), F.col("sid"))).alias("best"))
    return best.select("pid", *by, "best.sid", "best.d")


def near_same_key(rows: DataFrame, keys: Sequence[str], row_id: str, radius: float, flag: str) -> DataFrame:
    """True on rows that have another row of the same key closer than ``radius``.

    In a cell whose diagonal is below the radius, two rows settle it for all of that cell, so crowded
    cells need no pairs. Only rows alone in their cell look around: at the other lone rows in reach,
    and at the nearest row of the crowded cells.
    """
    side = radius / 1.5
    known = rows
    for k in keys:
        known = known.filter(F.col(k).isNotNull())
    placed = known.select(
        *keys, F.col(row_id).alias("__id"), "x", "y",
        cell(F.col("x"), side).alias("cx"), cell(F.col("y"), side).alias("cy"))
    spot = [*keys, "cx", "cy"]
    cells = placed.groupBy(*spot).agg(
        F.count(F.lit(1)).alias("__k"), F.min("__id").alias("__id"), F.min("x").alias("x"), F.min("y").alias("y"))
    cells = durable(cells)
    crowded = cells.filter("__k > 1").select(*spot)
    lone = cells.filter("__k = 1").drop("__k")
    crowd = spread_join(placed, crowded, spot)
    other = lone.select(*keys, F.col("__id").alias("__o"), F.col("x").alias("sx"), F.col("y").alias("sy"),
                        F.explode(around(F.col("cx"), F.col("cy"), 2)).alias("__c")).select("*", "__c.*").drop("__c")
    d = distance(F.col("x"), F.col("y"), F.col("sx"), F.col("sy"))
    among_lone = spread_join(lone, other, spot, condition=(d < radius) & (F.col("__id") != F.col("__o"))).select("__id")
    sites = crowd.select(*keys, F.col("__id").alias("sid"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    to_crowd = nearest(lone.withColumnRenamed("__id", "pid"), sites, keys).filter(F.col("d") < radius).select(F.col("pid").alias("__id"))
    marked = crowd.select("__id").unionByName(among_lone).unionByName(to_crowd).distinct().withColumn("__near", F.lit(True))
    return rows.join(marked, rows[row_id] == marked["__id"], "left").withColumn(
        flag, F.coalesce(F.col("__near"), F.lit(False))).drop("__id", "__near")


#: Cells of a tile's side, a power of two and no less than two rims, cells it sees beyond that (its rim), rows of a cell it looks at in a round, and rows of a task's call, about.
TILE_BITS, RIM, LISTED, CALL_ROWS = 5, 4, 64, 20_000
_REACH = [(du, dv) for du in range(-2, 3) for dv in range(-2, 3)]


def _certain(tiles: Sequence[int], us: Sequence[int], vs: Sequence[int], xs: Sequence[float], ys: Sequence[float], cut: Sequence[bool], radius: float, last: int) -> list[int]:
    """Rows, newest first, that are kept whatever lies outside their tile's view, which goes from cell 0 to ``last`` both ways. ``cut``: the cell
    may have older rows than this, unseen."""
    kept, unsure, unseen, out = {}, {}, set(), []
    for i, (t, u, v, x, y) in enumerate(zip(tiles, us, vs, xs, ys, strict=True)):
        around_it = [(t, u + du, v + dv) for du, dv in _REACH]

        def close(spot):
            return math.sqrt((x - spot[0]) * (x - spot[0]) + (y - spot[1]) * (y - spot[1])) <= radius

        if not any(c in kept and close(kept[c]) for c in around_it):
            sees_all = 2 <= u <= last - 2 and 2 <= v <= last - 2 and not any(c in unseen for c in around_it)
            if sees_all and not any(close(spot) for c in around_it for spot in unsure.get(c, ())):
                kept[t, u, v] = x, y
                out.append(i)
            else:
                unsure.setdefault((t, u, v), []).append((x, y))
        if cut[i]:
            unseen.add((t, u, v))
    return out


def _winners(undecided: DataFrame, rows: int, radius: float) -> DataFrame:
    """Rows of ``undecided`` (``__name, __o, x, y, cx, cy``) that one look at tiles of cells proves to be kept."""
    newest = [F.col("__o").desc(), "x", "y"]
    seen = undecided.withColumn("__rank", F.row_number().over(Window.partitionBy("__name", "cx", "cy").orderBy(*newest))).filter(F.col("__rank") <= LISTED)
    for c in "xy":
        tiles = [F.shiftright(F.col(f"c{c}") + d, TILE_BITS) for d in (-RIM, RIM)]
        seen = seen.withColumn(f"t{c}", F.explode(F.array_distinct(F.array(*tiles))))
    calls = 2 * rows // CALL_ROWS + 1
    seen = seen.withColumn("__call", F.pmod(F.xxhash64("__name", "tx", "ty"), F.lit(calls)))
    seen = seen.withColumn("__at", F.row_number().over(Window.partitionBy("__call").orderBy(*newest)))
    schema = undecided.select("__name", F.col("__o.id").alias("__id"), "x", "y", "cx", "cy").schema
    names, bits, rim, listed = schema.names, TILE_BITS, RIM, LISTED

    def run(table):
        table = table.sort_by("__at")
        number = {}
        tx, ty, cx, cy, xs, ys, rank = (table.column(c).to_pylist() for c in ("tx", "ty", "cx", "cy", "x", "y", "__rank"))
        tiles = [number.setdefault(t, len(number)) for t in zip(table.column("__name").to_pylist(), tx, ty, strict=True)]
        us, vs = ([c - (t << bits) + rim for c, t in zip(cells, at, strict=True)] for cells, at in ((cx, tx), (cy, ty)))
        found = _certain(tiles, us, vs, xs, ys, [r == listed for r in rank], radius, (1 << bits) + 2 * rim - 1)
        return table.take(pa.array(found, pa.int64())).select(names)

    inside = seen.select("__call", "__at", "__rank", "__name", F.col("__o.id").alias("__id"), "x", "y", "cx", "cy", "tx", "ty")
    return inside.groupBy("__call").applyInArrow(run, schema).distinct()


def keep_newest_apart(rows: DataFrame, name: str, row_id: str, newest: Sequence[Column], radius: float) -> DataFrame:
    """Greedy by name: newest first, drop what lies within ``radius`` of a kept one.

    Rows kept are more than a radius apart, so a cell with that diagonal holds at most one of them.
    Cells are looked at in tiles of 32 by 32 and a rim, at most 64 rows of each, in one bounded step a tile: a row is
    kept there if every newer row in its reach is in view and dropped. Then open rows near kept ones go. A round settles
    whole chains of rows within a tile, and the newest open row of each name at least, so rounds follow the tiles that
    a chain crosses, newest to oldest, not its length. Ends when no row is open, and leaves one table of
    ids in the shared folder. Equal rows of one id count once in the order and are all kept. Rows without a name pass.
    """
    side = radius / 1.4142135623730951
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(newest)], F.col(row_id).alias("id"))
    spot = ["__name", "cx", "cy"]
    undecided = durable(rows.filter(F.col(name).isNotNull()).select(
        F.col(name).alias("__name"), order.alias("__o"), "x", "y",
        cell(F.col("x"), side).alias("cx"), cell(F.col("y"), side).alias("cy")))
    rounds = []
    while left := undecided.count():
        winners = durable(_winners(undecided, left, radius))
        rounds.append(winners)
        shade = winners.select("__name", F.col("x").alias("sx"), F.col("y").alias("sy"), F.explode(around(F.col("cx"), F.col("cy"), 2)).alias("__c")).select(
            "__name", "__c.cx", "__c.cy", "sx", "sy")
        d = distance(F.col("x"), F.col("y"), F.col("sx"), F.col("sy"))
        last, undecided = undecided, durable(spread_join(undecided, shade, spot, how="left_anti", condition=d <= radius))
        discard(last)
    discard(undecided)
    unnamed = rows.filter(F.col(name).isNull())
    if not rounds:
        return unnamed
    ids = durable(reduce(DataFrame.unionByName, [w.select(F.col("__id").alias("__kept")) for w in rounds]))
    discard(*rounds)
    return rows.join(ids, rows[row_id] == ids["__kept"], "left_semi").unionByName(unnamed)


def evidence_of_host(rows: DataFrame, row_id: str, host: str, price: str, area: str, capacity: str, rooms: str, far: float) -> DataFrame:
    """For unpriced rows: distance to the nearest priced row of the host, and, where that is far,
    whether the host has priced rows in the same area, and there with the same capacity or rooms."""
    from hostelry.operators.linkage import member

    known = rows.filter(F.col(price).isNotNull())
    open_rows = rows.filter(F.col(price).isNull() & F.col(host).isNotNull())
    sites = known.filter(F.col(host).isNotNull()).select(host, F.col(row_id).alias("sid"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    found = nearest(open_rows.withColumnRenamed(row_id, "pid"), sites, [host]).select(
        F.col("pid").alias(row_id), F.col("d").alias("nearest_m"))
    out = open_rows.join(found, row_id, "left").withColumn("far", F.col("nearest_m") >= far)
    out = member(out, known, [host, area], "same_area")
    out = member(out, known, [host, area, capacity], "same_capacity")
    out = member(out, known, [host, area, rooms], "same_rooms")
    out = out.withColumns({
        "same_capacity": F.col("same_capacity") & F.col(capacity).isNotNull(),
        "same_rooms": F.col("same_rooms") & F.col(rooms).isNotNull()})
    return out


#: Halvings of a cell of side ``radius`` that totals may go down to, and distinct spots of a cell that are not worth more.
HALVINGS, CELL_SPOTS = 10, 512


def _partial_totals(spots: DataFrame, sites: DataFrame, radius: float, sums: Sequence[str], ring) -> DataFrame:
    """Rows of ``sid, ring`` and sums that add up to the totals: one per site and cell that lies in one ring as a whole, one per
    site and spot of the cells that a ring's edge cuts."""
    fine = radius / 2**HALVINGS
    placed = durable(spots.select("x", "y", *sums, cell(F.col("x"), fine).alias("fx"), cell(F.col("y"), fine).alias("fy")))

    def at(level):
        return [F.shiftright(c, HALVINGS - level).alias(n) for c, n in (("fx", "cx"), ("fy", "cy"))]

    depth = 0
    while depth < HALVINGS and (placed.groupBy(*at(depth)).count().agg(F.max("count")).first()[0] or 0) > CELL_SPOTS:
        depth += 1
    front = sites.select("sid", "sx", "sy", F.explode(around(cell(F.col("sx"), radius), cell(F.col("sy"), radius), 1)).alias("c")).select(
        "sid", "sx", "sy", "c.cx", "c.cy")
    parts = None
    for level in range(depth):
        cells = placed.groupBy(*at(level)).agg(
            *[F.sum(c).alias(c) for c in sums], F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
        met = spread_join(front, cells, ["cx", "cy"])
        # rounding keeps order, so no point of the cell measures less than ``lo`` or more than ``hi``
        low = [F.greatest(F.col(f"{n}0") - F.col(f"s{n}"), F.lit(0.0), F.col(f"s{n}") - F.col(f"{n}1")) for n in "xy"]
        high = [F.greatest(F.abs(F.col(f"s{n}") - F.col(f"{n}0")), F.abs(F.col(f"s{n}") - F.col(f"{n}1"))) for n in "xy"]
        lo, hi = (F.sqrt(a * a + b * b) for a, b in (low, high))
        met = durable(met.select("sid", "sx", "sy", "cx", "cy", *sums, ring(lo).alias("ring"), ring(hi).alias("__far")).where("ring is not null"))
        whole = met.where("ring = __far").select("sid", "ring", *sums)
        parts = whole if parts is None else parts.unionByName(whole)
        quarters = F.array(*[F.struct((F.col("cx") * 2 + i).alias("cx"), (F.col("cy") * 2 + j).alias("cy")) for i in (0, 1) for j in (0, 1)])
        front = met.where("__far is null or ring <> __far").select("sid", "sx", "sy", F.explode(quarters).alias("c")).select("sid", "sx", "sy", "c.cx", "c.cy")
    leaves = placed.select("x", "y", *sums, *at(depth))
    d = distance(F.col("x"), F.col("y"), F.col("sx"), F.col("sy"))
    met = spread_join(leaves, front, ["cx", "cy"], condition=d <= radius).select("sid", ring(d).alias("ring"), *sums)
    return met if parts is None else parts.unionByName(met)


def totals_within(spots: DataFrame, sites: DataFrame, radius: float, sums: Sequence[str], ring=None) -> DataFrame:
    """Sums over the spots within a radius of each site: ``sid`` and the sums; sites without spots are left out.

    ``spots`` has one row per place (``x``, ``y``); ``sites`` has ``sid``, ``sx``, ``sy``. With ``ring``, a function of a distance
    that does not fall as it grows (null: too far), sums come per ``sid`` and ``ring``.

    Spots stand in cells that are halved until the fullest holds few. A cell that lies in one ring as a whole adds its
    totals at once; only cells that an edge cuts are opened. So a crowd costs its sites, not its pairs. Runs a count
    and a join per halving; where no cell is crowded that is one count, and the join meets spots at once.
    """
    bands = (lambda d: F.when(d <= radius, F.lit(1))) if ring is None else ring
    found = _partial_totals(spots, sites, radius, sums, bands)
    return found.groupBy("sid", *([] if ring is None else ["ring"])).agg(*[F.sum(c).alias(c) for c in sums])


def site_profile(sites: DataFrame, points: DataFrame, radius: float, sums: dict[str, Column]) -> DataFrame:
    """Count and sums of the points within a radius of each site; zero where there are none.

    ``sums`` are over the columns of ``points``; ``sites`` has ``sid``, ``sx``, ``sy``.
    """
    names = list(sums)
    spots = points.groupBy("x", "y").agg(
        F.count(F.lit(1)).alias("near"), *[F.sum(c).alias(n) for n, c in sums.items()])
    totals = totals_within(spots, sites, radius, ["near", *names])
    return sites.join(totals, "sid", "left").na.fill(0, ["near", *names])


def ring_series(sites: DataFrame, points: DataFrame, step: float, rings: int, weight: Column) -> DataFrame:
    """Cumulative count and weight of points per site for radii 0, step, 2·step …"""
    spots = points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"))
    counts = totals_within(
        spots, sites, step * rings, ["n", "w"], lambda d: F.when(d <= step * rings, F.ceil(d / step).cast("int")))
    frame = sites.select("sid", F.explode(F.sequence(F.lit(0), F.lit(rings))).alias("ring"))
    along = Window.partitionBy("sid").orderBy("ring")
    return frame.join(counts, ["sid", "ring"], "left").select(
        "sid", (F.col("ring") * step).alias("radius"),
        F.sum(F.coalesce("n", F.lit(0))).over(along).alias("points"),
        F.sum(F.coalesce("w", F.lit(0.0))).over(along).alias("weight"))
