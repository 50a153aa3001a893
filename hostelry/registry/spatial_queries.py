"""Distance joins, polygons, demand and allocation."""

from pyspark.sql import functions as F

from hostelry.functions import geo, numeric
from hostelry.operators import bins, demand, polygons, spatial
from hostelry.plans import scenario
from hostelry.registry.core import query
from hostelry.registry.fixtures import read, standin
from hostelry.session import durable

c = F.col


def metres(a: str, b: str) -> str:
    return f"sqrt(pow(({a}.lat-{b}.lat)*110570e0,2) + pow(({a}.lon-{b}.lon)*(111320e0*cos(radians(4139e-2))),2))"


def haversine(a: str, b: str) -> str:
    return (f"(2*6371e0*asin(sqrt(pow(sin(radians({b}.lat-{a}.lat)/2),2)+cos(radians({a}.lat))*cos(radians({b}.lat))"
            f"*pow(sin(radians({b}.lon-{a}.lon)/2),2))))")


def points(spark, folder, name):
    return spatial.on_plane(standin(spark, folder, name))


def as_sites(rows, *extra):
    return rows.select(c("id").alias("sid"), c("x").alias("sx"), c("y").alias("sy"), *extra)


@query("geo01_distance_to_centre", "GEO-01 REG-01", """
SELECT id, round(2*6371e0*asin(sqrt(pow(sin(radians(lat-41387e-3)/2),2)+cos(radians(41387e-3))*cos(radians(lat))*pow(sin(radians(lon-217e-2)/2),2))), 6) AS km FROM sites""", ("sites",))
def distance_to_centre(spark, folder):
    km = geo.haversine_km(F.lit(41.387), F.lit(2.17), c("lat"), c("lon"))
    return standin(spark, folder, "sites").select("id", F.round(km, 6).alias("km"))


@query("geo02_plane_coordinates", "GEO-02", """
SELECT id, round(lon*111320e0*cos(radians(4139e-2)), 3) AS x, round(lat*110570e0, 3) AS y, round(lat*111320e0, 3) AS flat_y FROM sites""", ("sites",))
def plane_coordinates(spark, folder):
    return points(spark, folder, "sites").select(
        "id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(geo.FLAT.y(c("lat")), 3).alias("flat_y"))


@query("sj03_radius_join", "SJ-03 SJ-10", f"""
SELECT a.area, count(*) AS pairs, round(sum(d), 2) AS metres FROM (SELECT a.area, {metres('a', 'f')} AS d FROM agents a, food f) a WHERE d <= 200 GROUP BY 1""", ("agents", "food"))
def radius_join(spark, folder):
    sites = as_sites(points(spark, folder, "food"))
    # rows on one spot are one row with their number, so a pair of spots is measured once
    spots = points(spark, folder, "agents").groupBy("area", "x", "y").agg(F.count("*").alias("here"))
    stands = sites.groupBy("sx", "sy").agg(F.count("*").alias("there"))
    pairs = spatial.pairs_within(spots, stands, 200.0).withColumn("n", c("here") * c("there"))
    return pairs.groupBy("area").agg(F.sum("n").alias("pairs"), F.round(F.sum(c("n") * c("d")), 2).alias("metres"))


@query("sj04_nearest_fallback", "SJ-04", f"""
WITH d AS (SELECT a.id, f.id AS sid, {metres('a', 'f')} AS d FROM agents a, food f), m AS (SELECT id, min(d) AS d FROM d GROUP BY 1 HAVING min(d) > 60)
SELECT m.id, min(d.sid) AS sid, round(m.d, 3) AS d FROM m JOIN d ON d.id = m.id AND d.d <= m.d + 1e-7 GROUP BY 1, 3""", ("agents", "food"))
def nearest_fallback(spark, folder):
    agents = points(spark, folder, "agents").select(c("id").alias("pid"), "x", "y")
    return demand.nearest_beyond(agents, as_sites(points(spark, folder, "food")), 60.0).select(
        c("pid").alias("id"), "sid", F.round("d", 3).alias("d"))


@query("sj04_nearest_hotel_by_band", "SJ-04 SJ-10", f"""
WITH d AS (SELECT a.id, s.id AS sid, {metres('a', 's')} AS d FROM agents a JOIN sites s ON s.band = a.band), m AS (SELECT id, min(d) AS d FROM d GROUP BY 1)
SELECT m.id, min(d.sid) AS sid, round(m.d, 3) AS d FROM m JOIN d ON d.id = m.id AND d.d <= m.d + 1e-7 GROUP BY 1, 3""", ("agents", "sites"))
def nearest_hotel_by_band(spark, folder):
    agents = points(spark, folder, "agents").select(c("id").alias("pid"), "band", "x", "y")
    out = spatial.nearest(agents, as_sites(points(spark, folder, "sites"), "band"), ["band"])
    return out.select(c("pid").alias("id"), "sid", F.round("d", 3).alias("d"))


@query("sj05_close_same_key", "SJ-05", f"""
WITH p AS (SELECT id, host_id, lat, lon FROM agents) SELECT id, exists (SELECT 1 FROM p b WHERE b.host_id = p.host_id AND b.id <> p.id AND {metres('p', 'b')} < 200) AS close FROM p""", ("agents",))
def close_same_key(spark, folder):
    rows = points(spark, folder, "agents").select("id", "host_id", "x", "y")
    return spatial.near_same_key(rows, ["host_id"], "id", 200.0, "close").select("id", "close")


@query("sj06_same_corner", "SJ-06", f"""
WITH RECURSIVE p AS (SELECT id, name, lat, lon, visited FROM food),
e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.name = b.name AND (a.visited > b.visited OR (a.visited = b.visited AND a.id > b.id)) AND {metres('a', 'b')} <= 150),
ord AS (SELECT id, row_number() over (order by visited DESC, id DESC) AS i FROM p),
walk(i, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
 SELECT w.i + 1, case when exists (SELECT 1 FROM e JOIN ord o ON o.id = e.b WHERE o.i = w.i + 1 AND list_contains(w.kept, e.a)) then w.kept
  else list_append(w.kept, (SELECT id FROM ord WHERE ord.i = w.i + 1)) end FROM walk w WHERE w.i < (SELECT count(*) FROM p))
SELECT unnest(kept) AS id FROM (SELECT kept FROM walk ORDER BY i DESC LIMIT 1)""", ("food",))
def same_corner(spark, folder):
    rows = points(spark, folder, "food")
    return spatial.keep_newest_apart(rows, "name", "id", [c("visited")], 150.0).select("id")


@query("sj07_host_evidence", "SJ-07 ML-11", f"""
WITH u AS (SELECT * FROM agents WHERE price IS NULL), k AS (SELECT * FROM agents WHERE price IS NOT NULL)
SELECT u.id, round(min({metres('u', 'k')}), 3) AS nearest_m, min({metres('u', 'k')}) >= 150 AS far, coalesce(bool_or(k.area = u.area), false) AS same_area,
 coalesce(bool_or(k.area = u.area AND k.places = u.places), false) AS same_capacity, coalesce(bool_or(k.area = u.area AND k.bedrooms = u.bedrooms), false) AS same_rooms
FROM u LEFT JOIN k USING (host_id) GROUP BY u.id""", ("agents",))
def host_evidence(spark, folder):
    out = spatial.evidence_of_host(points(spark, folder, "agents"), "id", "host_id", "price", "area", "places", "bedrooms", 150.0)
    return out.select("id", F.round("nearest_m", 3).alias("nearest_m"), "far", "same_area", "same_capacity", "same_rooms")


ABSORB = 0.802


@query("sj08_site_profile", "SJ-08", f"""
WITH d AS (SELECT s.id, a.places, greatest(1, coalesce(case when bedrooms > 0 then bedrooms::DOUBLE end, round_even(a.places / 2e0, 0))) AS u FROM sites s JOIN agents a ON {metres('a', 's')} <= 300)
SELECT s.id, count(d.id) AS near, coalesce(sum(d.places), 0)::BIGINT AS near_places, coalesce(sum(d.u), 0) AS near_rooms, round(s.rooms * 802e-3, 4) AS occupied_now,
 round(least(s.rooms * 802e-3 + s.id % 30, s.rooms), 4) AS occupied_later FROM sites s LEFT JOIN d ON d.id = s.id GROUP BY s.id, s.rooms""", ("sites", "agents"))
def site_profile(spark, folder):
    agents = points(spark, folder, "agents").withColumnRenamed("places", "beds")
    units = numeric.capacity_units(c("bedrooms"), c("beds"))
    out = spatial.site_profile(as_sites(points(spark, folder, "sites"), "rooms"), agents, 300.0, {"near_places": c("beds"), "near_rooms": units})
    now = c("rooms") * ABSORB
    return out.select(c("sid").alias("id"), "near", "near_places", "near_rooms", F.round(now, 4).alias("occupied_now"),
                      F.round(F.least(now + c("sid") % 30, c("rooms").cast("double")), 4).alias("occupied_later"))


@query("sj09_ring_series", "SJ-09", f"""
WITH d AS (SELECT s.id, ceil({metres('a', 's')} / 50) AS r, a.places FROM sites s JOIN agents a ON {metres('a', 's')} <= 500), k AS (SELECT unnest(range(0, 11)) AS r)
SELECT s.id AS sid, k.r * 50e0 AS radius, count(d.id) AS points, round(coalesce(sum(d.places), 0) * 383e-3, 4) AS low, round(coalesce(sum(d.places), 0) * 48e-2, 4) AS high
FROM sites s CROSS JOIN k LEFT JOIN d ON d.id = s.id AND d.r <= k.r GROUP BY 1, 2""", ("sites", "agents"))
def ring_series(spark, folder):
    out = spatial.ring_series(as_sites(points(spark, folder, "sites")), points(spark, folder, "agents"), 50.0, 10, c("places").cast("double"))
    return out.select("sid", "radius", "points", F.round(c("weight") * 0.383, 4).alias("low"), F.round(c("weight") * 0.48, 4).alias("high"))


# ---------------------------------------------------------------- polygons

HOLE = {"lat0": "lat0 + (lat1-lat0)*25e-2", "lat1": "lat0 + (lat1-lat0)*75e-2", "lon0": "lon0 + (lon1-lon0)*25e-2", "lon1": "lon0 + (lon1-lon0)*75e-2"}


def features(spark, folder):
    """Rectangles as multipolygons; every sixth has a hole, wrongly given as a part of its own."""
    def ring(b):
        corners = [("lon0", "lat0"), ("lon1", "lat0"), ("lon1", "lat1"), ("lon0", "lat1"), ("lon0", "lat0")]
        return "array(" + ", ".join(f"array({b[x]}, {b[y]})" for x, y in corners) + ")"
    outer = ring({k: k for k in HOLE})
    return standin(spark, folder, "polys").selectExpr(
        "id", "name", "region", "(lat1-lat0)*(lon1-lon0) * case when id % 6 = 0 then 75e-2 when id = 7 then 9e-1 else 1e0 end AS stated",
        f"case when id % 6 = 0 then array(array({outer}), array({ring(HOLE)})) else array(array({outer})) end AS coordinates")


def area_edges(spark, folder):
    return polygons.edges(polygons.rings(features(spark, folder), "id", "coordinates"), "id")


PIP_SQL = f"""
h AS (SELECT id, {', '.join(f'{e} AS h{k}' for k, e in HOLE.items())} FROM polys),
pip AS (SELECT a.id, min(p.id) AS polygon FROM agents a LEFT JOIN (SELECT * FROM polys JOIN h USING (id)) p ON a.lat > p.lat0 AND a.lat < p.lat1 AND a.lon > p.lon0 AND a.lon < p.lon1
 AND NOT (p.id % 6 = 0 AND a.lat >= hlat0 AND a.lat <= hlat1 AND a.lon >= hlon0 AND a.lon <= hlon1) GROUP BY a.id)"""


@query("sj01_point_in_polygon", "SJ-01", f"WITH {PIP_SQL} SELECT id, polygon FROM pip", ("agents", "polys"))
def point_in_polygon(spark, folder):
    areas = area_edges(spark, folder).withColumnRenamed("id", "poly")
    return polygons.locate(standin(spark, folder, "agents").select("id", "lat", "lon"), areas, "poly").select("id", "polygon")


@query("sj02_verified_geocodes", "SJ-02", f"""
WITH {PIP_SQL}, v AS (SELECT lower(trim(case when a.id % 4 = 0 then ' nation_3' else concat('NATION_', cast(polygon as varchar), ' ') end)) = lower(p.name) AS ok FROM pip JOIN agents a USING (id) LEFT JOIN polys p ON p.id = pip.polygon)
SELECT ok AS place_agrees, count(*) AS rows FROM v GROUP BY 1""", ("agents", "polys"))
def verified_geocodes(spark, folder):
    located = point_in_polygon(spark, folder)
    names = standin(spark, folder, "polys").select(c("id").alias("polygon"), "name")
    rows = located.join(names, "polygon", "left").withColumn(
        "declared", F.when(c("id") % 4 == 0, " nation_3").otherwise(F.concat(F.lit("NATION_"), c("polygon").cast("string"), F.lit(" "))))
    return polygons.verify_place(rows, "declared", "name").groupBy("place_agrees").agg(F.count("*").alias("rows"))


@query("geo03_rings", "GEO-03", """
SELECT id, count(*) AS rings, (count(*) * 5)::BIGINT AS points FROM (SELECT id FROM polys UNION ALL SELECT id FROM polys WHERE id % 6 = 0) GROUP BY 1""", ("polys",))
def rings(spark, folder):
    return polygons.rings(features(spark, folder), "id", "coordinates").groupBy("id").agg(
        F.count("*").alias("rings"), F.sum(F.size("points")).alias("points"))


@query("geo04_rebuilt_polygons", "GEO-04", """
SELECT id, 0::BIGINT AS ring, 'part' AS role, 0 AS depth, NULL::BIGINT AS parent FROM polys UNION ALL SELECT id, 4294967296, 'hole', 1, 0 FROM polys WHERE id % 6 = 0""", ("polys",))
def rebuilt_polygons(spark, folder):
    return polygons.nest(area_edges(spark, folder), "id").select("id", "ring", "role", "depth", "parent")


@query("geo05_area_offenders", "GEO-05", f"""
WITH h AS (SELECT id, {', '.join(f'{e} AS h{k}' for k, e in HOLE.items())} FROM polys),
r AS (SELECT id, 0 AS ring, lat0, lat1, lon0, lon1 FROM polys UNION ALL SELECT id, 1, hlat0, hlat1, hlon0, hlon1 FROM h WHERE id % 6 = 0),
e AS (SELECT id, ring, unnest([[lon0, lat0, lon1, lat0], [lon1, lat0, lon1, lat1], [lon1, lat1, lon0, lat1], [lon0, lat1, lon0, lat0]]) AS s FROM r),
a AS (SELECT id, ring, abs(sum(s[1] * s[4] - s[3] * s[2]) / 2) AS area FROM e GROUP BY 1, 2),
d AS (SELECT i.id, i.ring, count(o.ring) AS depth FROM r i LEFT JOIN r o ON i.id = o.id AND i.ring <> o.ring AND i.lat0 > o.lat0 AND i.lat1 < o.lat1 AND i.lon0 > o.lon0 AND i.lon1 < o.lon1 GROUP BY 1, 2),
f AS (SELECT id, sum(case when depth % 2 = 0 then area else -area end) AS area FROM a JOIN d USING (id, ring) GROUP BY 1),
g AS (SELECT id, abs(area - stated) / stated AS gap FROM f JOIN (
 SELECT id, (lat1-lat0)*(lon1-lon0) * case when id % 6 = 0 then 75e-2 when id = 7 then 9e-1 else 1e0 end AS stated FROM polys) USING (id))
SELECT id, round(gap, 6) AS gap FROM g WHERE gap > 2e-2""", ("polys",))
def area_offenders(spark, folder):
    areas = polygons.feature_areas(polygons.nest(area_edges(spark, folder), "id"), "id")
    return polygons.area_offenders(areas, features(spark, folder), "id", "stated").select("id", F.round("gap", 6).alias("gap"))


@query("geo06_ring_faults", "GEO-06", """
SELECT id, case when id % 5 = 1 then 'not closed' when id % 5 = 2 then 'fewer than four points' else 'no area' end AS fault FROM polys WHERE id % 5 IN (1, 2, 3)""", ("polys",))
def ring_faults(spark, folder):
    broken = polygons.rings(features(spark, folder), "id", "coordinates").filter("ring = 0").withColumn(
        "points", F.expr("case id % 5 when 1 then slice(points, 1, 4) when 2 then slice(points, 1, 3)"
                         " when 3 then array(points[0], points[1], points[0], points[1], points[0]) else points end"))
    return polygons.ring_faults(broken, "id").select("id", "fault")


@query("geo07_zone_groups", "GEO-07", """
SELECT g AS "group", count(*) AS zones FROM (SELECT case c_custkey % 6 when 0 then 'ze1' when 1 then 'ze2' when 2 then 'ze3' when 3 then 'ze4' else 'exclo' end AS g FROM customer) GROUP BY 1""")
def zone_groups(spark, folder):
    code = F.expr("case c_custkey % 6 when 0 then 'ZE1' when 1 then 'ze2' when 2 then 'ZE3A' when 3 then 'ZE4c' when 4 then 'EXCLO' else 'X' end")
    return read(spark, folder, "customer").groupBy(polygons.zone_group(code).alias("group")).agg(F.count("*").alias("zones"))


# ---------------------------------------------------------------- demand

SPREAD_SQL = f"""
d AS (SELECT a.id, f.id AS sid, {metres('a', 'f')} AS d, a.places * 383e-3 AS w FROM agents a, food f),
near AS (SELECT *, count(*) over (partition by id) AS n FROM d WHERE d <= 80),
lost AS (SELECT id, arg_min(sid, d) AS sid, any_value(w) AS w FROM d WHERE id NOT IN (SELECT id FROM near) GROUP BY 1),
got AS (SELECT sid, sum(w) AS v FROM (SELECT sid, w / n AS w FROM near UNION ALL SELECT sid, w FROM lost) GROUP BY 1)"""


def agents_demand(spark, folder):
    return points(spark, folder, "agents").withColumn("w", c("places") * numeric.DWELLING_OCCUPANCY)


@query("dem01_demand_spreading", "DEM-01", f"WITH {SPREAD_SQL} SELECT f.id, round(coalesce(v, 0), 5) AS received FROM food f LEFT JOIN got ON got.sid = f.id", ("agents", "food"))
def demand_spreading(spark, folder):
    out = demand.spread(agents_demand(spark, folder), as_sites(points(spark, folder, "food")), 80.0)
    return out.select(c("sid").alias("id"), F.round("received", 5).alias("received"))


HOTEL_SPREAD_SQL = f"""
hd AS (SELECT s.id, f.id AS sid, {metres('s', 'f')} AS d, s.places * 679e-3 AS w, s.id % 5 * 3e0 AS extra FROM sites s, food f),
hnear AS (SELECT *, count(*) over (partition by id) AS n FROM hd WHERE d <= 80),
hlost AS (SELECT id, arg_min(sid, d) AS sid, any_value(w) AS w, any_value(extra) AS extra FROM hd WHERE id NOT IN (SELECT id FROM hnear) GROUP BY 1),
hgot AS (SELECT sid, sum(w) AS h, sum(x) AS x FROM (SELECT sid, w / n AS w, extra / n AS x FROM hnear UNION ALL SELECT sid, w, extra FROM hlost) GROUP BY 1)"""


@query("dem02_demand_scenarios", "DEM-02", f"""
WITH {SPREAD_SQL}, {HOTEL_SPREAD_SQL}, t AS (SELECT f.id, coalesce(h, 0) + 5e-1 * coalesce(v, 0) AS now, coalesce(h, 0) + coalesce(x, 0) AS later FROM food f LEFT JOIN got ON got.sid = f.id LEFT JOIN hgot ON hgot.sid = f.id)
SELECT id, round(now, 5) AS now, round(later, 5) AS later, case when now > 0 then round((later - now) * 100 / now, 4) end AS change_pct FROM t""", ("agents", "food", "sites"))
def demand_scenarios(spark, folder):
    hotels = points(spark, folder, "sites").withColumns({"w": c("places") * numeric.HOTEL_PLACE_OCCUPANCY, "extra": (c("id") % 5) * 3.0})
    out = scenario.food_demand(hotels, agents_demand(spark, folder), as_sites(points(spark, folder, "food")), 80.0)
    return out.select(c("sid").alias("id"), F.round("now", 5).alias("now"), F.round("later", 5).alias("later"), F.round("change_pct", 4).alias("change_pct"))


# ---------------------------------------------------------------- allocation

RUNS = [scenario.Run("A", 0), scenario.Run("A1", 1), scenario.Run("A2", 2),
        scenario.Run("B", 0, 1000.0), scenario.Run("B1", 1, 1000.0), scenario.Run("B2", 2, 1000.0)]


def allocation_inputs(spark, folder, names=None):
    runs = [r for r in RUNS if names is None or r.name in names]
    return scenario.demand_and_capacity(points(spark, folder, "agents"), points(spark, folder, "sites"), runs)


def allocated(spark, folder, names=None):
    """The allocation of the named runs."""
    return scenario.placed(*allocation_inputs(spark, folder, names))


def main_run(spark, folder):
    return allocated(spark, folder, ["A"])


def walk_sql(runs):
    """Serving the agents one by one: free rooms of every site after each agent, as a list. Gives
    ``pairs (run, agent, sid, qty, guests, km, from_band, to_band)``."""
    names = ", ".join(f"('{r.name}', {r.seed}, {'NULL' if r.limit_m is None else r.limit_m}::DOUBLE)" for r in runs)
    return f"""
runs AS (SELECT * FROM (VALUES {names}) t(run, seed, lim)),
hs AS (SELECT id AS sid, lon, lat, band, rooms * (1 - 802e-3) AS cap, row_number() over (order by id) AS p FROM sites),
pe AS (SELECT run, lim, id AS agent, band, lon, lat, u * 383e-3 AS qty, places / u AS per, row_number() over (partition by run order by md5(concat(seed, '|', id)), id) AS n
 FROM (SELECT *, greatest(1, coalesce(case when bedrooms > 0 then bedrooms::DOUBLE end, round_even(places / 2e0, 0))) AS u FROM agents WHERE band IS NOT NULL), runs),
cand AS (SELECT run, lim, n, p, sid, case when hs.band >= pe.band then hs.band - pe.band else 3 + pe.band - hs.band end AS step, {metres('pe', 'hs')} AS d FROM pe, hs),
ranked AS (SELECT *, row_number() over (partition by run, n order by case when lim is null then step else step * 1e3 + d / 1e3 + case when d > lim then 1e4 else 0 end end,
 case when lim is null then d else 0 end, sid) AS i FROM cand),
pref AS MATERIALIZED (SELECT run, n, any_value(qty) AS qty, list(p::USMALLINT order by i) AS ord FROM ranked JOIN pe USING (run, n) GROUP BY 1, 2),
walk AS (
 SELECT run, 0::BIGINT AS n, (SELECT list(cap order by p) FROM hs) AS caps, []::DOUBLE[] AS took FROM runs
 UNION ALL
 SELECT run, n, list_transform(caps, lambda x, j: x - took[list_position(ord, j)]), took FROM (
  SELECT run, n, caps, ord, list_transform(list_transform(free, lambda x, k: greatest(0, least(x, qty - coalesce(list_sum(free[1:k - 1]), 0)))), lambda t: case when t > 1e-9 then t else 0 end) AS took FROM (
   SELECT w.run, a.n, w.caps, a.qty, a.ord, list_transform(a.ord, lambda q: w.caps[q]) AS free FROM walk w JOIN pref a ON a.run = w.run AND a.n = w.n + 1))),
taken AS (SELECT run, n, unnest(took) AS qty, generate_subscripts(took, 1) AS i FROM walk),
rest AS (SELECT run, n, pe.qty - list_sum(took) AS qty FROM walk JOIN pe USING (run, n)),
pairs AS (
 SELECT run, agent, r.sid, t.qty, t.qty * per AS guests, r.d / 1e3 AS km, pe.band AS from_band, hs.band AS to_band FROM taken t JOIN ranked r USING (run, n, i) JOIN pe USING (run, n) JOIN hs USING (p) WHERE t.qty > 0
 UNION ALL SELECT run, agent, NULL, rest.qty, rest.qty * per, NULL, band, NULL FROM rest JOIN pe USING (run, n) WHERE rest.qty > 1e-9)"""


WALK_A, WALK_ALL = walk_sql(RUNS[:1]), walk_sql(RUNS)
SUMMARY_SQL = """
part AS (SELECT *, to_band - from_band AS jump FROM pairs WHERE sid IS NOT NULL),
cum AS (SELECT run, km, sum(guests) over (partition by run order by km) AS c, sum(guests) over (partition by run) AS t FROM part),
mid AS (SELECT run, min(km) FILTER (c >= 0.5 * t) AS median_km, min(km) FILTER (c >= 0.9 * t) AS p90_km FROM cum GROUP BY 1),
sums AS (SELECT run, sum(guests) AS placed, sum(case when jump = 0 then guests else 0 end) * 100 / sum(guests) AS own_band_pct, sum(case when jump = 1 then guests else 0 end) * 100 / sum(guests) AS one_up_pct,
 sum(case when jump >= 2 then guests else 0 end) * 100 / sum(guests) AS two_up_pct, sum(case when jump < 0 then guests else 0 end) * 100 / sum(guests) AS cheaper_pct,
 sum(case when km > 2 then guests else 0 end) * 100 / sum(guests) AS far_pct, sum(guests * km) / sum(guests) AS mean_km, max(km) AS longest_km, count(DISTINCT sid) AS sites_used FROM part GROUP BY 1),
summary AS (SELECT sums.*, coalesce((SELECT sum(guests) FROM pairs q WHERE q.run = sums.run AND sid IS NULL), 0) AS unplaced, median_km, p90_km FROM sums JOIN mid USING (run))"""
FIGURES = ("placed", "unplaced", "own_band_pct", "one_up_pct", "two_up_pct", "cheaper_pct", "far_pct", "mean_km", "longest_km", "median_km", "p90_km")


def rounded(rows, names, places=6):
    return rows.withColumns({n: F.round(n, places) for n in names})


def rounded_sql(names, places=6):
    return ", ".join(f"round({n}, {places}) AS {n}" for n in names)


@query("alc01_allocation", "ALC-01", f"""
WITH RECURSIVE {WALK_A} SELECT run, agent, sid, {rounded_sql(('qty', 'guests', 'km'))}, from_band, to_band FROM pairs""", ("agents", "sites"))
def allocation_pairs(spark, folder):
    return rounded(main_run(spark, folder), ("qty", "guests", "km"))


@query("alc01_conservation", "ALC-01 DQ-05", f"""
WITH RECURSIVE {WALK_ALL}, used AS (SELECT run, sid, sum(qty) AS used FROM pairs WHERE sid IS NOT NULL GROUP BY 1, 2)
SELECT run, (SELECT round(sum(qty), 4) FROM pe WHERE pe.run = runs.run) AS asked, (SELECT round(sum(qty), 4) FROM pairs WHERE pairs.run = runs.run) AS given,
 (SELECT count(*) FROM used JOIN hs USING (sid) WHERE used.run = runs.run AND used > cap - 1e-6) AS full_sites,
 (SELECT count(*) FROM used JOIN hs USING (sid) WHERE used.run = runs.run AND used > cap + 1e-6) AS overfull_sites FROM runs""", ("agents", "sites"))
def conservation(spark, folder):
    agents, sites = allocation_inputs(spark, folder)
    pairs = durable(allocated(spark, folder))
    asked = agents.filter("band is not null").groupBy("run").agg(F.round(F.sum("qty"), 4).alias("asked"))
    given = pairs.groupBy("run").agg(F.round(F.sum("qty"), 4).alias("given"))
    used = pairs.filter("sid is not null").groupBy("run", "sid").agg(F.sum("qty").alias("used")).join(sites, ["run", "sid"])
    counts = used.groupBy("run").agg(
        F.count(F.when(c("used") > c("cap") - 1e-6, 1)).alias("full_sites"), F.count(F.when(c("used") > c("cap") + 1e-6, 1)).alias("overfull_sites"))
    return asked.join(given, "run").join(counts, "run")


@query("alc02_summary", "ALC-02 AG-11 AG-12", f"""
WITH RECURSIVE {WALK_A}, {SUMMARY_SQL} SELECT run, sites_used, {rounded_sql(FIGURES)} FROM summary""", ("agents", "sites"))
def allocation_summary(spark, folder):
    return rounded(scenario.summary(durable(main_run(spark, folder))), FIGURES)


@query("alc02_band_matrix", "ALC-02 AG-04 AR-01", f"""
WITH RECURSIVE {WALK_A}, b AS (SELECT unnest([0, 1, 2, 3]) AS x) SELECT 'A' AS run, f.x AS from_band, t.x AS to_band,
 round(coalesce((SELECT sum(guests) FROM pairs WHERE sid IS NOT NULL AND from_band = f.x AND to_band = t.x), 0), 6) AS guests FROM b f, b t""", ("agents", "sites"))
def band_matrix(spark, folder):
    return rounded(scenario.band_matrix(main_run(spark, folder)), ("guests",))


@query("alc02_distance_buckets", "BIN-03 ALC-02", f"""
WITH RECURSIVE {WALK_A}, b AS (SELECT unnest([0, 0.25, 0.5, 1, 2, 5])::DOUBLE AS since, unnest([0.25, 0.5, 1, 2, 5, NULL])::DOUBLE AS until)
SELECT since, until, round(coalesce((SELECT sum(guests) FROM pairs WHERE km >= since AND (until IS NULL OR km < until)), 0) * 100 / (SELECT sum(guests) FROM pairs WHERE sid IS NOT NULL), 6) AS pct FROM b""", ("agents", "sites"))
def distance_buckets(spark, folder):
    inside = main_run(spark, folder).filter("sid is not null")
    return rounded(bins.bucket_shares(inside, c("km"), c("guests"), [0, 0.25, 0.5, 1, 2, 5]), ("pct",))


SPREADS = ("median_km_min", "median_km_max", "own_band_min", "own_band_max")


@query("alc03_seed_sensitivity", "ALC-03", f"""
WITH RECURSIVE {WALK_ALL}, {SUMMARY_SQL} SELECT substr(run, 1, 1) AS variant, round(min(median_km), 6) AS median_km_min, round(max(median_km), 6) AS median_km_max,
 round(min(own_band_pct), 6) AS own_band_min, round(max(own_band_pct), 6) AS own_band_max FROM summary GROUP BY 1""", ("agents", "sites"))
def seed_sensitivity(spark, folder):
    return rounded(scenario.sensitivity(scenario.summary(durable(allocated(spark, folder))), F.substring("run", 1, 1)), SPREADS)


@query("alc05_absorbed_by_site", "ALC-05", f"""
WITH RECURSIVE {WALK_A} SELECT 'A' AS run, hs.sid, round(coalesce(sum(qty), 0), 6) AS rooms, round(coalesce(sum(guests), 0), 6) AS guests, count(DISTINCT agent) AS dwellings
FROM hs LEFT JOIN pairs ON pairs.sid = hs.sid GROUP BY 2""", ("agents", "sites"))
def absorbed_by_site(spark, folder):
    _, sites = allocation_inputs(spark, folder, ["A"])
    return rounded(scenario.absorbed(main_run(spark, folder), sites), ("rooms", "guests"))


@query("alc06_area_balance", "ALC-06", f"""
WITH RECURSIVE {WALK_A}, h AS (SELECT area, sum(places) * 679e-3 AS hotel FROM sites GROUP BY 1), f AS (SELECT area, sum(places) * 383e-3 AS flat FROM agents GROUP BY 1),
l AS (SELECT area, sum(guests) AS leaving FROM pairs JOIN agents ON agents.id = agent WHERE sid IS NOT NULL GROUP BY 1), r AS (SELECT area, sum(guests) AS arriving FROM pairs JOIN sites ON sites.id = sid GROUP BY 1),
a AS (SELECT area, coalesce(hotel, 0) AS hotel, coalesce(flat, 0) AS flat, coalesce(leaving, 0) AS leaving, coalesce(arriving, 0) AS arriving FROM h FULL JOIN f USING (area) FULL JOIN l USING (area) FULL JOIN r USING (area))
SELECT area, round(hotel + flat, 6) AS now, round(hotel + arriving, 6) AS later, round(leaving, 6) AS leaving, round(arriving, 6) AS arriving, round(arriving - leaving, 6) AS net,
 round((hotel + arriving - hotel - flat) * 100 / nullif(hotel + flat, 0), 3) AS change_pct FROM a""", ("agents", "sites"))
def area_balance(spark, folder):
    agents, sites = standin(spark, folder, "agents"), standin(spark, folder, "sites")
    hotel = sites.groupBy("area").agg((F.sum("places") * numeric.HOTEL_PLACE_OCCUPANCY).alias("hotel"))
    flat = agents.groupBy("area").agg((F.sum("places") * numeric.DWELLING_OCCUPANCY).alias("flat"))
    out = scenario.area_balance(
        durable(main_run(spark, folder)), agents.select(c("id").alias("agent"), "area"), sites.select(c("id").alias("sid"), "area"),
        hotel.join(flat, "area", "full_outer"))
    return rounded(rounded(out, ("now", "later", "leaving", "arriving", "net")), ("change_pct",), 3)


ALLOC_INPUT_SQL = """
ag AS (SELECT *, greatest(1, coalesce(case when bedrooms > 0 then bedrooms::DOUBLE end, round_even(places / 2e0, 0))) AS u FROM agents)"""


@query("alc04_supply_and_demand", "ALC-04", f"""
WITH {ALLOC_INPUT_SQL}, f AS (SELECT band, sum(rooms) * (1 - 802e-3) AS free FROM sites GROUP BY 1), q AS (SELECT band, sum(u) * 383e-3 AS asked FROM ag GROUP BY 1)
SELECT coalesce(f.band, q.band) AS band, round(coalesce(free, 0), 4) AS free, round(coalesce(asked, 0), 4) AS asked FROM f FULL JOIN q ON f.band = q.band""", ("agents", "sites"))
def supply_and_demand(spark, folder):
    out = scenario.supply_and_demand(*[t.filter(c("run") == "A") for t in allocation_inputs(spark, folder)])
    return out.select("band", F.round("free", 4).alias("free"), F.round("asked", 4).alias("asked"))
