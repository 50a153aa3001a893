"""Composite jobs: areas, prices, preparation, official totals, data quality."""

from pyspark.sql import functions as F

from hostelry.functions import numeric, text
from hostelry.operators import bins, quality, series
from hostelry.plans import areas, preparation, pricing, scenario
from hostelry.registry.core import query
from hostelry.registry.fixtures import read, standin
from hostelry.registry.link_queries import MONTHLY_SQL, monthly
from hostelry.registry.row_queries import FUNNEL_STEPS, ORDERS_SQL, order_reasons
from hostelry.operators import funnel
from hostelry.registry.spatial_queries import (
    HOTEL_SPREAD_SQL, SPREAD_SQL, WALK_A, agents_demand, allocation_inputs, as_sites, main_run, points, rounded,
)
from hostelry.session import durable

c = F.col

DW_SQL = "dw AS (SELECT *, place_price * places AS stay_price, greatest(0, least(365, 365 - availability)) AS nights FROM agents)"
FOOD_SQL = f"""{SPREAD_SQL}, {HOTEL_SPREAD_SQL},
fd AS (SELECT f.*, coalesce(h, 0) + 5e-1 * coalesce(v, 0) AS now, coalesce(h, 0) + coalesce(x, 0) AS later FROM food f LEFT JOIN got ON got.sid = f.id LEFT JOIN hgot ON hgot.sid = f.id),
fdh AS (SELECT *, now >= (SELECT quantile_cont(now, 0.8) FROM fd WHERE now > 0) AS high FROM fd)"""


def dwellings(spark, folder):
    return standin(spark, folder, "agents").select(
        "id", "area", "host_id", "host_name", "places", "place_price", (c("place_price") * c("places")).alias("price"),
        numeric.occupied_nights(c("availability")).alias("nights"))


def hotels(spark, folder):
    rows = standin(spark, folder, "sites")
    return rows.withColumn("owner", text.company(c("owner")))


def food_with_demand(spark, folder):
    sites = points(spark, folder, "sites").withColumns({"w": c("places") * numeric.HOTEL_PLACE_OCCUPANCY, "extra": (c("id") % 5) * 3.0})
    food = points(spark, folder, "food")
    demand = scenario.food_demand(sites, agents_demand(spark, folder), as_sites(food), 80.0)
    out = standin(spark, folder, "food").join(demand, c("id") == c("sid"))
    return bins.top_share_flag(out, "now", 0.8, "high").withColumn("brand", text.brand(c("name")))


def mode_sql(table: str, value: str, out: str, n: str, minimum: int, where: str = "true") -> str:
    return (f"(SELECT area, {out}, {n} FROM (SELECT area, {value} AS {out}, count(*) AS {n}, row_number() over (partition by area order by count(*) desc, {value}) AS rn"
            f" FROM {table} WHERE {value} IS NOT NULL AND {where} GROUP BY area, {value}) WHERE rn = 1 AND {n} >= {minimum})")


OWNER = "case when lower(trim(owner)) <> 'no aplica' then upper(trim(regexp_replace(owner, '\\(.*?\\)', '', 'g'), ' .,')) end"


@query("kpi01_area_facts", "KPI-01 AG-13", f"""
WITH {FOOD_SQL}, {DW_SQL}, ho AS (SELECT *, {OWNER} AS own FROM sites), fb AS (SELECT *, upper(name) AS b FROM food),
dd AS (SELECT area, count(*) AS dwellings, sum(places)::BIGINT AS dwelling_places, avg(place_price) AS place_price, median(place_price) AS mp, median(stay_price) AS median_price, sum(coalesce(stay_price * nights, 0)) AS revenue_low, sum(coalesce(stay_price, 0)) * 365 * 48e-2 AS revenue_high FROM dw GROUP BY 1),
hh AS (SELECT area, count(*) AS hotels, sum(places)::BIGINT AS hotel_places, sum(rooms)::BIGINT AS hotel_rooms FROM ho GROUP BY 1),
ff AS (SELECT area, count(*) AS food_sites, sum(high::INT)::BIGINT AS high, sum(now) AS demand_now, sum(later) AS demand_later FROM fdh GROUP BY 1),
aa AS (SELECT DISTINCT area FROM (SELECT area FROM dd UNION ALL SELECT area FROM hh UNION ALL SELECT area FROM ff))
SELECT aa.area, coalesce(dwellings, 0) AS dwellings, coalesce(dwelling_places, 0) AS dwelling_places, round(place_price, 3) AS place_price, round(median_price, 3) AS median_price,
 case when mp is null then null when round(mp, 1) < 40 then '€' when round(mp, 1) < 70 then '€€' when round(mp, 1) < 120 then '€€€' else '€€€€' end AS dwelling_band,
 round(coalesce(revenue_low, 0), 2) AS revenue_low, round(coalesce(revenue_high, 0), 2) AS revenue_high, coalesce(hotels, 0) AS hotels, coalesce(hotel_places, 0) AS hotel_places, coalesce(hotel_rooms, 0) AS hotel_rooms,
 coalesce(food_sites, 0) AS food_sites, coalesce(high, 0) AS high, round(coalesce(demand_now, 0), 6) AS demand_now, round(coalesce(demand_later, 0), 6) AS demand_later, hotel_band, main_brand, brand_sites, hotel_operator, hotel_operator_n, host, host_n,
 round(coalesce(dwelling_places, 0) * 383e-3, 4) AS dwelling_guests_low, round(coalesce(hotel_places, 0) * 679e-3, 4) AS hotel_guests
FROM aa LEFT JOIN dd USING (area) LEFT JOIN hh USING (area) LEFT JOIN ff USING (area) LEFT JOIN {mode_sql('sites', 'band', 'hotel_band', 'z1', 1)} USING (area)
 LEFT JOIN {mode_sql('fb', 'b', 'main_brand', 'brand_sites', 2)} USING (area) LEFT JOIN {mode_sql('ho', 'own', 'hotel_operator', 'hotel_operator_n', 2)} USING (area)
 LEFT JOIN {mode_sql('agents', 'host_name', 'host', 'host_n', 3)} USING (area)""", ("agents", "sites", "food"))
def area_facts(spark, folder):
    out = areas.area_facts(dwellings(spark, folder), hotels(spark, folder), food_with_demand(spark, folder), host_min=3)
    r = {k: F.round(k, 3) for k in ("place_price", "median_price")} | {k: F.round(k, 2) for k in ("revenue_low", "revenue_high")}
    r |= {k: F.round(k, 4) for k in ("dwelling_guests_low", "hotel_guests")} | {k: F.round(k, 6) for k in ("demand_now", "demand_later")}
    return out.withColumns(r).drop("dwelling_guests_high")


@query("kpi02_dashboard", "KPI-02 MA-04 MA-05", f"""
WITH {DW_SQL}, b AS (SELECT *, case when place_price < 40 then 0 when place_price < 70 then 1 when place_price < 120 then 2 when place_price is not null then 3 end AS pb FROM dw)
SELECT (SELECT count(*) FROM dw) AS dwellings, (SELECT count(*) FROM b WHERE pb = 0) AS dwellings_band_0, (SELECT count(*) FROM b WHERE pb = 3) AS dwellings_band_3, (SELECT count(*) FROM b WHERE pb IS NULL) AS dwellings_no_band,
 (SELECT round(sum(coalesce(stay_price * nights, 0)), 2) FROM dw) AS revenue_low, (SELECT round(sum(coalesce(stay_price, 0)) * 365 * 48e-2, 2) FROM dw) AS revenue_high,
 (SELECT sum(rooms)::BIGINT FROM sites) AS hotel_rooms, (SELECT count(*) FROM sites WHERE band = 1) AS hotels_band_1, (SELECT round(sum(places) * 679e-3, 4) FROM sites) AS hotel_guests_now,
 (SELECT round((sum(rooms) * 802e-3 + 500) * 100 / sum(rooms), 4) FROM sites) AS occupancy_later""", ("agents", "sites"))
def dashboard(spark, folder):
    out = areas.dashboard(dwellings(spark, folder), hotels(spark, folder), 900.0, 500.0)
    r = {"revenue_low": F.round("revenue_low", 2), "revenue_high": F.round("revenue_high", 2), "hotel_guests_now": F.round("hotel_guests_now", 4),
         "occupancy_later": F.round("occupancy_later", 4)}
    return out.withColumns(r).select("dwellings", "dwellings_band_0", "dwellings_band_3", "dwellings_no_band", "revenue_low", "revenue_high",
                                     "hotel_rooms", "hotels_band_1", "hotel_guests_now", "occupancy_later")


@query("kpi02_leaders", "KPI-02 MSK-02 STR-17", f"""
(SELECT 'owner' AS kind, own AS name, count(*) AS n, sum(places)::BIGINT AS places FROM (SELECT *, {OWNER} AS own FROM sites) WHERE own IS NOT NULL GROUP BY own ORDER BY n DESC, places DESC, name LIMIT 5)
UNION ALL (SELECT 'host', min(host_name), count(*), sum(places)::BIGINT FROM agents GROUP BY host_id HAVING count(*) >= 10 ORDER BY count(*) DESC, host_id LIMIT 5)""", ("agents", "sites"))
def leaders(spark, folder):
    owners = areas.leading_owners(hotels(spark, folder)).select(F.lit("owner").alias("kind"), c("owner").alias("name"), "n", "places")
    hosts = areas.leading_hosts(dwellings(spark, folder), 10).select(F.lit("host").alias("kind"), "name", "n", c("capacity").alias("places"))
    return owners.unionByName(hosts)


@query("kpi03_sites_by_category", "KPI-03 AG-32", "SELECT coalesce(category, 'Sin categoria') AS category, count(*) AS hotels, sum(rooms)::BIGINT AS rooms FROM sites GROUP BY 1", ("sites",))
def sites_by_category(spark, folder):
    return areas.sites_by_category(standin(spark, folder, "sites"))


@query("kpi03_occupancy_by_band", "KPI-03", f"""
WITH RECURSIVE {WALK_A}, b AS (SELECT unnest([0, 1, 2, 3]) AS band), r AS (SELECT b.band, coalesce(sum(rooms), 0)::BIGINT AS rooms FROM b LEFT JOIN sites USING (band) GROUP BY 1)
SELECT band, rooms, round(rooms * 802e-3, 6) AS now, round(rooms * 802e-3 + coalesce((SELECT sum(qty) FROM pairs WHERE sid IS NOT NULL AND to_band = r.band), 0), 6) AS later FROM r""", ("agents", "sites"))
def occupancy_by_band(spark, folder):
    _, sites = allocation_inputs(spark, folder, ["A"])
    got = scenario.absorbed(main_run(spark, folder), sites)
    return rounded(areas.occupancy_by_band(standin(spark, folder, "sites"), got), ("now", "later"))


@query("kpi03_area_growth", "KPI-03", """
SELECT area, count(*) AS hotels, sum(rooms)::BIGINT AS rooms, round(sum(places) * 679e-3, 4) AS now, round(sum(id % 5 * 3e0), 4) AS new, round(sum(id % 5 * 3e0) * 100 / (sum(places) * 679e-3), 4) AS more_pct FROM sites GROUP BY 1""", ("sites",))
def area_growth(spark, folder):
    rows = standin(spark, folder, "sites")
    out = areas.area_growth(rows, rows.select(c("id").alias("sid"), ((c("id") % 5) * 3.0).alias("guests")))
    return out.withColumns({k: F.round(k, 4) for k in ("now", "new", "more_pct")})


@query("kpi04_food_brands", "KPI-04 STR-16", f"""
WITH {FOOD_SQL} SELECT upper(name) AS brand, count(*) AS sites, round(sum(now), 6) AS now, round(sum(later), 6) AS later, round((sum(later) - sum(now)) * 100 / sum(now), 3) AS change_pct FROM fd GROUP BY 1 ORDER BY sites DESC, brand LIMIT 10""", ("agents", "sites", "food"))
def food_brands(spark, folder):
    out = areas.brand_table(food_with_demand(spark, folder))
    return out.withColumns({"now": F.round("now", 6), "later": F.round("later", 6), "change_pct": F.round("change_pct", 3)})


@query("kpi04_food_totals", "KPI-04", f"""
WITH {FOOD_SQL} SELECT count(*) AS sites, count(*) FILTER (now > 0) AS with_guests, round(sum(now), 3) AS now, round(sum(later), 3) AS later, count(*) FILTER (later > now) AS gain, count(*) FILTER (later < now) AS lose FROM fd""", ("agents", "sites", "food"))
def food_totals(spark, folder):
    return areas.food_totals(food_with_demand(spark, folder)).withColumns({"now": F.round("now", 3), "later": F.round("later", 3)})


@query("kpi04_biggest_gains", "KPI-04 WD-07", f"""
WITH {FOOD_SQL}, ba AS (SELECT area, round(round(sum(later), 6) - round(sum(now), 6), 6) AS gain FROM fd GROUP BY area)
(SELECT 'most' AS side, area, gain FROM ba ORDER BY gain DESC, area LIMIT 5) UNION ALL (SELECT 'least', area, gain FROM ba ORDER BY gain, area LIMIT 5)""", ("agents", "sites", "food"))
def biggest_gains(spark, folder):
    # sums are rounded before they are ranked, so that equal areas tie in both engines
    by_area = food_with_demand(spark, folder).groupBy("area").agg(
        F.lit(0.0).alias("now"), F.round(F.round(F.sum("later"), 6) - F.round(F.sum("now"), 6), 6).alias("later"))
    most = areas.biggest_gains(by_area, "area").select(F.lit("most").alias("side"), "area", "gain")
    return most.unionByName(areas.biggest_gains(by_area, "area", losing=True).select(F.lit("least").alias("side"), "area", "gain"))


@query("kpi06_against_official", "KPI-06 MA-05", """
SELECT round((SELECT sum(places) FROM sites) * 679e-3, 4) AS hotel_night, round((SELECT sum(places) FROM sites) * 679e-3 * 365, 2) AS hotel_nights_year, round((SELECT sum(places) FROM agents) * 383e-3 * 365 / 3, 2) AS flat_guests_year,
 round((SELECT sum(places) FROM sites) * 679e-3 * 365 / (sum(l_quantity) / count(*)), 2) AS hotel_guests_equivalent, round(((SELECT sum(places) FROM sites) * 679e-3 / (sum(l_quantity) / 365) - 1) * 100, 4) AS gap_pct FROM lineitem""", ("agents", "sites"))
def against_official(spark, folder):
    official = read(spark, folder, "lineitem").agg(
        (F.sum("l_quantity") / F.count("*")).alias("mean_stay"), (F.sum("l_quantity") / 365).alias("nights_per_day"))
    out = areas.against_official(standin(spark, folder, "agents"), standin(spark, folder, "sites"), official)
    return out.select(F.round("hotel_night", 4).alias("hotel_night"), F.round("hotel_nights_year", 2).alias("hotel_nights_year"),
                      F.round("flat_guests_year", 2).alias("flat_guests_year"), F.round("hotel_guests_equivalent", 2).alias("hotel_guests_equivalent"),
                      F.round("gap_pct", 4).alias("gap_pct"))


# ---------------------------------------------------------------- prices

ADR_SQL = f"""{MONTHLY_SQL}, adr AS (SELECT case category when 'A' then '5 gold stars' when 'N' then '4 gold stars' else '1 and 2 gold stars and silver stars' end AS official, round(avg(adr) / 200, 2) AS adr FROM monthly
 WHERE month_start >= (SELECT max(month_start) FROM monthly) - INTERVAL 11 MONTH GROUP BY category),
st AS (SELECT *, case category when '5 estrelles' then '5 gold stars' when '4 estrelles superior' then '4 gold stars' when '4 estrelles' then '4 gold stars' when '3 estrelles' then '3 gold stars' when '1 estrella' then '1 and 2 gold stars and silver stars'
  else case when kind = 'apartament_turistic' or category = 'Sense categoritzar' then null else '1 and 2 gold stars and silver stars' end end AS official FROM sites),
pr AS (SELECT official, median(places / rooms) AS ppr FROM st GROUP BY 1),
pl AS (SELECT st.id, st.official, adr, case when adr < 100 then '€' when adr < 175 then '€€' when adr < 300 then '€€€' when adr is not null then '€€€€' end AS room_band, round(adr / ppr, 2) AS place_price FROM st LEFT JOIN adr USING (official) LEFT JOIN pr USING (official))"""


def category_averages(spark, folder):
    names = F.expr("case category when 'A' then '5 gold stars' when 'N' then '4 gold stars' else '1 and 2 gold stars and silver stars' end")
    return series.trailing_mean(monthly(spark, folder), "category", "month_start", "adr").select(
        names.alias("official"), F.round(c("adr") / 200, 2).alias("adr"))


@query("prc01_category_prices", "PRC-01 BIN-01", f"""
WITH {ADR_SQL} SELECT id, official, adr, room_band, place_price, case when place_price < 40 then '€' when place_price < 70 then '€€' when place_price < 120 then '€€€' when place_price is not null then '€€€€' end AS place_band FROM pl""", ("sites",))
def category_prices(spark, folder):
    out = pricing.price_lodgings(standin(spark, folder, "sites"), category_averages(spark, folder))
    return out.select("id", "official", "adr", "room_band", "place_price", "place_band")


@query("prc02_two_populations", "PRC-02", """
WITH p AS (SELECT 'a' AS k, place_price AS p FROM agents WHERE place_price IS NOT NULL UNION ALL SELECT 'b', rooms * 1.5e0 FROM sites), b AS (SELECT unnest(['€','€€','€€€','€€€€']) AS band),
n AS (SELECT k, case when p < 40 then '€' when p < 70 then '€€' when p < 120 then '€€€' else '€€€€' end AS band FROM p)
SELECT b.band, round((SELECT count(*) FROM n WHERE k = 'a' AND n.band = b.band) * 100e0 / (SELECT count(*) FROM n WHERE k = 'a'), 1) AS dwellings, round((SELECT count(*) FROM n WHERE k = 'b' AND n.band = b.band) * 100e0 / (SELECT count(*) FROM n WHERE k = 'b'), 1) AS hotels FROM b""", ("agents", "sites"))
def two_populations(spark, folder):
    b = standin(spark, folder, "sites").select((c("rooms") * 1.5).alias("place_price"))
    return pricing.compare_populations(standin(spark, folder, "agents"), b, "place_price", ("dwellings", "hotels"))


@query("prc02_median_position", "PRC-02", """
SELECT (SELECT median(rooms * 1.5e0) FROM sites) AS median_a, round(median(place_price), 4) AS median_b, round(avg((place_price < (SELECT median(rooms * 1.5e0) FROM sites))::INT), 6) AS below FROM agents WHERE place_price IS NOT NULL""", ("agents", "sites"))
def median_position(spark, folder):
    a = standin(spark, folder, "sites").select((c("rooms") * 1.5).alias("place_price"))
    return pricing.median_position(a, standin(spark, folder, "agents"), "place_price").select(
        "median_a", F.round("median_b", 4).alias("median_b"), F.round("below", 6).alias("below"))


@query("ma03_annual_place_price", "MA-03 AG-07", f"""
WITH {MONTHLY_SQL}, r AS (SELECT category, month(month_start) AS month, adr / avg(adr) over (partition by category, year(month_start)) AS x FROM monthly WHERE year(month_start) >= 1997),
fa AS (SELECT avg(f) AS f FROM (SELECT median(x) AS f FROM r WHERE month = 6 GROUP BY category))
SELECT area, count(place_price) AS priced, round(sum(place_price / (SELECT f FROM fa)), 1) AS annual FROM agents GROUP BY 1""", ("agents",))
def annual_place_price(spark, folder):
    factors = series.seasonality(monthly(spark, folder), "category", "month_start", "adr", 1997)
    rows = pricing.annual_place_price(standin(spark, folder, "agents").withColumn("place_price", c("place_price") * 1e6), "place_price", factors, 6)
    return rows.groupBy("area").agg(F.count("place_price").alias("priced"), F.round(F.sum(c("annual_price") / 1e6), 1).alias("annual"))


@query("ma02_log_target", "MA-02", "SELECT c_mktsegment AS segment, round(avg(ln(1 + abs(c_acctbal))), 6) AS mean_log, round(exp(avg(ln(1 + abs(c_acctbal)))) - 1, 4) AS back FROM customer GROUP BY 1")
def log_target(spark, folder):
    mean = F.avg(F.log1p(F.abs("c_acctbal")))
    return read(spark, folder, "customer").groupBy(c("c_mktsegment").alias("segment")).agg(
        F.round(mean, 6).alias("mean_log"), F.round(F.expm1(mean), 4).alias("back"))


@query("ma01_half_even_rounding", "MA-01", "SELECT round_even(l_quantity / 4, 0) AS rounded, count(*) AS rows FROM lineitem GROUP BY 1")
def half_even_rounding(spark, folder):
    return read(spark, folder, "lineitem").groupBy(F.bround(c("l_quantity") / 4, 0).alias("rounded")).agg(F.count("*").alias("rows"))


@query("ma04_revenue_range", "MA-04 DT-06", f"WITH {DW_SQL} SELECT area, round(sum(coalesce(stay_price * nights, 0)), 2) AS low, round(sum(coalesce(stay_price, 0)) * 365 * 48e-2, 2) AS high FROM dw GROUP BY 1", ("agents",))
def revenue_range(spark, folder):
    return dwellings(spark, folder).groupBy("area").agg(
        F.round(F.sum(F.coalesce(c("price") * c("nights"), F.lit(0.0))), 2).alias("low"),
        F.round(F.sum(F.coalesce("price", F.lit(0.0))) * 365 * numeric.DWELLING_OCCUPANCY_HIGH, 2).alias("high"))


# ---------------------------------------------------------------- preparation

@query("reg01_establishments", "REG-01 WD-05 STR-15 GEO-01", f"""
WITH {ADR_SQL} SELECT s.id, case s.category when '5 estrelles' then 5e0 when '4 estrelles superior' then 4.5e0 when '4 estrelles' then 4e0 when '3 estrelles' then 3e0 when '1 estrella' then 1e0 end AS stars,
 case when s.category like '%estrell%' then 'hotel_stars' when kind = 'apartament_turistic' or s.category = 'Sense categoritzar' then 'apartments' else 'no_stars' end AS lodging,
 false AS in_chain, pl.official, pl.adr, count(*) over (partition by s.area % 4, rooms % 9) > 1 AS probable_duplicate FROM sites s JOIN pl USING (id)""", ("sites",))
def establishments(spark, folder):
    rows = standin(spark, folder, "sites").withColumns({
        "name": F.concat(F.lit("Casa "), (c("area") % 4).cast("string")), "road_name": F.lit("Major"), "number": c("rooms") % 9})
    out = preparation.establishments(rows, category_averages(spark, folder), (41.387, 2.17))
    return out.select("id", "stars", "lodging", "in_chain", "official", "adr", "probable_duplicate")


_FLAT = "sqrt(pow((a.lat-b.lat)*111320e0,2) + pow((a.lon-b.lon)*(111320e0*cos(radians(4139e-2))),2))"


@query("reg02_food_sites", "REG-02 STR-18 STR-19 STR-20 WD-03 SJ-06", f"""
WITH RECURSIVE r AS (SELECT cast(id as varchar) AS id, case when id % 40 <> 0 then name end AS name, lat, lon, visited, id % 9 <> 0 AS identified, id % 300 AS street,
  case kind when 'ECONOMY' then 'bar' when 'SMALL' then 'restaurant' else 'fast' end AS site_type FROM food WHERE kind IN ('ECONOMY', 'SMALL', 'PROMO')),
l AS (SELECT * FROM (SELECT *, row_number() over (partition by identified, case when not identified then id end, name, street, site_type order by visited desc, id desc) AS k FROM r)
 WHERE k = 1 OR NOT identified),
e AS (SELECT a.id AS a, b.id AS b FROM l a JOIN l b ON a.name = b.name AND (a.visited > b.visited OR (a.visited = b.visited AND a.id > b.id)) AND {_FLAT} <= 10),
ord AS (SELECT id, row_number() over (order by visited desc, id desc) AS i FROM l WHERE id IN (SELECT a FROM e UNION SELECT b FROM e)),
walk(i, dropped) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL
 SELECT w.i + 1, case when exists (SELECT 1 FROM e JOIN ord o ON o.id = e.b WHERE o.i = w.i + 1 AND NOT list_contains(w.dropped, e.a))
  then list_append(w.dropped, (SELECT id FROM ord WHERE ord.i = w.i + 1)) else w.dropped end FROM walk w WHERE w.i < (SELECT count(*) FROM ord))
SELECT site_type, count(*) AS sites, count(name) AS named FROM l WHERE id NOT IN (SELECT unnest(dropped) FROM (SELECT dropped FROM walk ORDER BY i DESC LIMIT 1)) GROUP BY 1""", ("food",))
def food_sites(spark, folder):
    rows = standin(spark, folder, "food").withColumns({
        "address": F.concat(F.lit("Street "), (c("id") % 300).cast("string"), F.when(c("id") % 9 == 0, " LOC NA").otherwise(" LOC 1")),
        "name": F.when(c("id") % 40 == 0, "SN").otherwise(c("name"))})
    out = preparation.food_sites(rows, "kind", {"econ": "bar", "small": "restaurant", "promo": "fast"})
    return out.groupBy("site_type").agg(F.count("*").alias("sites"), F.count("name").alias("named"))


# ---------------------------------------------------------------- documents

@query("js01_funnel_document", "JS-01 SNK-02", f"""
WITH {ORDERS_SQL}, s AS (SELECT unnest([1,2,3,4,5]) AS i, unnest(['open','low_priority','too_old','duplicate','small']) AS step),
g AS (SELECT i, s.step, count(f.id) AS dropped FROM s LEFT JOIN f ON f.reason = s.step GROUP BY 1, 2)
SELECT replace(to_json({{'start': (SELECT count(*) FROM f), 'steps': (SELECT list({{'step': step, 'dropped': dropped}} order by i) FROM g)}})::VARCHAR, ' ', '') AS document""")
def funnel_document(spark, folder):
    from hostelry.sources.writers import json_document

    lines = funnel.funnel(order_reasons(spark, folder), FUNNEL_STEPS, "reason", "amount")
    doc = lines.agg(
        F.max(c("dropped") + c("remaining")).alias("start"),
        F.array_sort(F.collect_list(F.struct("step_no", "step", "dropped"))).alias("steps"))
    steps = F.transform("steps", lambda s: F.struct(s["step"].alias("step"), s["dropped"].alias("dropped")))
    return json_document(doc.select("start", steps.alias("steps")), "document")


# ---------------------------------------------------------------- data quality

def _counted(name, sql):
    return f"SELECT '{name}' AS \"check\", n = 0 AS ok, n::VARCHAR AS observed, '0' AS expected FROM (SELECT count(*) AS n FROM ({sql}))"


def _compared(name, observed, expected):
    return f"SELECT '{name}', a = b, a::VARCHAR, b::VARCHAR FROM (SELECT ({observed}) AS a, ({expected}) AS b)"


_SHIFTED = "SELECT case when s_suppkey % 2 = 0 then s_suppkey end AS x, case when s_suppkey % 2 = 1 then s_suppkey end AS y FROM supplier"
_GAPS = "SELECT {0} FROM (SELECT {0}, 1 AS s FROM ({1}) UNION ALL SELECT {0}, -1 FROM ({2})) GROUP BY {0} HAVING sum(s) <> 0"
_KEPT = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"
_BAND = "case when place_price < 40 then '1' when place_price < 70 then '2' when place_price < 120 then '3' when place_price is not null then '4' end"
DQ_SQL = " UNION ALL ".join([
    _counted("same copy", _GAPS.format("o_orderkey, o_custkey, o_totalprice", _KEPT, _KEPT)),
    _counted("shifted nulls", _GAPS.format("x, y", _SHIFTED, f"SELECT y AS x, x AS y FROM ({_SHIFTED})")),
    _compared("totals reconcile", "SELECT count(*) FROM f", "SELECT count(*) FROM orders"),
    _compared("totals of another table", "SELECT count(*) FROM f", "SELECT count(*) FROM customer"),
    "SELECT 'columns allowed', true, '', 'lat,lon,rooms' UNION ALL SELECT 'columns not allowed', false, 'rooms', 'lat,lon'",
    _counted("no forbidden text", "SELECT 1 FROM sites WHERE regexp_matches(concat_ws(' ', lat, lon, rooms), '(?i)host_|licen[cs]e|HUTB')"),
    _counted("forbidden text", "SELECT 1 FROM customer WHERE regexp_matches(c_mktsegment, '(?i)build')"),
    _counted("one price per category", f"SELECT official FROM (SELECT DISTINCT official, adr, {_BAND} AS band FROM pl WHERE adr IS NOT NULL) GROUP BY 1 HAVING count(*) > 1 OR bool_or(band IS NULL)"),
    _counted("one status per customer", "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1"),
    _counted("occupancy in range", "SELECT o FROM (SELECT sum(rooms * 802e-3) * 100 / sum(rooms) AS o FROM sites) WHERE o IS NULL OR o <= 0 OR o > 100"),
    _counted("rooms in range", "SELECT 1 FROM sites WHERE rooms IS NULL OR rooms <= 20 OR rooms > 60"),
    _compared("funnel closes", "SELECT count(*) - count(reason) FROM f", "SELECT count(*) FROM f WHERE reason IS NULL"),
    _compared("funnel stays open", "SELECT count(*) - count(reason) FROM f", "SELECT count(*) FROM f WHERE reason = 'open'"),
    _counted("coordinates finite", "SELECT 1 FROM sites WHERE lat IS NULL OR lon IS NULL OR isnan(lat) OR isnan(lon)"),
    _counted("prices finite", "SELECT 1 FROM agents WHERE price IS NULL"),
    _counted("unique keys", "SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1"),
    _counted("repeated keys", "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1"),
    _counted("reasons declared", f"SELECT DISTINCT reason FROM f WHERE reason NOT IN ({', '.join(repr(x) for x in FUNNEL_STEPS)})"),
    _counted("a reason not declared", f"SELECT DISTINCT reason FROM f WHERE reason NOT IN ({', '.join(repr(x) for x in FUNNEL_STEPS[:-1])})"),
])


@query("dq_checks", "DQ-01 DQ-02 DQ-03 DQ-04 DQ-06 DQ-07 DQ-08 DQ-09", f"WITH {ORDERS_SQL}, {ADR_SQL} {DQ_SQL}", ("sites", "agents"))
def dq_checks(spark, folder):
    """Every check on a case that passes and, but for the first kinds, on one that fails."""
    sites, agents = standin(spark, folder, "sites"), standin(spark, folder, "agents")
    whole, customers = read(spark, folder, "orders"), read(spark, folder, "customer")
    orders = whole.select("o_orderkey", "o_custkey", "o_totalprice")
    shifted = read(spark, folder, "supplier").selectExpr(
        "case when s_suppkey % 2 = 0 then s_suppkey end AS x", "case when s_suppkey % 2 = 1 then s_suppkey end AS y")
    reasons = order_reasons(spark, folder)
    report = funnel.funnel(reasons, FUNNEL_STEPS, "reason", "amount")
    priced = pricing.price_lodgings(sites, category_averages(spark, folder)).filter("adr is not null")
    published = sites.select("lat", "lon", "rooms")

    def declared(steps):
        return spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in steps])).alias("step"))

    return quality.report(
        quality.same_rows("same copy", orders, orders.repartition(4, "o_custkey")),
        quality.same_rows("shifted nulls", shifted, shifted.select(c("y").alias("x"), c("x").alias("y"))),
        quality.equal("totals reconcile", reasons.agg(F.count("*")), report.agg(F.max(c("dropped") + c("remaining")))),
        quality.equal("totals of another table", reasons.agg(F.count("*")), customers.agg(F.count("*"))),
        quality.only_columns("columns allowed", published, ["lat", "lon", "rooms"]),
        quality.only_columns("columns not allowed", published, ["lat", "lon"]),
        quality.no_text("no forbidden text", published, r"(?i)host_|licen[cs]e|HUTB"),
        quality.no_text("forbidden text", customers.select("c_mktsegment"), r"(?i)build"),
        quality.single_valued("one price per category", priced, "official", ["adr", "place_band"]),
        quality.single_valued("one status per customer", whole, "o_custkey", ["o_orderstatus"]),
        quality.in_range("occupancy in range", sites.agg((F.sum(c("rooms") * 0.802) * 100 / F.sum("rooms")).alias("o")), "o", 0, 100),
        quality.in_range("rooms in range", sites, "rooms", 20, 60),
        quality.funnel_closes("funnel closes", report, reasons.filter("reason is null")),
        quality.funnel_closes("funnel stays open", report, reasons.filter("reason = 'open'")),
        quality.finite("coordinates finite", sites, ["lat", "lon"]),
        quality.finite("prices finite", agents.withColumn("price", c("price").cast("double")), ["price"]),
        quality.unique("unique keys", orders, "o_orderkey"),
        quality.unique("repeated keys", orders, "o_custkey"),
        quality.none("reasons declared", funnel.undeclared_reasons(reasons, declared(FUNNEL_STEPS), "reason", "step")),
        quality.none("a reason not declared", funnel.undeclared_reasons(reasons, declared(FUNNEL_STEPS[:-1]), "reason", "step")))


@query("dq05_absorption_checks", "DQ-05", f"""
WITH RECURSIVE {WALK_A}, v AS (SELECT (SELECT sum(qty) FROM pairs WHERE sid IS NOT NULL) AS used, (SELECT sum(cap) FROM hs) AS cap)
SELECT 'absorbed rooms match the report' AS "check", true AS ok, round(used, 2) AS observed, round(used, 2) AS expected FROM v
UNION ALL SELECT 'absorbed rooms match another report', abs(used - used * 2) <= 50, round(used, 2), round(used * 2, 2) FROM v
UNION ALL SELECT 'absorbed within free rooms', used <= cap * 1.01, round(used, 2), round(cap, 2) FROM v
UNION ALL SELECT 'absorbed within half of them', used <= cap * 0.5, round(used, 2), round(cap, 2) FROM v""", ("agents", "sites"))
def absorption_checks(spark, folder):
    _, sites = allocation_inputs(spark, folder, ["A"])
    pairs = durable(main_run(spark, folder))
    detail = scenario.absorbed(pairs, sites).agg(F.sum("rooms").alias("v"))
    whole = pairs.filter("sid is not null").agg(F.sum("qty").alias("v"))
    room = sites.agg(F.sum("cap").alias("v"))
    out = quality.report(
        quality.equal("absorbed rooms match the report", detail, whole, tolerance=50.0),
        quality.equal("absorbed rooms match another report", detail, whole.select((c("v") * 2).alias("v")), tolerance=50.0),
        quality.at_most("absorbed within free rooms", detail, room, factor=1.01),
        quality.at_most("absorbed within half of them", detail, room, factor=0.5))
    return out.withColumns({n: F.round(c(n).cast("double"), 2) for n in ("observed", "expected")})
