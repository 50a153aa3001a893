"""Projection, binning, funnel, de-duplication and set queries."""

from pyspark.sql import functions as F

from hostelry.functions import numeric
from hostelry.operators import bins, dedup, funnel, projection
from hostelry.operators.distribution import dense_index, keep_first, top_per_group
from hostelry.registry.core import query
from hostelry.registry.fixtures import read, standin
from hostelry.registry.text_queries import LICENCE_SQL, licensed

c = F.col

# ---------------------------------------------------------------- funnel

FUNNEL_STEPS = ["open", "low_priority", "too_old", "duplicate", "small"]
ORDERS_SQL = """
o AS (SELECT o_orderkey AS id, o_custkey AS host, cast(o_orderdate as date) AS d, o_totalprice AS amount,
  case when o_orderstatus = 'O' then 'open' when o_orderpriority = '5-LOW' then 'low_priority'
       when o_orderdate < timestamp '1996-01-01' then 'too_old' end AS r0 FROM orders),
w AS (SELECT *, row_number() over (partition by host, date_trunc('month', d), r0 is null order by id) AS rn FROM o),
f AS (SELECT id, host, d, amount, coalesce(r0, case when rn > 1 then 'duplicate' end, case when amount < 5e4 then 'small' end) AS reason FROM w)
"""


def order_reasons(spark, folder):
    rows = read(spark, folder, "orders").select(
        c("o_orderkey").alias("id"), c("o_custkey").alias("host"), c("o_orderdate").cast("date").alias("d"),
        c("o_totalprice").alias("amount"), "o_orderstatus", "o_orderpriority",
        F.trunc("o_orderdate", "month").alias("month"),
    )
    steps = [
        ("open", c("o_orderstatus") == "O"),
        ("low_priority", c("o_orderpriority") == "5-LOW"),
        ("too_old", c("d") < F.lit("1996-01-01").cast("date")),
    ]
    marked = funnel.survivors_and_reasons(rows, steps, ["host", "month"], "id", [c("id")])
    small = c("reason").isNull() & (c("amount") < 50000)
    return marked.withColumn("reason", F.when(small, F.lit("small")).otherwise(c("reason")))


@query("fun01_exclusion_funnel", "FUN-01 DQ-06", f"""
WITH {ORDERS_SQL}, s AS (SELECT unnest([1,2,3,4,5]) AS step_no, unnest(['open','low_priority','too_old','duplicate','small']) AS step),
g AS (SELECT step_no, s.step, count(f.id) AS dropped, round(coalesce(sum(amount), 0), 2) AS dropped_capacity FROM s LEFT JOIN f ON f.reason = s.step GROUP BY 1, 2)
SELECT step_no, step, dropped, round(dropped_capacity, 1) AS dropped_capacity,
 ((SELECT count(*) FROM f) - sum(dropped) over (order by step_no))::BIGINT AS remaining,
 round((SELECT sum(amount) FROM f) - sum(dropped_capacity) over (order by step_no), 1) AS remaining_capacity FROM g""")
def exclusion_funnel(spark, folder):
    out = funnel.funnel(order_reasons(spark, folder), FUNNEL_STEPS, "reason", "amount")
    return out.withColumns({k: F.round(k, 1) for k in ("dropped_capacity", "remaining_capacity")})


@query("fun02_funnel_breakdown", "FUN-02", f"""
WITH {ORDERS_SQL} SELECT reason AS step, case reason when 'open' then cast(year(d) as varchar) when 'too_old' then
 case when year(d) <= 1994 then 'to 1994' else '1995' end when 'small' then case when amount <= 10000 then 'to 10000'
 when amount <= 30000 then 'to 30000' else 'to 50000' end when 'duplicate' then case when host <= 500 then 'low' else 'high' end else 'all' end AS label, count(*) AS rows
FROM f WHERE reason IS NOT NULL GROUP BY 1, 2""")
def funnel_breakdown(spark, folder):
    labels = {
        "open": F.year("d").cast("string"),
        "too_old": numeric.right_closed(F.year("d"), [0, 1994, 1995], ["to 1994", "1995"]),
        "small": numeric.right_closed(c("amount"), [0, 10000, 30000, 50000], ["to 10000", "to 30000", "to 50000"]),
        "duplicate": F.when(c("host") <= 500, "low").otherwise("high"),
        "low_priority": F.lit("all"),
    }
    return funnel.breakdown(order_reasons(spark, folder), "reason", labels)


SCOPE_SQL = f"""
{LICENCE_SQL},
r AS (SELECT *, case when prefix in ('HB','HCC','AJ','ATB','ATCC') then 'regulated' when room_type = 'Hotel room' then 'hotel_room'
  when room_type <> 'Entire home/apt' and coalesce(prefix, '') <> 'HUTB' then 'room_without_licence'
  when min_nights > 31 then 'long_stay' when last_review is null then 'never_reviewed' when last_review < date '1998-01-01' then 'inactive' end AS r0 FROM norm),
q AS (SELECT *, row_number() over (partition by name, host_id, r0 is null order by id) AS rn FROM r),
reasons AS (SELECT *, case when r0 is null and rn > 1 then 'duplicate' else r0 end AS reason FROM q)
"""


def scoped(spark, folder):
    """Listings with the reason they are out of scope, null when they are in."""
    prefix = F.coalesce(c("prefix"), F.lit(""))
    steps = [
        ("regulated", prefix.isin("HB", "HCC", "AJ", "ATB", "ATCC")),
        ("hotel_room", c("room_type") == "Hotel room"),
        ("room_without_licence", (c("room_type") != "Entire home/apt") & (prefix != "HUTB")),
        ("long_stay", c("min_nights") > 31),
        ("never_reviewed", c("last_review").isNull()),
        ("inactive", c("last_review") < F.lit("1998-01-01").cast("date")),
    ]
    return funnel.survivors_and_reasons(licensed(spark, folder), steps, ["name", "host_id"], "id", [c("id")])


@query("fun03_exclusion_reasons", "FUN-03 PRJ-12 PRJ-04", f"""
WITH {SCOPE_SQL} SELECT reason, count(*) AS rows, sum(places)::BIGINT AS places, min(id) AS first_id FROM reasons GROUP BY reason""", ("declared",))
def exclusion_reasons(spark, folder):
    return scoped(spark, folder).groupBy("reason").agg(
        F.count("*").alias("rows"), F.sum("places").alias("places"), F.min("id").alias("first_id"))


# ---------------------------------------------------------------- projection

@query("prj01_rename_select", "PRJ-01", "SELECT s_suppkey AS site, s_nationkey AS area, s_acctbal AS balance FROM supplier")
def rename_select(spark, folder):
    return projection.rename_select(read(spark, folder, "supplier"),
                                    {"s_suppkey": "site", "s_nationkey": "area", "s_acctbal": "balance"})


@query("prj02_reindex", "PRJ-02 SET-01", """
SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL::BIGINT AS rooms FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, s_suppkey % 9 FROM supplier""")
def reindex(spark, folder):
    target = {"id": "bigint", "name": "string", "balance": "double", "rooms": "bigint"}
    people = read(spark, folder, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS balance")
    firms = read(spark, folder, "supplier").selectExpr(
        "s_suppkey AS id", "s_name AS name", "s_acctbal AS balance", "s_suppkey % 9 AS rooms", "s_nationkey AS extra")
    return projection.reindex(people, target).unionByName(projection.reindex(firms, target))


@query("prj03_value_mapping", "PRJ-03", """
SELECT case o_orderstatus when 'F' then 'finished' when 'O' then 'open' end AS exact_label,
 case o_orderpriority when '1-URGENT' then 'now' when '2-HIGH' then 'soon' else 'Otro' end AS loose_label, count(*) AS rows FROM orders GROUP BY 1, 2""")
def value_mapping(spark, folder):
    return read(spark, folder, "orders").groupBy(
        projection.mapped(c("o_orderstatus"), {"F": "finished", "O": "open"}).alias("exact_label"),
        projection.mapped(c("o_orderpriority"), {"1-URGENT": "now", "2-HIGH": "soon"}, "Otro").alias("loose_label"),
    ).agg(F.count("*").alias("rows"))


@query("prj04_first_match", "PRJ-04", """
SELECT id, case when category like '%estrell%' then 'hotel_stars' when kind = 'apartament_turistic' or category = 'Sense categoritzar'
 then 'apartments' else 'no_stars' end AS class FROM sites""", ("sites",))
def first_match(spark, folder):
    return standin(spark, folder, "sites").select("id", projection.first_match([
        (c("category").contains("estrell"), "hotel_stars"),
        ((c("kind") == "apartament_turistic") | (c("category") == "Sense categoritzar"), "apartments"),
    ], "no_stars").alias("class"))


@query("prj05_coordinates_by_source", "PRJ-05 JN-02", """
WITH a AS (SELECT id, case when id % 3 = 0 then lat end AS lat, case when id % 3 = 0 then lon end AS lon FROM agents),
s1 AS (SELECT id, min(lat + k) AS lat, arg_min(lon + k, lat + k) AS lon FROM (SELECT * FROM agents, (SELECT unnest([1e0, 2e0]) AS k)) WHERE id % 3 = 1 AND id % 4 < 2 GROUP BY id),
s2 AS (SELECT id, lat + 5 AS lat, lon + 5 AS lon FROM agents WHERE id % 5 < 3)
SELECT a.id, round(coalesce(a.lat, s1.lat, s2.lat), 6) AS lat, round(coalesce(a.lon, s1.lon, s2.lon), 6) AS lon,
 case when a.lat is not null then 'registry' when s1.lat is not null then 'geocoded' when s2.lat is not null then 'older' end AS origin
FROM a LEFT JOIN s1 USING (id) LEFT JOIN s2 USING (id)""", ("agents",))
def coordinates_by_source(spark, folder):
    base = standin(spark, folder, "agents").select("id", "lat", "lon")
    own = base.select("id", *[F.when(c("id") % 3 == 0, c(x)).alias(x) for x in ("lat", "lon")])
    has_first, has_second = F.expr("id % 3 = 1 and id % 4 < 2"), F.expr("id % 5 < 3")
    first = base.select("id", F.explode(F.array(F.lit(1.0), F.lit(2.0))).alias("k"), "lat", "lon").select(
        "id", *[F.when(has_first, c(x) + c("k")).alias(x) for x in ("lat", "lon")])
    second = base.select("id", *[F.when(has_second, c(x) + 5).alias(x) for x in ("lat", "lon")])
    out = projection.complete_by_source(own, "id", ["lat", "lon"], "registry",
                                        [("geocoded", first), ("older", second)], "origin", "lat")
    return out.select("id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "origin")


@query("prj06_safe_numbers", "PRJ-06", """
SELECT c_mktsegment AS segment, count(n) AS numbers, round(sum(n), 2) AS total FROM (SELECT c_mktsegment, try_cast(case when c_custkey % 6 = 0 then '-'
 when c_custkey % 7 = 0 then '12 rooms' else cast(c_custkey * 5e-1 as varchar) end AS DOUBLE) AS n FROM customer) GROUP BY 1""")
def safe_numbers(spark, folder):
    raw = F.expr("case when c_custkey % 6 = 0 then '-' when c_custkey % 7 = 0 then '12 rooms' else cast(c_custkey * 5e-1 as string) end")
    return read(spark, folder, "customer").select(c("c_mktsegment").alias("segment"), numeric.to_number(raw).alias("n")).groupBy(
        "segment").agg(F.count("n").alias("numbers"), F.round(F.sum("n"), 2).alias("total"))


@query("prj07_money_text", "PRJ-07", """
SELECT round(sum(n), 2) AS total, count(n) AS priced, count(*) AS rows FROM (SELECT try_cast(nullif(regexp_replace(
 case when o_orderkey % 9 = 0 then '' else concat('$', cast((o_custkey / 7)::INT as varchar), ',', lpad(cast(o_orderkey % 1000 as varchar), 3, '0'), '.50') end, '[^0-9.]', '', 'g'), '') AS DOUBLE) AS n FROM orders)""")
def money_text(spark, folder):
    raw = F.expr("case when o_orderkey % 9 = 0 then '' else concat('$', cast(cast(round(o_custkey / 7) as int) as string), ',',"
                 " lpad(cast(o_orderkey % 1000 as string), 3, '0'), '.50') end")
    return read(spark, folder, "orders").select(numeric.money(raw).alias("n")).agg(
        F.round(F.sum("n"), 2).alias("total"), F.count("n").alias("priced"), F.count("*").alias("rows"))


@query("prj08_clipped_values", "PRJ-08", """
SELECT greatest(1, least(4, bedrooms)) AS rooms, count(*) AS rows FROM agents WHERE bedrooms IS NOT NULL GROUP BY 1
UNION ALL SELECT NULL, count(*) FROM agents WHERE bedrooms IS NULL""", ("agents",))
def clipped_values(spark, folder):
    return standin(spark, folder, "agents").groupBy(numeric.clip(c("bedrooms"), 1, 4).alias("rooms")).agg(F.count("*").alias("rows"))


@query("prj09_guarded_ratio", "PRJ-09 MA-03", """
SELECT id, case when bedrooms > 0 then round(place_price * places / bedrooms, 8) end AS room_price FROM agents""", ("agents",))
def guarded_ratio(spark, folder):
    return standin(spark, folder, "agents").select(
        "id", F.round(numeric.ratio(c("place_price") * c("places"), c("bedrooms")), 8).alias("room_price"))


@query("prj10_capacity_units", "PRJ-10 MA-01", """
SELECT id, greatest(1, coalesce(case when bedrooms > 0 then bedrooms::DOUBLE end, round_even(places / 2e0, 0))) AS units FROM agents""", ("agents",))
def capacity_units(spark, folder):
    return standin(spark, folder, "agents").select("id", numeric.capacity_units(c("bedrooms"), c("places")).alias("units"))


@query("prj11_bounding_box", "PRJ-11", """
SELECT area, count(*) AS rows FROM agents WHERE lat BETWEEN 413325e-4 AND 41345e-3 AND lon BETWEEN 206e-2 AND 208e-2 GROUP BY area""", ("agents",))
def bounding_box(spark, folder):
    box = (41.3325, 41.345, 2.06, 2.08)
    return standin(spark, folder, "agents").filter(numeric.inside_box(c("lat"), c("lon"), box)).groupBy("area").agg(F.count("*").alias("rows"))


@query("prj13_relabel_pairs", "PRJ-13", f"""
WITH {LICENCE_SQL}, s AS (SELECT id, case when prefix = 'HUTB' and room_type in ('Private room', 'Shared room') then 'unproven' else 'as_is' end AS state,
 case when prefix = 'HUTB' and room_type in ('Private room', 'Shared room') then 'licence used for a room' else class end AS why FROM norm)
SELECT state, why, count(*) AS rows FROM s GROUP BY 1, 2""", ("declared",))
def relabel_pairs(spark, folder):
    rows = licensed(spark, folder).select("prefix", "room_type", F.lit("as_is").alias("state"), c("class").alias("why"))
    mask = (c("prefix") == "HUTB") & c("room_type").isin("Private room", "Shared room")
    return projection.relabel(rows, mask, {"state": "unproven", "why": "licence used for a room"}).groupBy("state", "why").agg(F.count("*").alias("rows"))


@query("prj14_constant_imputation", "PRJ-14", """
SELECT coalesce(min_nights, 31) AS nights, count(*) AS rows, sum((min_nights IS NULL)::INT)::BIGINT AS imputed FROM declared GROUP BY 1""", ("declared",))
def constant_imputation(spark, folder):
    return standin(spark, folder, "declared").groupBy(F.coalesce("min_nights", F.lit(31)).alias("nights")).agg(
        F.count("*").alias("rows"), F.sum(c("min_nights").isNull().cast("long")).alias("imputed"))


# ---------------------------------------------------------------- bins

@query("bin01_price_bands", "BIN-01 WD-09", """
SELECT case when place_price is null then null when place_price < 40 then '€' when place_price < 70 then '€€' when place_price < 120 then '€€€' else '€€€€' end AS band,
 count(*) AS rows FROM agents GROUP BY 1""", ("agents",))
def price_bands(spark, folder):
    return standin(spark, folder, "agents").groupBy(numeric.price_band(c("place_price")).alias("band")).agg(
        F.count("*").alias("rows")).orderBy(numeric.band_rank(c("band")))


@query("bin02_stay_tiers", "BIN-02 ML-12", """
SELECT case when min_nights <= 0 then null when min_nights <= 6 then 'short' when min_nights <= 27 then 'middle' when min_nights <= 31 then 'long' end AS tier, count(*) AS rows FROM declared GROUP BY 1""", ("declared",))
def stay_tiers(spark, folder):
    tier = numeric.right_closed(c("min_nights"), [0, 6, 27, 31], ["short", "middle", "long"])
    return standin(spark, folder, "declared").groupBy(tier.alias("tier")).agg(F.count("*").alias("rows"))


@query("bin03_bucket_shares", "BIN-03", """
WITH e AS (SELECT unnest([0e0, 1e4, 1e5, 2e5, 4e5]) AS since, unnest([1e4, 1e5, 2e5, 4e5, NULL]) AS until),
t AS (SELECT sum(1 + o_orderkey % 3) AS w FROM orders)
SELECT since, until, round(coalesce(sum(1 + o_orderkey % 3), 0) * 100e0 / (SELECT w FROM t), 4) AS pct FROM e LEFT JOIN orders
 ON o_totalprice >= since AND (until IS NULL OR o_totalprice < until) GROUP BY 1, 2""")
def bucket_shares(spark, folder):
    out = bins.bucket_shares(read(spark, folder, "orders"), c("o_totalprice"), (1 + c("o_orderkey") % 3).cast("double"), [0, 1e4, 1e5, 2e5, 4e5])
    return out.withColumn("pct", F.round("pct", 4))


@query("bin04_root_classes", "BIN-04", """
WITH n AS (SELECT area, count(*) - 50 AS v FROM agents GROUP BY area)
SELECT area, case when greatest(v, 0) = 0 then -1 else least(4, floor(sqrt(v / (SELECT max(greatest(v, 0)) FROM n)::DOUBLE) * 5))::INT end AS class FROM n""", ("agents",))
def root_classes(spark, folder):
    n = standin(spark, folder, "agents").groupBy("area").agg((F.count("*") - 50).alias("v")).withColumn("v", F.greatest(c("v"), F.lit(0)))
    return bins.root_class(n, "v", 5, "class").select("area", "class")


@query("bin04_root_breaks", "BIN-04", """
WITH n AS (SELECT max(k) AS top FROM (SELECT count(*) AS k FROM agents GROUP BY area))
SELECT i::INT AS class, case when i = 0 then 1 else ceil(top * (i / 5e0) ** 2)::BIGINT end AS since FROM n, (SELECT unnest([0,1,2,3,4]) AS i)""", ("agents",))
def root_breaks(spark, folder):
    n = standin(spark, folder, "agents").groupBy("area").agg(F.count("*").alias("v"))
    return bins.root_breaks(n, "v", 5)


@query("bin05_change_classes", "BIN-05", """
SELECT case when now = 0 then 'none' when p >= 50 then 'gains' when p >= 10 then 'gains a little' when p > -10 then 'same' when p > -50 then 'loses a little' else 'loses' end AS class,
 count(*) AS rows FROM (SELECT now, coalesce(case when now > 0 then (later - now) * 100e0 / now end, 0) AS p FROM (SELECT p_partkey % 7 AS now, p_partkey % 11 AS later FROM part)) GROUP BY 1""")
def change_classes(spark, folder):
    rows = read(spark, folder, "part").selectExpr("cast(p_partkey % 7 as double) AS now", "cast(p_partkey % 11 as double) AS later")
    return rows.groupBy(bins.change_class(c("now"), numeric.change_pct(c("now"), c("later"))).alias("class")).agg(F.count("*").alias("rows"))


@query("bin06_top_quintile", "BIN-06", """
WITH v AS (SELECT c_custkey, c_nationkey, case when c_custkey % 4 = 0 then 0 else c_acctbal end AS v FROM customer)
SELECT c_nationkey, sum((v >= (SELECT quantile_cont(v, 0.8) FROM v WHERE v > 0))::INT)::BIGINT AS high FROM v GROUP BY 1""")
def top_quintile(spark, folder):
    rows = read(spark, folder, "customer").select(
        "c_nationkey", F.when(c("c_custkey") % 4 == 0, 0.0).otherwise(c("c_acctbal")).alias("v"))
    return bins.top_share_flag(rows, "v", 0.8, "high").groupBy("c_nationkey").agg(F.sum(c("high").cast("long")).alias("high"))


@query("bin06_ranked_threshold", "BIN-06", """
SELECT round(v, 4) AS threshold FROM (SELECT c_acctbal AS v, row_number() over (order by c_acctbal) - 1 AS i, count(*) over () AS n FROM customer WHERE c_acctbal > 0) WHERE i = floor(n * 0.8)""")
def ranked_threshold(spark, folder):
    return bins.rank_class(read(spark, folder, "customer"), "c_acctbal", 0.8).select(F.round("limit", 4).alias("threshold"))


@query("out01_outlier_cap", "OUT-01", """
WITH v AS (SELECT l_linenumber, l_returnflag, case when l_orderkey % 50 = 0 then l_extendedprice * 40 else l_extendedprice end AS p FROM lineitem),
m AS (SELECT l_returnflag, l_linenumber, median(p) * 5 AS top FROM v GROUP BY 1, 2)
SELECT l_returnflag, l_linenumber, sum((p > top)::INT)::BIGINT AS capped_rows, round(max(least(p, top)), 4) AS top_value FROM v JOIN m USING (l_returnflag, l_linenumber) GROUP BY 1, 2""")
def outlier_cap(spark, folder):
    rows = read(spark, folder, "lineitem").select(
        "l_returnflag", "l_linenumber",
        F.when(c("l_orderkey") % 50 == 0, c("l_extendedprice") * 40).otherwise(c("l_extendedprice")).alias("p"))
    out = projection.cap_outliers(rows, "p", ["l_returnflag", "l_linenumber"])
    return out.groupBy("l_returnflag", "l_linenumber").agg(
        F.sum(c("was_capped").cast("long")).alias("capped_rows"), F.round(F.max("capped"), 4).alias("top_value"))


TAX = ("case when s_suppkey % 5 = 0 then 'No aplica' when s_suppkey % 7 = 0 then concat(lpad(cast(s_suppkey as varchar(20)), 8, '1'), 'X')"
       " when s_suppkey % 11 = 0 then null else concat('B', lpad(cast(s_suppkey % 40 as varchar(20)), 8, '0')) end")


@query("msk01_personal_ids", "MSK-01", f"""
SELECT s_suppkey, p AS is_person, case when not p then tax end AS tax, case when not p then s_name end AS company FROM (SELECT s_suppkey, s_name, tax,
 coalesce(tax = 'No aplica' or regexp_matches(tax, '^[0-9]{{8}}[A-Za-z]$'), false) AS p FROM (SELECT *, {TAX} AS tax FROM supplier))""")
def personal_ids(spark, folder):
    rows = read(spark, folder, "supplier").select("s_suppkey", F.expr(TAX).alias("tax"), c("s_name").alias("company"))
    return projection.mask_persons(rows, "tax", ["tax", "company"], "No aplica", "is_person")


@query("msk02_minimum_support", "MSK-02", """
SELECT host_id, min(host_name) AS name, count(*) AS n, sum(places)::BIGINT AS capacity FROM agents GROUP BY host_id HAVING count(*) >= 16
ORDER BY n DESC, host_id LIMIT 5""", ("agents",))
def minimum_support(spark, folder):
    return projection.publishable(standin(spark, folder, "agents"), "host_id", "host_name", "places", 16, 5)


# ---------------------------------------------------------------- de-duplication

@query("wd01_keep_first", "WD-01", "SELECT o_custkey, min(o_orderkey) AS first_order, arg_min(o_totalprice, o_orderkey) AS price FROM orders GROUP BY o_custkey")
def keep_first_row(spark, folder):
    rows = read(spark, folder, "orders").select("o_custkey", c("o_orderkey").alias("first_order"), c("o_totalprice").alias("price"))
    return keep_first(rows, ["o_custkey"], [c("first_order")])


@query("wd02_flag_repeats", "WD-02", """
SELECT repeated, count(*) AS rows, sum(id)::BIGINT AS ids FROM (SELECT id, count(*) over (partition by host_id, name) > 1 AS repeated FROM declared) GROUP BY 1""", ("declared",))
def flag_repeats(spark, folder):
    return dedup.flag_repeats(standin(spark, folder, "declared"), ["host_id", "name"], "repeated").groupBy("repeated").agg(
        F.count("*").alias("rows"), F.sum("id").alias("ids"))


@query("wd03_latest_visit", "WD-03", """
WITH v AS (SELECT *, case when id % 50 = 0 then null else visited end AS seen, id % 9 <> 0 AS identified FROM food),
r AS (SELECT *, row_number() over (partition by name, kind, brand, identified order by seen desc nulls first, id desc) AS rn FROM v)
SELECT id, name, cast(seen as varchar) AS seen FROM r WHERE rn = 1 OR NOT identified""", ("food",))
def latest_visit(spark, folder):
    rows = standin(spark, folder, "food").select(
        "id", "name", "kind", "brand", F.when(c("id") % 50 != 0, c("visited")).alias("seen"), (c("id") % 9 != 0).alias("identified"))
    return dedup.latest_visit(rows, ["name", "kind", "brand"], "seen", "identified", "id").select("id", "name", c("seen").cast("string").alias("seen"))


def chain() -> list[dedup.Step]:
    has, lacks = c("license").isNotNull(), c("license").isNull()
    return [
        dedup.Step(["host_id", "license", "room_type"], has, "host, licence, type"),
        dedup.Step(["name", "host_id", "license"], has, "name, host, licence"),
        dedup.Step(["host_id", "license"], has, "host, licence"),
        dedup.Step(["name", "host_id"], lacks, "name, host without licence"),
    ]


def _chain_sql() -> str:
    keys = [("host_id, license, room_type", "license is not null"), ("name, host_id, license", "license is not null"),
            ("host_id, license", "license is not null"), ("name, host_id", "license is null")]
    parts, last = [], "declared"
    for i, (k, cond) in enumerate(keys):
        parts.append(f"c{i} AS (SELECT * EXCLUDE rn FROM (SELECT *, case when {cond} then row_number() over (partition by {k}, {cond} order by id) else 1 end AS rn FROM {last}) WHERE rn = 1)")
        last = f"c{i}"
    return ", ".join(parts)


@query("wd04_dedup_chain", "WD-04", f"WITH {_chain_sql()} SELECT id, host_id, name, license FROM c3", ("declared",))
def dedup_chain(spark, folder):
    return dedup.dedup_chain(standin(spark, folder, "declared"), chain(), "id", [c("id")]).select("id", "host_id", "name", "license")


@query("wd04_chain_report", "WD-04", f"""
WITH {_chain_sql()}, n AS (SELECT [(SELECT count(*) FROM declared), (SELECT count(*) FROM c0), (SELECT count(*) FROM c1), (SELECT count(*) FROM c2), (SELECT count(*) FROM c3)] AS s)
SELECT i::INT AS step_no, ['host, licence, type','name, host, licence','host, licence','name, host without licence'][i] AS step, s[i] - s[i+1] AS removed, s[5] AS kept_at_end
FROM n, (SELECT unnest([1,2,3,4]) AS i)""", ("declared",))
def chain_report(spark, folder):
    return dedup.chain_report(standin(spark, folder, "declared"), chain(), "id", c("id"))


@query("wd05_probable_duplicates", "WD-05", """
SELECT id, count(*) over (partition by lower(name), brand, kind) > 1 AS probable FROM food""", ("food",))
def probable_duplicates(spark, folder):
    from hostelry.functions.text import name_key

    rows = standin(spark, folder, "food").select("id", F.concat_ws("|", name_key(c("name")), name_key(c("brand")), "kind").alias("k"))
    return dedup.flag_repeats(rows, ["k"], "probable").select("id", "probable")


@query("wd06_shared_coordinates", "WD-06", """
WITH a AS (SELECT id, case when id % 4 <> 0 then lat end AS lat, case when id % 4 <> 0 then lon end AS lon FROM (SELECT id, round(lat, 3) AS lat, round(lon, 3) AS lon FROM agents))
SELECT id, lat is not null and count(*) over (partition by lat, lon) > 1 AS shared, case when lat is not null then 'point' else 'town' end AS level FROM a""", ("agents",))
def shared_coordinates(spark, folder):
    rows = standin(spark, folder, "agents").select(
        "id", *[F.when(c("id") % 4 != 0, F.round(x, 3)).alias(x) for x in ("lat", "lon")])
    known = c("lat").isNotNull() & c("lon").isNotNull()
    flagged = dedup.flag_repeats(rows, ["lat", "lon"], "shared", known)
    return flagged.select("id", "shared", F.when(known, "point").otherwise("town").alias("level"))


@query("wd07_top_and_bottom", "WD-07", """
(SELECT 'top' AS side, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) UNION ALL
(SELECT 'bottom', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10)""")
def top_and_bottom(spark, folder):
    rows = read(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    top = rows.orderBy(c("o_totalprice").desc(), "o_orderkey").limit(10).select(F.lit("top").alias("side"), "*")
    return top.unionByName(rows.orderBy("o_totalprice", "o_orderkey").limit(10).select(F.lit("bottom").alias("side"), "*"))


@query("wd08_top_per_area", "WD-08", """
SELECT area, id, rooms FROM (SELECT *, row_number() over (partition by area order by rooms desc, id) AS rn FROM sites) WHERE rn <= 5""", ("sites",))
def top_per_area(spark, folder):
    return top_per_group(standin(spark, folder, "sites").select("area", "id", "rooms"), ["area"], [c("rooms").desc(), c("id")], 5)


@query("wd10_priority_order", "WD-10", """
SELECT c_custkey, c_nationkey = 3 AS first_area, row_number() over (order by c_nationkey = 3 DESC, c_custkey) - 1 AS place FROM customer""")
def priority_order(spark, folder):
    rows = read(spark, folder, "customer").select("c_custkey", (c("c_nationkey") == 3).alias("first_area"))
    return dense_index(rows, [c("first_area").desc(), c("c_custkey")], "place")


@query("ag21_duplicates_by_criterion", "AG-21", """
WITH d AS (SELECT *, count(*) over (partition by name, host_id) > 1 AS a, license is not null and count(*) over (partition by license) > 1 AS b,
 count(*) over (partition by name, host_id, room_type, places) > 1 AS e FROM declared),
u AS (SELECT room_type, 'same name and host' AS criterion, a AS f FROM d UNION ALL SELECT room_type, 'same licence', b FROM d UNION ALL SELECT room_type, 'identity', e FROM d)
SELECT room_type, criterion, sum(f::INT)::BIGINT AS repeated, count(*) AS segment_rows, round(sum(f::INT) * 100e0 / count(*), 2) AS pct FROM u GROUP BY 1, 2""", ("declared",))
def duplicates_by_criterion(spark, folder):
    return dedup.duplicate_report(
        standin(spark, folder, "declared"),
        {"same name and host": ["name", "host_id"], "same licence": ["license"], "identity": ["name", "host_id", "room_type", "places"]},
        "room_type", not_null=["license"])


@query("ag22_duplicate_group_sizes", "AG-22", """
SELECT size, count(*) AS groups FROM (SELECT count(*) AS size FROM declared GROUP BY host_id, name HAVING count(*) > 1) GROUP BY size""", ("declared",))
def duplicate_group_sizes(spark, folder):
    return dedup.group_sizes(standin(spark, folder, "declared"), ["host_id", "name"])


@query("ag23_coincidences", "AG-23", """
SELECT 'area' AS same, coalesce(sum(n), 0)::BIGINT AS rows FROM (SELECT count(*) AS n FROM declared GROUP BY host_id, name, area HAVING count(*) > 1) UNION ALL
SELECT 'min nights', coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM declared GROUP BY host_id, name, min_nights HAVING count(*) > 1) UNION ALL
SELECT 'type and places', coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM declared GROUP BY host_id, name, room_type, places HAVING count(*) > 1)""", ("declared",))
def coincidences(spark, folder):
    return dedup.coincidences(standin(spark, folder, "declared"), ["host_id", "name"],
                              {"area": ["area"], "min nights": ["min_nights"], "type and places": ["room_type", "places"]})


# ---------------------------------------------------------------- sets

@query("set02_key_sets", "SET-02", """
SELECT 'both' AS side, count(*) AS keys FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL
SELECT 'only customers', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def key_sets(spark, folder):
    people = read(spark, folder, "customer").select(c("c_custkey").alias("k"))
    buyers = read(spark, folder, "orders").filter(c("o_orderstatus") == "P").select(c("o_custkey").alias("k"))
    both = people.intersect(buyers).agg(F.count("*").alias("keys")).select(F.lit("both").alias("side"), "keys")
    only = people.subtract(buyers).agg(F.count("*").alias("keys")).select(F.lit("only customers").alias("side"), "keys")
    return both.unionByName(only)
