"""Joins, linkage, licences, series and grouped reports."""

from pyspark.sql import functions as F

from hostelry.functions import licence, numeric
from hostelry.operators import aggregates, incremental, linkage, series
from hostelry.operators.distribution import keep_first, spread_join
from hostelry.operators.quantiles import exact_quantiles
from hostelry.plans import licences
from hostelry.registry.core import query
from hostelry.registry.fixtures import read, standin
from hostelry.registry.row_queries import SCOPE_SQL, scoped
from hostelry.registry.text_queries import LICENCE_SQL, licensed

c = F.col

# ---------------------------------------------------------------- joins

SUMS = "sum(l_extendedprice*(1-l_discount)*(1+l_tax))"


def order_sums(spark, folder):
    lines = read(spark, folder, "lineitem")
    return lines.groupBy(c("l_orderkey").alias("id")).agg(
        F.sum(c("l_extendedprice") * (1 - c("l_discount")) * (1 + c("l_tax"))).alias("detail"),
        F.count("*").alias("lines"))


@query("jn01_summary_and_detail", "JN-01", f"""
SELECT o_orderkey AS id, o_totalprice AS summary, lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def summary_and_detail(spark, folder):
    orders = read(spark, folder, "orders").select(c("o_orderkey").alias("id"), c("o_totalprice").alias("summary"))
    return orders.join(order_sums(spark, folder).select("id", "lines"), "id", "left")


@query("jn02_left_join_deduplicated_side", "JN-02", """
WITH d AS (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first_priority FROM orders GROUP BY 1)
SELECT c_custkey, first_priority FROM customer LEFT JOIN d ON o_custkey = c_custkey""")
def left_join_deduplicated_side(spark, folder):
    side = keep_first(read(spark, folder, "orders").select("o_custkey", "o_orderkey", c("o_orderpriority").alias("first_priority")),
                      ["o_custkey"], [c("o_orderkey")])
    people = read(spark, folder, "customer").select("c_custkey")
    return people.join(side, c("c_custkey") == c("o_custkey"), "left").select("c_custkey", "first_priority")


@query("jn03_matched_pairs", "JN-03", f"""
WITH {LICENCE_SQL} SELECT count(*) AS listings, sum(n.places)::BIGINT AS listed_places, sum(r.places)::BIGINT AS registry_places FROM norm n JOIN registry r ON n.code = r.code""", ("declared", "registry"))
def matched_pairs(spark, folder):
    registry = standin(spark, folder, "registry").select("code", c("places").alias("registry_places"))
    rows = licensed(spark, folder).select("id", "code", "places").filter("code is not null")
    joined = spread_join(rows, registry, ["code"])
    return joined.agg(F.count("*").alias("listings"), F.sum("places").alias("listed_places"), F.sum("registry_places").alias("registry_places"))


@query("jn04_semi_join", "JN-04", """
SELECT c_nationkey, count(*) AS people FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) GROUP BY 1""")
def semi_join(spark, folder):
    big = read(spark, folder, "orders").filter(c("o_totalprice") > 450000).select("o_custkey")
    people = read(spark, folder, "customer").join(big, c("c_custkey") == c("o_custkey"), "left_semi")
    return people.groupBy("c_nationkey").agg(F.count("*").alias("people"))


@query("jn05_orphans", "JN-05", """
SELECT coalesce(case when c_custkey % 3 = 0 then concat('HUTB-', lpad(cast(c_custkey as varchar), 6, '0')) end, concat('OPENDATA-', cast(c_custkey as varchar))) AS code, 'open_only' AS match_method
FROM customer WHERE NOT EXISTS (SELECT 1 FROM registry r WHERE r.code = case when c_custkey % 3 = 0 then concat('HUTB-', lpad(cast(c_custkey as varchar), 6, '0')) end)""", ("registry",))
def orphans(spark, folder):
    rows = read(spark, folder, "customer").select(
        "c_custkey", F.expr("case when c_custkey % 3 = 0 then concat('HUTB-', lpad(cast(c_custkey as string), 6, '0')) end").alias("code"))
    rows = rows.withColumn("k", linkage.never_null(c("code"), c("c_custkey")))
    codes = standin(spark, folder, "registry").select(c("code").alias("known"))
    return rows.join(codes, c("k") == c("known"), "left_anti").select(
        F.coalesce("code", F.concat(F.lit("OPENDATA-"), c("c_custkey").cast("string"))).alias("code"),
        F.lit("open_only").alias("match_method"))


UNLICENSED = ["none", "seasonal"]
UNLICENSED_SQL = f"""
{LICENCE_SQL},
pend AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() over (partition by name, host_id order by id) AS rn FROM norm WHERE class in ('none','seasonal') AND last_review >= date '1998-01-01') WHERE rn = 1)
"""


def unlicensed(spark, folder):
    rows = licensed(spark, folder)
    return rows, licences.unlicensed_active(rows, "1998-01-01", UNLICENSED)


@query("jn06_composite_membership", "JN-06", f"""
WITH {UNLICENSED_SQL}, lic2 AS (SELECT * FROM norm WHERE regional is not null),
m AS (SELECT p.*, exists (SELECT 1 FROM lic2 l WHERE l.host_id = p.host_id AND l.name = p.name) AS e,
 exists (SELECT 1 FROM lic2 l WHERE l.host_id = p.host_id AND l.area = p.area AND l.room_type = p.room_type AND l.price = p.price) AS s
 FROM pend p WHERE host_id IN (SELECT host_id FROM lic2))
SELECT case when e then 'same host and name' when s then 'same host, area, type and price' else 'undecided' end AS criterion, count(*) AS rows FROM m GROUP BY 1""", ("declared",))
def composite_membership(spark, folder):
    rows, pending = unlicensed(spark, folder)
    return licences.tied_to_host(pending, rows)


@query("jn07_repeated_keys", "JN-07 DQ-08", "SELECT o_custkey AS k, count(*) AS copies FROM orders GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark, folder):
    linkage.require_unique(read(spark, folder, "orders"), "o_orderkey", "orders")
    return linkage.repeated_keys(read(spark, folder, "orders").select(c("o_custkey").alias("k")), "k")


# two sources over all rows that agree in part: some nation groups have another code and street in the registry, others
# in the open source, and half of what that knows it knows by code
LINK_SQL = """
reg AS (SELECT c_custkey AS k, concat('HUTB-', lpad(cast(c_custkey + case when c_nationkey < 17 then 0 else 500000 end as varchar(20)), 6, '0')) AS code, concat('Hotel ', c_name) AS name, 'Town' AS town, 'C' AS road_type,
  concat('Major ', cast(c_custkey % 700 + case when c_nationkey < 17 then 0 else 1000 end as varchar(20))) AS road_name, cast(c_custkey % 23 as varchar(20)) AS number, '1' AS floor, case when c_custkey % 4 = 0 then 'A' else 'B' end AS door FROM customer),
src AS (SELECT c_custkey AS id, case when c_custkey % 2 = 0 then concat('HUTB-', lpad(cast(c_custkey + case when c_nationkey >= 5 then 0 else 700000 end as varchar(20)), 6, '0')) end AS code, case when c_custkey % 7 = 0 then 'Other place' else c_name end AS name, 'TOWN' AS town, '' AS road_type,
  concat('Carrer Major ', cast(c_custkey % 700 + case when c_nationkey >= 5 then 0 else 2000 end as varchar(20))) AS road_name, cast(c_custkey % 23 as varchar(20)) AS number, '01' AS floor, case when c_custkey % 4 = 0 then 'A' else 'B' end AS door, c_acctbal AS lat, 2 + c_custkey % 6 AS places FROM customer)"""
LINK_BODY = """
ex AS (SELECT reg.*, src.id AS sid, src.lat, src.places FROM reg LEFT JOIN src ON src.code = reg.code),
loose AS (SELECT *, concat_ws('|', road_name, number, ltrim(floor, '0'), door) AS ak FROM src WHERE code IS NULL OR code NOT IN (SELECT code FROM reg)),
pend AS (SELECT *, concat_ws('|', concat('Carrer ', road_name), number, floor, door) AS ak FROM ex WHERE sid IS NULL),
prs AS (SELECT p.code, l.id, l.lat, l.places, l.name FROM pend p JOIN loose l USING (ak) WHERE (SELECT count(*) FROM pend z WHERE z.ak = p.ak) = 1 AND (SELECT count(*) FROM loose z WHERE z.ak = l.ak) = 1)"""


def link_inputs(spark, folder):
    people = read(spark, folder, "customer")
    registry = people.selectExpr(
        "concat('HUTB-', lpad(cast(c_custkey + case when c_nationkey < 17 then 0 else 500000 end as string), 6, '0')) AS code", "concat('Hotel ', c_name) AS name", "'Town' AS town", "'C' AS road_type",
        "concat('Major ', cast(c_custkey % 700 + case when c_nationkey < 17 then 0 else 1000 end as string)) AS road_name",
        "cast(c_custkey % 23 as string) AS number", "'1' AS floor",
        "case when c_custkey % 4 = 0 then 'A' else 'B' end AS door")
    source = people.selectExpr(
        "c_custkey AS id", "case when c_custkey % 2 = 0 then concat('HUTB-', lpad(cast(c_custkey + case when c_nationkey >= 5 then 0 else 700000 end as string), 6, '0')) end AS code",
        "case when c_custkey % 7 = 0 then 'Other place' else c_name end AS name", "'TOWN' AS town", "'' AS road_type",
        "concat('Carrer Major ', cast(c_custkey % 700 + case when c_nationkey >= 5 then 0 else 2000 end as string)) AS road_name",
        "cast(c_custkey % 23 as string) AS number", "'01' AS floor",
        "case when c_custkey % 4 = 0 then 'A' else 'B' end AS door", "c_acctbal AS lat", "2 + c_custkey % 6 AS places")
    return registry, source


PROFILE = linkage.Profile(contributes=["lat", "places"], with_units=True, names=("name", "name"))


@query("jn08_two_pass_linkage", "JN-08 JN-05", f"""
WITH {LINK_SQL}, {LINK_BODY}
SELECT ex.code, ex.name, coalesce(ex.lat, prs.lat) AS lat, coalesce(ex.places, prs.places) AS places, case when sid is not null then 'registry_code' when prs.id is not null then 'address' else 'registry_only' end AS match_method
FROM ex LEFT JOIN prs USING (code) UNION ALL
SELECT coalesce(code, concat('OPENDATA-', cast(id as varchar))), name, lat, places, 'open_only' FROM loose WHERE id NOT IN (SELECT id FROM prs)""")
def two_pass_linkage(spark, folder):
    return linkage.link(*link_inputs(spark, folder), PROFILE).select("code", "name", "lat", "places", "match_method")


KEY_A = "concat(p_name, '|', p_brand, '|', cast(p_size as varchar(20)))"
KEY_B = "concat(p_name, '|', p_brand, '|', cast(p_size + p_partkey % 2 as varchar(20)))"


def two_keyed_sides(spark, folder):
    part = read(spark, folder, "part")
    return part.selectExpr(f"{KEY_A} AS k", "p_partkey AS a"), part.selectExpr(f"{KEY_B} AS k", "p_partkey AS b")


@query("jn09_unambiguous_keys", "JN-09", f"""
WITH a AS (SELECT {KEY_A} AS k, min(p_partkey) AS a FROM part GROUP BY 1 HAVING count(*) = 1), b AS (SELECT {KEY_B} AS k, min(p_partkey) AS b FROM part GROUP BY 1 HAVING count(*) = 1)
SELECT k, a, b FROM a JOIN b USING (k)""")
def unambiguous_keys(spark, folder):
    return linkage.one_to_one(*two_keyed_sides(spark, folder), "k", ["a"], ["b"])


@query("jn09_ambiguous_keys", "JN-09", f"""
WITH a AS (SELECT {KEY_A} AS k, count(*) AS n FROM part GROUP BY 1), b AS (SELECT {KEY_B} AS k, count(*) AS n FROM part GROUP BY 1)
SELECT k, a.n AS left_rows, b.n AS right_rows FROM a JOIN b USING (k) WHERE a.n > 1 OR b.n > 1""")
def ambiguous_keys(spark, folder):
    return linkage.ambiguous_keys(*two_keyed_sides(spark, folder), "k")


@query("jn10_weak_match_audit", "JN-10", f"""
WITH {LINK_SQL}, {LINK_BODY}
SELECT reg.code, case when prs.name = 'Other place' then 0e0 else 1e0 end AS name_similarity, prs.name = 'Other place' AS weak_match FROM prs JOIN reg USING (code)""")
def weak_match_audit(spark, folder):
    out = linkage.link(*link_inputs(spark, folder), PROFILE)
    return out.filter(c("match_method") == "address").select("code", "name_similarity", "weak_match")


@query("jn11_registry_membership", "JN-11", f"""
WITH {LICENCE_SQL}, reg AS (SELECT code FROM registry UNION ALL SELECT code FROM hotel_registry)
SELECT prefix, case when prefix in ('HUTB','HB','HCC','ATB','ATCC') then code in (SELECT code FROM reg) end AS found, count(*) AS rows FROM norm GROUP BY 1, 2""", ("declared", "registry", "hotel_registry"))
def registry_membership(spark, folder):
    return looked_up(spark, folder).groupBy("prefix", "found").agg(F.count("*").alias("rows"))


def registries(spark, folder):
    return standin(spark, folder, "registry").select("code").unionByName(standin(spark, folder, "hotel_registry").select("code"))


def looked_up(spark, folder):
    return licences.in_registry(licensed(spark, folder), "code", "prefix", registries(spark, folder))


@query("jn12_price_reconciliation", "JN-12 DQ-10", f"""
SELECT count(*) AS compared, round(avg((abs(o_totalprice - s) < 150000)::INT), 6) AS agree, round(max(abs(o_totalprice - s)), 2) AS largest_gap
FROM orders JOIN (SELECT l_orderkey, {SUMS} AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def price_reconciliation(spark, folder):
    left = read(spark, folder, "orders").select(c("o_orderkey").alias("id"), c("o_totalprice").alias("summary"))
    out = linkage.reconcile(left, order_sums(spark, folder), "id", "summary", "detail", 150000.0)
    return out.select("compared", F.round("agree", 6).alias("agree"), F.round("largest_gap", 2).alias("largest_gap"))


@query("jn12_largest_disagreements", "JN-12 WD-07", f"""
SELECT o_orderkey AS id, o_totalprice AS summary, round(s, 2) AS detail FROM orders JOIN (SELECT l_orderkey, {SUMS} AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
WHERE abs(o_totalprice - s) >= 1 ORDER BY abs(o_totalprice - s) DESC, id LIMIT 3""")
def largest_disagreements(spark, folder):
    left = read(spark, folder, "orders").select(c("o_orderkey").alias("id"), c("o_totalprice").alias("summary"))
    out = linkage.disagreements(left, order_sums(spark, folder), "id", "summary", "detail", 3)
    return out.withColumn("detail", F.round("detail", 2))


@query("jn13_registry_coverage", "JN-13 SET-02", f"""
WITH {SCOPE_SQL}, k AS (SELECT DISTINCT code FROM reasons WHERE reason IS NULL), x AS (SELECT DISTINCT code FROM reasons WHERE reason IS NOT NULL)
SELECT case when k.code is not null then 'listed' when x.code is not null then 'only_excluded' else 'not_listed' end AS "case", count(*) AS licences, sum(places)::BIGINT AS capacity
FROM registry r LEFT JOIN k ON k.code = r.code LEFT JOIN x ON x.code = r.code GROUP BY 1""", ("declared", "registry"))
def registry_coverage(spark, folder):
    rows = scoped(spark, folder).select("code", "reason")
    return linkage.coverage(standin(spark, folder, "registry"), "code", "places",
                            rows.filter("reason is null"), rows.filter("reason is not null"))


# ---------------------------------------------------------------- licences

VERIFY_SQL = f"""
{LICENCE_SQL}, reg AS (SELECT code FROM registry UNION ALL SELECT code FROM hotel_registry),
top AS (SELECT max(split_part(code, '-', 2)::BIGINT) AS n FROM reg WHERE code like 'HUTB-%'),
h AS (SELECT host_id, bool_or(prefix in ('HB','HCC','AJ')) AS est, bool_or(prefix = 'HUTB') AS dw FROM norm WHERE code is not null GROUP BY 1),
v AS (SELECT norm.*, case when prefix in ('HUTB','HB','HCC','ATB','ATCC') then code in (SELECT code FROM reg) end AS found, est, dw FROM norm LEFT JOIN h USING (host_id)),
ver AS (SELECT *, case when code is not null and found is null then 'unverifiable' when code is not null and found then 'found'
  when code is not null and prefix = 'HUTB' and num > (SELECT n FROM top) then 'above_max'
  when code is not null and (len(list_distinct(string_split(num::VARCHAR, ''))) = 1 or contains('0123456789', num::VARCHAR) or contains('9876543210', num::VARCHAR)) then 'filler'
  when code is not null then 'unknown' when est then 'host_establishment' when dw then 'host_dwelling' when upper(regional) like '%EXEMPT%' then 'exempt' else 'nothing' end AS why FROM v)
"""
VERIFY_USES = ("declared", "registry", "hotel_registry")


def verified(spark, folder):
    return licences.verify(licensed(spark, folder), registries(spark, folder))


@query("lic01_three_state_verification", "LIC-01", f"""
WITH {VERIFY_SQL} SELECT case when why in ('unverifiable','found') then 'with_licence' when why in ('above_max','filler','unknown','host_establishment') then 'unproven_licence' else 'without_licence' end AS state,
 why, count(*) AS rows, sum(id)::BIGINT AS ids FROM ver GROUP BY 1, 2""", VERIFY_USES)
def three_state_verification(spark, folder):
    return verified(spark, folder).groupBy("state", "why").agg(F.count("*").alias("rows"), F.sum("id").alias("ids"))


@query("lic02_highest_number", "LIC-02", "SELECT max(split_part(code, '-', 2)::BIGINT) AS highest FROM registry", ("registry",))
def highest_number(spark, folder):
    noise = read(spark, folder, "region").select(F.lit("1-2017-0046170-1").alias("code"))
    return licences.highest_number(standin(spark, folder, "registry").select("code").unionByName(noise), "code")


@query("lic03_found_by_prefix", "LIC-03", f"""
WITH {VERIFY_SQL} SELECT prefix, count(*) AS declared, sum(found::INT)::BIGINT AS found, sum((not found)::INT)::BIGINT AS not_found FROM ver WHERE prefix IS NOT NULL GROUP BY 1""", VERIFY_USES)
def found_by_prefix(spark, folder):
    return licences.verification_report(looked_up(spark, folder), "prefix")


@query("lic04_ceiling_split", "LIC-04", f"""
WITH {VERIFY_SQL}, n AS (SELECT num, num > (SELECT n FROM top) AS a, length(num::VARCHAR) AS d, length((SELECT n FROM top)::VARCHAR) AS t FROM ver WHERE prefix = 'HUTB' AND NOT found)
SELECT count(*) AS not_found, count(*) FILTER (a) AS above, count(*) FILTER (a AND d = t) AS near, count(*) FILTER (a AND d > t) AS far, min(num) FILTER (a) AS lowest_above FROM n""", VERIFY_USES)
def ceiling_split(spark, folder):
    return licences.ceiling_split(looked_up(spark, folder), registries(spark, folder))


@query("lic05_attributed_regime", "LIC-05", f"""
WITH {UNLICENSED_SQL}, hh AS (SELECT host_id, bool_or(class in ('hotel','hostel')) AS est FROM norm WHERE regional is not null GROUP BY 1)
SELECT case when est then 'host has hotel or hostel: attributed' when est is not null then 'host has other licences: not attributed' else 'host has no licence' end AS situation, count(*) AS rows FROM pend LEFT JOIN hh USING (host_id) GROUP BY 1""", ("declared",))
def attributed_regime(spark, folder):
    rows, pending = unlicensed(spark, folder)
    return licences.attributed_regime(pending, rows, [licence.HOTEL, licence.HOSTEL])


GROUPS = {"impossible": ["above_max", "filler"], "not_in_registry": ["unknown"], "host": ["host_establishment", "host_dwelling"], "nothing": ["nothing", "exempt"]}


@query("kpi05_licence_states", "KPI-05", f"""
WITH {VERIFY_SQL}, g AS (SELECT case when why in ('above_max','filler') then 'impossible' when why = 'unknown' then 'not_in_registry' when why in ('host_establishment','host_dwelling') then 'host' when why in ('nothing','exempt') then 'nothing' end AS "group", why AS reason, places FROM ver)
SELECT "group", reason, count(*) AS rows, sum(places)::BIGINT AS capacity, grouping("group", reason)::BIGINT AS level FROM g WHERE "group" IS NOT NULL GROUP BY ROLLUP ("group", reason)""", VERIFY_USES)
def licence_states(spark, folder):
    return licences.states_by_group(verified(spark, folder), GROUPS, "why", "places")


# ---------------------------------------------------------------- grouped reports

@query("ag01_named_aggregates", "AG-01", """
SELECT o_orderpriority, count(*) AS rows, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 3) AS median,
 count(DISTINCT o_custkey) AS buyers, arg_min(o_custkey, o_orderkey) AS first_buyer FROM orders GROUP BY 1""")
def named_aggregates(spark, folder):
    rows = read(spark, folder, "orders")
    sums = rows.groupBy("o_orderpriority").agg(
        F.count("*").alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean"),
        F.count_distinct("o_custkey").alias("buyers"), F.min_by("o_custkey", "o_orderkey").alias("first_buyer"))
    middle = exact_quantiles(rows, ["o_orderpriority"], "o_totalprice", {"median": 0.5})
    return sums.join(middle, "o_orderpriority").withColumn("median", F.round("median", 3))


@query("ag02_frequency", "AG-02", """
SELECT source, count(*) AS rows, round(count(*) * 100e0 / (SELECT count(*) FROM documents), 2) AS pct FROM documents GROUP BY 1""")
def frequency(spark, folder):
    return aggregates.frequency(read(spark, folder, "documents"), ["source"])


@query("ag03_crosstab", "AG-03", f"""
WITH {LICENCE_SQL}, t AS (SELECT coalesce(class, 'x') AS class, room_type FROM norm UNION ALL SELECT 'Total', room_type FROM norm)
SELECT class, count(*) FILTER (room_type = 'Entire home/apt') AS "Entire home/apt", count(*) FILTER (room_type = 'Private room') AS "Private room",
 count(*) FILTER (room_type = 'Shared room') AS "Shared room", count(*) FILTER (room_type = 'Hotel room') AS "Hotel room", count(*) AS "Total" FROM t GROUP BY 1""", ("declared",))
def crosstab(spark, folder):
    return aggregates.crosstab(licensed(spark, folder), "class", "room_type", ["Entire home/apt", "Private room", "Shared room", "Hotel room"])


@query("ag04_dense_matrix", "AG-04 AR-01", """
SELECT r AS band, """ + ", ".join(f"count(*) FILTER (band = r AND places % 5 = {j}) AS \"{j}\"" for j in range(5)) + """
FROM agents, (SELECT unnest([0,1,2,3,4]) AS r) GROUP BY r""", ("agents",))
def dense_matrix(spark, folder):
    rows = standin(spark, folder, "agents").select("band", (c("places") % 5).alias("k"))
    return series.dense_matrix(rows, "band", "k", range(5), range(5), F.count(F.lit(1)))


@query("ag05_wide_to_long", "AG-05 AG-04", """
SELECT f.l_returnflag, y AS year, count(l_shipdate) AS lines FROM (SELECT DISTINCT l_returnflag FROM lineitem) f CROSS JOIN (SELECT unnest(range(1990, 2010))::INT AS y)
LEFT JOIN lineitem l ON l.l_returnflag = f.l_returnflag AND year(l_shipdate) = y GROUP BY 1, 2""")
def wide_to_long(spark, folder):
    rows = read(spark, folder, "lineitem").select("l_returnflag", F.year("l_shipdate").alias("y"))
    wide = series.long_to_wide(rows, "l_returnflag", "y", range(1990, 2010), F.count(F.lit(1)))
    long = series.wide_to_long(wide, ["l_returnflag"], "year", "lines")
    return long.withColumn("year", c("year").cast("int"))


MONTHLY_SQL = "monthly AS (SELECT l_returnflag AS category, cast(date_trunc('month', l_shipdate) as date) AS month_start, avg(l_extendedprice) AS adr FROM lineitem GROUP BY 1, 2)"


def monthly(spark, folder):
    return read(spark, folder, "lineitem").groupBy(
        c("l_returnflag").alias("category"), F.trunc("l_shipdate", "month").alias("month_start")).agg(F.avg("l_extendedprice").alias("adr"))


@query("ag06_normalised_ratio", "AG-06", f"""
WITH {MONTHLY_SQL} SELECT category, cast(month_start as varchar) AS month_start, round(adr / avg(adr) over (partition by category, year(month_start)), 6) AS ratio FROM monthly""")
def normalised_ratio(spark, folder):
    rows = monthly(spark, folder).withColumn("y", F.year("month_start"))
    return series.normalised(rows, "adr", ["category", "y"], "ratio").select(
        "category", c("month_start").cast("string").alias("month_start"), F.round("ratio", 6).alias("ratio"))


@query("ag07_seasonal_factors", "AG-07", f"""
WITH {MONTHLY_SQL}, r AS (SELECT category, month(month_start) AS month, adr / avg(adr) over (partition by category, year(month_start)) AS x FROM monthly WHERE year(month_start) >= 1997)
SELECT category, month::INT AS month, round(median(x), 6) AS factor, count(*) AS years FROM r GROUP BY 1, 2""")
def seasonal_factors(spark, folder):
    return series.seasonality(monthly(spark, folder), "category", "month_start", "adr", 1997).withColumn("factor", F.round("factor", 6))


@query("ag08_trailing_year", "AG-08", f"""
WITH {MONTHLY_SQL} SELECT category, round(avg(adr), 2) AS adr FROM monthly WHERE month_start >= (SELECT max(month_start) FROM monthly) - INTERVAL 11 MONTH GROUP BY 1""")
def trailing_year(spark, folder):
    return series.trailing_mean(monthly(spark, folder), "category", "month_start", "adr").withColumn("adr", F.round("adr", 2))


@query("ag09_last_twelve_totals", "AG-09", """
WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum((o_orderstatus='F')::INT) AS a, sum((o_orderstatus<>'F')::INT) AS b, sum(o_orderkey % 4) AS na, sum(o_orderkey % 3) AS nb FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 12)
SELECT min(month) AS since, max(month) AS until, sum(a+b)::BIGINT AS guests, sum(na+nb)::BIGINT AS nights, round(sum(na+nb)/sum(a+b), 4) AS mean_stay, round(sum(b)*100e0/sum(a+b), 4) AS foreign_pct, round(sum(na+nb)/365e0, 4) AS nights_per_day FROM m""")
def last_twelve_totals(spark, folder):
    f = (c("o_orderstatus") == "F").cast("long")
    rows = read(spark, folder, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.sum(f).alias("a"), F.sum(1 - f).alias("b"), F.sum(c("o_orderkey") % 4).alias("na"), F.sum(c("o_orderkey") % 3).alias("nb"))
    out = series.official_totals(rows, "month", "a", "b", "na", "nb")
    return out.withColumns({k: F.round(k, 4) for k in ("mean_stay", "foreign_pct", "nights_per_day")})


@query("ag10_percentiles", "AG-10", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.01), 4) AS p01, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(median(l_extendedprice), 4) AS p50,
 round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY 1""")
def percentiles(spark, folder):
    probs = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    out = exact_quantiles(read(spark, folder, "lineitem"), ["l_returnflag"], "l_extendedprice", probs)
    return out.withColumns({p: F.round(p, 4) for p in probs})


@query("ag11_weighted_quantiles", "AG-11", """
WITH x AS (SELECT l_extendedprice AS v, l_quantity AS w FROM lineitem), cum AS (SELECT v, sum(w) over (order by v) / (SELECT sum(w) FROM x) AS s FROM x)
SELECT min(v) FILTER (s >= 0.5) AS median, min(v) FILTER (s >= 0.9) AS p90 FROM cum""")
def weighted_quantiles(spark, folder):
    return exact_quantiles(read(spark, folder, "lineitem"), [], "l_extendedprice", {"median": 0.5, "p90": 0.9}, weight=c("l_quantity"), rule="reach")


@query("ag12_weighted_summary", "AG-12", """
SELECT sum(l_quantity) AS weight, round(sum(l_quantity*l_extendedprice)/sum(l_quantity), 4) AS mean, max(l_extendedprice) AS largest,
 round(sum(l_quantity) FILTER (l_discount > 0.05) * 100 / sum(l_quantity), 4) AS discounted FROM lineitem""")
def weighted_summary(spark, folder):
    out = aggregates.weighted_summary(read(spark, folder, "lineitem"), "l_extendedprice", "l_quantity", {"discounted": c("l_discount") > 0.05})
    return out.withColumns({"mean": F.round("mean", 4), "discounted": F.round("discounted", 4)})


@query("ag13_commonest_value", "AG-13", """
SELECT area, mode, n FROM (SELECT area, host_name AS mode, count(*) AS n, row_number() over (partition by area order by count(*) desc, host_name) AS rn FROM agents GROUP BY 1, 2) WHERE rn = 1 AND n >= 3""", ("agents",))
def commonest_value(spark, folder):
    return aggregates.mode(standin(spark, folder, "agents"), ["area"], "host_name", minimum=3)


@query("ag14_value_sets", "AG-14", f"""
WITH {LICENCE_SQL}, s AS (SELECT host_id, array_to_string(list_sort(list_distinct(list(prefix) FILTER (prefix is not null))), ',') AS prefixes FROM norm GROUP BY 1)
SELECT prefixes, contains(prefixes, 'HUTB') AS has_dwelling, count(*) AS hosts FROM s WHERE prefixes is not null GROUP BY 1, 2""", ("declared",))
def value_sets(spark, folder):
    sets = aggregates.value_sets(licensed(spark, folder), "host_id", "prefix", "p")
    return sets.groupBy(F.array_join("p", ",").alias("prefixes"), F.array_contains("p", "HUTB").alias("has_dwelling")).agg(F.count("*").alias("hosts"))


HOSTS_SQL = f"{UNLICENSED_SQL}, hs AS (SELECT host_id, list_sort(list_distinct(list(class))) AS cl FROM norm WHERE class <> 'none' GROUP BY 1), j AS (SELECT * FROM pend JOIN hs USING (host_id))"


@query("ag15_class_combinations", "AG-15", f"WITH {HOSTS_SQL} SELECT array_to_string(cl, ' + ') AS combination, max(len(cl))::INT AS classes, count(*) AS rows FROM j GROUP BY 1", ("declared",))
def class_combinations(spark, folder):
    rows, pending = unlicensed(spark, folder)
    return licences.host_class_combinations(pending, rows, "none")


@query("ag16_classes_of_hosts", "AG-16", f"""
WITH {HOSTS_SQL} SELECT k AS class, count(*) AS rows, round(count(*)*100e0/(SELECT count(*) FROM j), 2) AS pct FROM (SELECT unnest(cl) AS k FROM j) GROUP BY 1""", ("declared",))
def classes_of_hosts(spark, folder):
    rows, pending = unlicensed(spark, folder)
    return licences.host_class_counts(pending, rows, "none")


@query("ag17_null_profile", "AG-17", """
SELECT unnest(['id','price','bedrooms']) AS "column", unnest([0, count(*) FILTER (price is null), count(*) FILTER (bedrooms is null)]) AS nulls,
 unnest([0, round(count(*) FILTER (price is null)*100e0/count(*), 2), round(count(*) FILTER (bedrooms is null)*100e0/count(*), 2)]) AS pct FROM agents""", ("agents",))
def null_profile(spark, folder):
    return aggregates.null_profile(standin(spark, folder, "agents").select("id", "price", "bedrooms"))


@query("ag18_coverage_rates", "AG-18", """
SELECT unnest(['price','bedrooms']) AS "column", unnest([count(price), count(bedrooms)]) AS present, unnest([round(count(price)/count(*)::DOUBLE, 4), round(count(bedrooms)/count(*)::DOUBLE, 4)]) AS rate FROM agents""", ("agents",))
def coverage_rates(spark, folder):
    return aggregates.coverage_rates(standin(spark, folder, "agents"), ["price", "bedrooms"])


@query("ag19_correlations", "AG-19", """
SELECT a, b, round(r, 6) AS r FROM (SELECT unnest(['l_quantity','l_quantity','l_extendedprice']) AS a, unnest(['l_extendedprice','l_tax','l_tax']) AS b,
 unnest([corr(l_quantity, l_extendedprice), corr(l_quantity, l_tax), corr(l_extendedprice, l_tax)]) AS r FROM lineitem) WHERE abs(r) >= 0.0001""")
def correlations(spark, folder):
    out = aggregates.correlations(read(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], 0.0001)
    return out.withColumn("r", F.round("r", 6))


@query("ag20_functional_dependency", "AG-20", """
SELECT max(k)::BIGINT AS most, sum((k > 1)::INT)::BIGINT AS broken, count(*) AS keys, median(k) AS median FROM (SELECT count(DISTINCT segment) AS k FROM agents GROUP BY area)""", ("agents",))
def functional_dependency(spark, folder):
    return aggregates.determines(standin(spark, folder, "agents"), "area", "segment")


@query("ag24_shared_numbers", "AG-24", f"""
WITH {VERIFY_SQL} SELECT num::VARCHAR AS num, count(*) AS rows, count(DISTINCT host_id) AS holders FROM ver WHERE prefix = 'HUTB' AND NOT found GROUP BY 1 HAVING count(*) > 1""", VERIFY_USES)
def shared_numbers(spark, folder):
    false = looked_up(spark, folder).filter((c("prefix") == "HUTB") & ~c("found"))
    return aggregates.shared_values(false, "num", "host_id")


@query("ag25_inactive_split", "AG-25", f"""
WITH {LICENCE_SQL}, s AS (SELECT class, reviews_ltm = 0 AS f FROM norm)
SELECT coalesce(class, 'TOTAL') AS class, count(*) AS total, count(*) FILTER (f) AS flagged, round(count(*) FILTER (f)*100e0/count(*), 2) AS pct_of_category,
 round(count(*) FILTER (f)*100e0/(SELECT count(*) FROM s), 2) AS pct_of_all FROM s GROUP BY GROUPING SETS ((class), ())""", ("declared",))
def inactive_split(spark, folder):
    return aggregates.split_by_flag(licensed(spark, folder), "class", c("reviews_ltm") == 0)


@query("ag26_stages_by_class", "AG-26", f"""
WITH {LICENCE_SQL}, ch AS (SELECT *, coalesce(last_review >= date '1998-01-01', false) AS act FROM norm WHERE class in ('none','seasonal')),
k AS (SELECT class, act, case when act then row_number() over (partition by name, host_id, act order by id) end AS rn FROM ch)
SELECT coalesce(class, 'TOTAL') AS class, count(*) AS raw, count(*) FILTER (act) AS active, count(*) FILTER (rn = 1) AS distinct_rows FROM k GROUP BY ROLLUP (class)""", ("declared",))
def stages_by_class(spark, folder):
    return licences.stages_by_class(licensed(spark, folder), UNLICENSED, "1998-01-01")


@query("ag27_single_or_multi_hosts", "AG-27", f"""
WITH {UNLICENSED_SQL} SELECT case when n > 1 then 'several' else 'single' end AS hosts_with, count(*) AS hosts, sum(n)::BIGINT AS rows FROM
 (SELECT host_id, count(*) AS n FROM pend WHERE host_id NOT IN (SELECT host_id FROM norm WHERE class = 'hotel') GROUP BY 1) GROUP BY 1""", ("declared",))
def single_or_multi_hosts(spark, folder):
    rows, pending = unlicensed(spark, folder)
    return licences.single_or_multi(pending, rows.withColumn("class", F.when(c("class") == "hotel", "hotel").otherwise("none")), "none")


@query("ag28_host_price_evidence", "AG-28", """
WITH h AS (SELECT host_id, count(*) AS priced, avg(price) AS mean, median(price) AS median FROM agents WHERE price IS NOT NULL GROUP BY 1)
SELECT id, priced, round(mean, 4) AS mean, round(median, 3) AS median FROM agents LEFT JOIN h USING (host_id) WHERE price IS NULL""", ("agents",))
def host_price_evidence(spark, folder):
    rows = standin(spark, folder, "agents")
    priced = rows.filter("price is not null")
    stats = priced.groupBy("host_id").agg(F.count("*").alias("priced"), F.avg("price").alias("mean"))
    stats = stats.join(exact_quantiles(priced, ["host_id"], "price", {"median": 0.5}), "host_id")
    missing = rows.filter("price is null").select("id", "host_id")
    return spread_join(missing, stats, ["host_id"], how="left").select(
        "id", "priced", F.round("mean", 4).alias("mean"), F.round("median", 3).alias("median"))


@query("ag29_latent_capacity", "AG-29", f"""
WITH {SCOPE_SQL}, l AS (SELECT * FROM reasons WHERE reason = 'inactive' AND code in (SELECT code FROM registry))
SELECT 'year' AS by, cast(year(last_review) as varchar) AS value, count(*) AS rows, sum(places)::BIGINT AS capacity FROM l GROUP BY 2 UNION ALL
(SELECT 'area', cast(area as varchar), count(*), sum(places)::BIGINT FROM l GROUP BY area ORDER BY count(*) DESC, area LIMIT 10)""", ("declared", "registry"))
def latent_capacity(spark, folder):
    inactive = scoped(spark, folder).filter("reason = 'inactive'")
    latent = licences.in_registry(inactive, "code", "prefix", standin(spark, folder, "registry")).filter("found")
    by_year = licences.latent_capacity(latent, F.year("last_review").cast("string").alias("value"), "places")
    by_area = licences.latent_capacity(latent, c("area"), "places").orderBy(c("rows").desc(), "area").limit(10)
    return by_year.select(F.lit("year").alias("by"), "value", "rows", "capacity").unionByName(
        by_area.select(F.lit("area").alias("by"), c("area").cast("string").alias("value"), "rows", "capacity"))


@query("ag30_error_by_segment", "AG-30", """
WITH p AS (SELECT c_mktsegment AS segment, c_acctbal AS y, c_acctbal * 0.9 + (c_custkey % 50) AS e FROM customer)
SELECT segment, count(*) AS rows, round(avg(abs(e - y)), 4) AS mae, round(avg(e - y), 4) AS bias, round(median(y), 3) AS median_actual, round(avg(abs(e - y)) * 100 / median(y), 4) AS mape FROM p GROUP BY 1""")
def error_by_segment(spark, folder):
    rows = read(spark, folder, "customer").select(
        c("c_mktsegment").alias("segment"), c("c_acctbal").alias("y"), (c("c_acctbal") * 0.9 + c("c_custkey") % 50).alias("e"))
    out = aggregates.error_report(rows, "segment", "y", "e")
    return out.withColumns({"mae": F.round("mae", 4), "bias": F.round("bias", 4), "median_actual": F.round("median_actual", 3), "mape": F.round("mape", 4)})


@query("ag31_registry_profile", "AG-31", """
SELECT count(*) AS licences, sum(places)::BIGINT AS capacity, max(split_part(code, '-', 2)::BIGINT) AS highest, min(regexp_extract(case_no, '-(\\d{4})-', 1)::INT) AS first_year,
 count(*) FILTER (regexp_extract(case_no, '-(\\d{4})-', 1)::INT BETWEEN 2012 AND 2014) AS in_range, median(places) AS median_capacity FROM registry""", ("registry",))
def registry_profile(spark, folder):
    return licences.registry_profile(standin(spark, folder, "registry"), "code", "places", numeric.case_year(c("case_no")), 2012, 2014)


@query("ag31_licences_by_district", "AG-31 STR-21", """
SELECT concat(substr(district, 1, 1), lower(substr(district, 2))) AS district, count(*) AS licences FROM registry GROUP BY 1""", ("registry",))
def licences_by_district(spark, folder):
    from hostelry.functions.text import display_name

    return standin(spark, folder, "registry").groupBy(display_name(c("district")).alias("district")).agg(F.count("*").alias("licences"))


@query("ag32_missing_bucket", "AG-32", """
SELECT coalesce(category, 'Sin categoria') AS category, count(*) AS sites, sum(rooms)::BIGINT AS rooms FROM sites GROUP BY 1""", ("sites",))
def missing_bucket(spark, folder):
    return standin(spark, folder, "sites").groupBy(F.coalesce("category", F.lit("Sin categoria")).alias("category")).agg(
        F.count("*").alias("sites"), F.sum("rooms").alias("rooms"))


# ---------------------------------------------------------------- series

SNAP_SQL = """
snap AS (SELECT DISTINCT strftime(date_trunc('week', ts), '%Y-%m-%d') AS period, user_id FROM events),
p AS (SELECT period, row_number() over (order by period) AS i FROM (SELECT DISTINCT period FROM snap)), s AS (SELECT i, user_id FROM snap JOIN p USING (period)),
flow AS (SELECT p.period, p.i, (SELECT count(*) FROM s WHERE s.i = p.i) AS stock,
 case when p.i > 1 then (SELECT count(*) FROM s WHERE s.i = p.i AND user_id NOT IN (SELECT user_id FROM s z WHERE z.i = p.i - 1)) end AS inflow,
 case when p.i > 1 then (SELECT count(*) FROM s WHERE s.i = p.i - 1 AND user_id NOT IN (SELECT user_id FROM s z WHERE z.i = p.i)) end AS outflow FROM p)"""


def snapshots(spark, folder):
    return read(spark, folder, "events").select(
        F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("period"), "user_id")


@query("ser01_stock_and_flow", "SER-01 SET-03", f"WITH {SNAP_SQL} SELECT period, stock, inflow, outflow, inflow - outflow AS net FROM flow")
def stock_and_flow(spark, folder):
    return series.stock_and_flow(snapshots(spark, folder), "period", "user_id")


@query("ser02_series_span", "SER-02", f"""
WITH {SNAP_SQL} SELECT min(period) AS first_period, arg_min(stock, period) AS first_value, (SELECT period FROM flow ORDER BY stock, period LIMIT 1) AS lowest_period, min(stock) AS lowest_value, max(period) AS last_period, arg_max(stock, period) AS last_value FROM flow""")
def series_span(spark, folder):
    return series.span(series.stock_and_flow(snapshots(spark, folder), "period", "user_id"), "period", "stock")


@query("set03_added_and_removed", "SET-03", f"WITH {SNAP_SQL} SELECT sum(inflow)::BIGINT AS added, sum(outflow)::BIGINT AS removed FROM flow")
def added_and_removed(spark, folder):
    return series.stock_and_flow(snapshots(spark, folder), "period", "user_id").agg(F.sum("inflow").alias("added"), F.sum("outflow").alias("removed"))


# ---------------------------------------------------------------- incremental

@query("inc01_pending_rows", "INC-01 WD-10", """
SELECT c_custkey, c_nationkey = 3 AS first_area FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)""")
def pending_rows(spark, folder):
    rows = read(spark, folder, "customer").select("c_custkey", (c("c_nationkey") == 3).alias("first_area"))
    done = read(spark, folder, "orders").filter("o_totalprice > 200000").select(c("o_custkey").alias("c_custkey"))
    return incremental.pending(rows, done, "c_custkey", c("first_area"))


@query("inc02_moved_rows", "INC-02", f"""
WITH {VERIFY_SQL}, s AS (SELECT id, case when why in ('unverifiable','found') then null else 'no_proven_licence' end AS reason FROM ver)
SELECT reason, count(*) AS rows, sum(id)::BIGINT AS ids FROM s GROUP BY 1""", VERIFY_USES)
def moved_rows(spark, folder):
    from hostelry.operators.projection import move_by_reason

    rows = verified(spark, folder).select("id", "state", F.lit(None).cast("string").alias("reason"))
    once = move_by_reason(rows, c("state") == licences.WITH_LICENCE, "reason", "no_proven_licence")
    again = move_by_reason(once, c("state") == licences.WITH_LICENCE, "reason", "moved twice")
    return again.groupBy("reason").agg(F.count("*").alias("rows"), F.sum("id").alias("ids"))


@query("inc03_surrogate_keys", "INC-03", """
WITH k AS (SELECT s_name AS holder, s_suppkey + 1 AS n FROM supplier WHERE s_nationkey < 12), f AS (SELECT s_name AS holder FROM supplier WHERE s_nationkey >= 12 UNION SELECT c_name FROM customer)
SELECT holder, n FROM k UNION ALL SELECT holder, (SELECT max(n) FROM k) + row_number() over (order by holder) FROM f""")
def surrogate_keys(spark, folder):
    firms = read(spark, folder, "supplier")
    known = firms.filter("s_nationkey < 12").select(c("s_name").alias("holder"), (c("s_suppkey") + 1).alias("n"))
    rows = firms.select(c("s_name").alias("holder")).unionByName(read(spark, folder, "customer").select(c("c_name").alias("holder")))
    return incremental.surrogate_keys(known, rows, "holder", "n")
