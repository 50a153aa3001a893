"""Text expressions, each through a table-level result."""

from pyspark.sql import functions as F

from hostelry.functions import licence, numeric, text
from hostelry.registry.core import query
from hostelry.registry.fixtures import read, standin

FOLD_SQL = r"regexp_replace(upper(strip_accents({0})), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')"


@query("str01_folded_upper_text", "STR-01", r"""
SELECT lang, count(DISTINCT f) AS texts, sum(length(f))::BIGINT AS chars,
       sum(length(f) - length(replace(f, 'E', '')))::BIGINT AS es
FROM (SELECT lang, regexp_replace(upper(strip_accents(replace(concat(text, case doc_id % 3 when 0 then ' Άθήνα Ή' when 1 then ' Йод ёлка' else ' x' end), 'ß', 'ss'))), '[^\p{L}\p{N}_\s]', ' ', 'g') AS f
      FROM documents) GROUP BY lang""")
def folded_upper(spark, folder):
    # the engines write the capital of this letter in two ways
    messy = F.expr("concat(text, case doc_id % 3 when 0 then ' Άθήνα Ή' when 1 then ' Йод ёлка' else ' x' end)")
    f = text.fold_upper(F.replace(messy, F.lit("ß"), F.lit("ss")))
    return read(spark, folder, "documents").select("lang", f.alias("f")).groupBy("lang").agg(
        F.count_distinct("f").alias("texts"), F.sum(F.length("f")).alias("chars"),
        F.sum(F.length("f") - F.length(F.replace(F.col("f"), F.lit("E"), F.lit("")))).alias("es"),
    )


@query("str02_name_key_groups", "STR-02", """
SELECT k, count(*) AS rows, min(p_partkey) AS first_part FROM (
  SELECT p_partkey, trim(regexp_replace(replace(lower(strip_accents(
    case p_partkey % 5 when 0 then upper(p_name) when 1 then replace(p_name, 'e', 'é') when 2 then concat(chr(9), p_name, ' Ά Й', chr(10))
    when 3 then concat(p_name, ' ﬁn') else concat(' ', p_name, '!') end)), 'ﬁ', 'fi'),
    '[^a-z0-9]+', ' ', 'g')) AS k FROM part) GROUP BY k""")
def name_key_groups(spark, folder):
    messy = F.expr("case p_partkey % 5 when 0 then upper(p_name) when 1 then replace(p_name, 'e', 'é')"
                   " when 2 then concat(char(9), p_name, ' Ά Й', char(10)) when 3 then concat(p_name, ' ﬁn')"
                   " else concat(' ', p_name, '!') end")
    return (
        read(spark, folder, "part").select("p_partkey", text.name_key(messy).alias("k"))
        .groupBy("k").agg(F.count("*").alias("rows"), F.min("p_partkey").alias("first_part"))
    )


# An address table: town, road type in either column or in both, number ranges, units.
ADDRESS = {
    "id": "o_orderkey",
    "town": "case when o_orderkey % 29 = 0 then null when o_orderkey % 2 = 0 then 'Sant Cugat' else 'SANT CUGÀT' end",
    "road_type": "case o_orderkey % 5 when 0 then 'C' when 1 then 'Carrer' when 2 then 'Avgda' when 3 then '' else null end",
    "road_name": "concat(case o_orderkey % 3 when 0 then 'Carrer de la ' when 1 then 'de l''' else '' end, 'Lloç ',"
                 " cast(o_custkey % 60 as varchar(20)))",
    "number": "case when o_orderkey % 31 = 0 then null when o_orderkey % 4 = 0 then concat(cast(o_custkey % 20 as"
              " varchar(20)), '-', cast(o_custkey % 20 + 2 as varchar(20))) else cast(o_custkey % 20 as varchar(20)) end",
    "floor": "case o_orderkey % 4 when 0 then '01' when 1 then '1' when 2 then 'Bx' else '0' end",
    "door": "case o_orderkey % 3 when 0 then '02' else 'A' end",
}
ADDRESS_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in ADDRESS.items()) + " FROM orders"
STREET_SQL = """
src AS (%s),
tok AS (SELECT *, list_filter(regexp_split_to_array(trim(regexp_replace(upper(strip_accents(
   concat(coalesce(road_type,''),' ',coalesce(road_name,'')))), '[^\\p{L}\\p{N}_\\s]', ' ', 'g')), '\\s+'), lambda w: w <> '') AS t
   FROM src),
typ AS (SELECT unnest(['C','CARRER','AVGDA']) AS a, unnest(['CARRER','CARRER','AVINGUDA']) AS c),
can AS (SELECT tok.*, t1.c AS c1, t2.c AS c2 FROM tok LEFT JOIN typ t1 ON t1.a = t[1] LEFT JOIN typ t2 ON t2.a = t[2]),
st AS (SELECT *, trim(concat(coalesce(c1,''), ' ', array_to_string(list_filter(
   t[case when c1 is null then 1 when c2 = c1 then 3 else 2 end:],
   lambda w: w NOT IN ('DE','DEL','DELS','D','LA','EL','ELS','LES','L')), ' '))) AS street,
   regexp_extract(coalesce(number,''), '(\\d+)', 1) AS num,
   trim(upper(strip_accents(coalesce(town,'')))) AS twn,
   coalesce(nullif(ltrim(upper(floor), '0'), ''), upper(floor)) AS flr,
   coalesce(nullif(ltrim(upper(door), '0'), ''), upper(door)) AS dor FROM can)
""" % ADDRESS_SQL


def addresses(spark, folder):
    return read(spark, folder, "orders").selectExpr(*[f"{e} AS {c}" for c, e in ADDRESS.items()])


@query("str03_street_normaliser", "STR-03", f"WITH {STREET_SQL} SELECT street, count(*) AS rows FROM st GROUP BY street")
def street_normaliser(spark, folder):
    rows = addresses(spark, folder).select(text.street(F.col("road_type"), F.col("road_name")).alias("street"))
    return rows.groupBy("street").agg(F.count("*").alias("rows"))


@query("str04_first_house_number", "STR-04",
       f"WITH {STREET_SQL} SELECT num, count(*) AS rows FROM st GROUP BY num")
def first_house_number(spark, folder):
    rows = addresses(spark, folder).select(text.first_number(F.col("number")).alias("num"))
    return rows.groupBy("num").agg(F.count("*").alias("rows"))


@query("str05_unit_normaliser", "STR-05",
       f"WITH {STREET_SQL} SELECT flr, dor, count(*) AS rows FROM st GROUP BY flr, dor")
def unit_normaliser(spark, folder):
    rows = addresses(spark, folder).select(text.unit(F.col("floor")).alias("flr"), text.unit(F.col("door")).alias("dor"))
    return rows.groupBy("flr", "dor").agg(F.count("*").alias("rows"))


@query("str06_address_key_groups", "STR-06", f"""
WITH {STREET_SQL} SELECT case when twn <> '' and street <> '' and num <> '' then
  concat(twn,'|',street,'|',num,'|',flr,'|',dor) end AS k, count(*) AS rows, min(id) AS first_id FROM st GROUP BY 1""")
def address_key_groups(spark, folder):
    c = F.col
    k = text.address_key(c("town"), c("road_type"), c("road_name"), c("number"), c("floor"), c("door"))
    return addresses(spark, folder).select("id", k.alias("k")).groupBy("k").agg(
        F.count("*").alias("rows"), F.min("id").alias("first_id"))


@query("str07_name_similarity", "STR-07", """
WITH w AS (SELECT p_partkey, list_distinct(list_filter(string_split(upper(p_name), ' '), lambda x: x <> 'HOTEL')) AS a,
  list_distinct(list_filter(string_split(upper(concat('Hotel ', split_part(p_name, ' ', 1), ' ', p_type)), ' '),
  lambda x: x <> 'HOTEL')) AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / least(len(a), len(b))::DOUBLE, 4) AS similarity FROM w""")
def name_similarity(spark, folder):
    other = F.concat(F.lit("Hotel "), F.split("p_name", " ").getItem(0), F.lit(" "), F.col("p_type"))
    return read(spark, folder, "part").select(
        "p_partkey", F.round(text.name_similarity(F.col("p_name"), other), 4).alias("similarity"))


CODES = ("case o_orderkey % 5 when 0 then concat('HUTB- ', cast(o_custkey as varchar(20))) when 1 then"
         " concat(' hb-', cast(o_custkey as varchar(20)), ' ') when 2 then '  ' when 3 then null"
         " else concat('Hotel chic ', cast(o_orderkey % 9 as varchar(20)), ' - HB', cast(o_custkey as varchar(20))) end")


@query("str08_code_normaliser", "STR-08", f"""
SELECT code, count(*) AS rows FROM (SELECT nullif(upper(regexp_replace({CODES}, '\\s+', '', 'g')), '') AS code
FROM orders) GROUP BY code""")
def code_normaliser(spark, folder):
    rows = read(spark, folder, "orders").select(text.clean_code(F.expr(CODES)).alias("code"))
    return rows.groupBy("code").agg(F.count("*").alias("rows"))


@query("str09_embedded_code", "STR-09", f"""
SELECT code, count(*) AS rows FROM (SELECT nullif(regexp_replace(upper(regexp_extract(coalesce({CODES}, ''),
  '\\b((?:HUTB|HCC|ATCC|HB|ATB)-?\\d+)\\b', 1, 'i')), '^([A-Z]+)(\\d)', '\\1-\\2'), '') AS code FROM orders) GROUP BY code""")
def embedded_code(spark, folder):
    rows = read(spark, folder, "orders").select(text.embedded_code(F.expr(CODES)).alias("code"))
    return rows.groupBy("code").agg(F.count("*").alias("rows"))


LICENCE_SQL = """
lic AS (SELECT *, nullif(trim(regexp_extract(coalesce(license,''),
   'Barcelona\\s*-\\s*Regional registration number\\s*(?:<br\\s*/?>)*\\s*([^<]*)', 1, 'i')), '') AS regional FROM declared),
can AS (SELECT *, case when regexp_matches(regional, '^[A-Za-z]+[-\\s]*\\d+$') then
   concat(upper(regexp_extract(regional, '^([A-Za-z]+)', 1)), '-', lpad(regexp_extract(regional, '(\\d+)$', 1)::BIGINT::VARCHAR, 6, '0')) end AS code,
   case when regional is not null and upper(regional) like 'HUT%' then 'dwelling'
        when upper(regional) like 'HB%' or upper(regional) like 'HCC%' then 'hotel'
        when upper(regional) like 'AJ%' then 'hostel' when upper(regional) like 'AT%' then 'apartments'
        when upper(regional) like '%EXEMPT%' then 'exempt'
        when license like '%ESFCTU%' or license like '%ESHFTU%' then 'dwelling'
        when license like '%ESFCNT%' or license like '%ESHFNT%' then 'seasonal' else 'none' end AS class FROM lic),
norm AS (SELECT *, split_part(code, '-', 1) AS prefix, split_part(code, '-', 2)::BIGINT AS num FROM can)
"""


def licensed(spark, folder):
    """Declared listings with section, canonical code, prefix, number and class."""
    rows = standin(spark, folder, "declared")
    rows = rows.withColumn("regional", licence.regional_section(F.col("license"), "Barcelona"))
    rows = rows.withColumn("code", licence.canonical(F.col("regional")))
    return rows.withColumns({
        "prefix": licence.prefix(F.col("code")),
        "num": licence.number(F.col("code")),
        "class": licence.classify(F.col("license"), F.col("regional")),
    })


@query("str10_regional_section", "STR-10",
       f"WITH {LICENCE_SQL} SELECT regional, count(*) AS rows FROM lic GROUP BY regional", ("declared",))
def regional_section(spark, folder):
    return licensed(spark, folder).groupBy("regional").agg(F.count("*").alias("rows"))


@query("str11_canonical_licence", "STR-11",
       f"WITH {LICENCE_SQL} SELECT code, prefix, count(*) AS rows FROM norm GROUP BY code, prefix", ("declared",))
def canonical_licence(spark, folder):
    return licensed(spark, folder).groupBy("code", "prefix").agg(F.count("*").alias("rows"))


@query("str12_licence_classes", "STR-12 AG-02", f"""
WITH {LICENCE_SQL} SELECT class, count(*) AS rows,
 round(count(*)*100e0/(SELECT count(*) FROM norm), 2) AS pct FROM norm GROUP BY class""", ("declared",))
def licence_classes(spark, folder):
    from hostelry.operators.aggregates import frequency

    return frequency(licensed(spark, folder), ["class"])


@query("str13_filler_numbers", "STR-13", f"""
WITH {LICENCE_SQL} SELECT num::VARCHAR AS number, count(*) AS rows FROM norm WHERE num is not null and
 (len(list_distinct(string_split(num::VARCHAR, ''))) = 1 or contains('0123456789', num::VARCHAR)
  or contains('9876543210', num::VARCHAR)) GROUP BY 1""", ("declared",))
def filler_numbers(spark, folder):
    rows = licensed(spark, folder).filter(licence.is_filler(F.col("num")))
    return rows.groupBy(F.col("num").alias("number")).agg(F.count("*").alias("rows"))


POSTAL = ("case c_custkey % 4 when 0 then concat(cast(8000 + c_custkey % 40 as varchar(20)), '.0') when 1 then"
          " concat('E-0', cast(8000 + c_custkey % 40 as varchar(20))) when 2 then 'none' else null end")


@query("str14_postcodes", "STR-14", f"""
SELECT postcode, count(*) AS rows FROM (SELECT case when d <> '' then lpad(d, 5, '0') end AS postcode FROM
 (SELECT regexp_replace(split_part({POSTAL}, '.', 1), '\\D', '', 'g') AS d FROM customer)) GROUP BY postcode""")
def postcodes(spark, folder):
    rows = read(spark, folder, "customer").select(text.postcode(F.expr(POSTAL)).alias("postcode"))
    return rows.groupBy("postcode").agg(F.count("*").alias("rows"))


HOTEL_NAMES = ("case s_suppkey % 8 when 0 then 'Hotel Barceló Raval' when 1 then 'Chic & Basic Born' when 2 then"
               " 'Hostal Pensió Nova' when 3 then 'Pensión Sol' when 4 then 'NH Hesperia' when 5 then 'Room  Mate Anna'"
               " when 6 then 'Suites Avenue' else s_name end")


@query("str15_chain_and_subtype", "STR-15", f"""
WITH n AS (SELECT s_suppkey, lower(strip_accents({HOTEL_NAMES})) AS t FROM supplier)
SELECT s_suppkey, case when regexp_matches(t, '\\bnh\\b') then 'NH' when regexp_matches(t, '\\bbarcelo\\b') then 'Barcelo'
  when regexp_matches(t, '\\bchic\\s*(&|and)\\s*basic\\b') then 'Chic & Basic' when regexp_matches(t, '\\bhesperia\\b')
  then 'Hesperia' when regexp_matches(t, '\\broom\\s*mate\\b') then 'Room Mate' else 'Independiente' end AS chain,
  case when regexp_matches(t, 'hostal|hostel|alberg') then 'hostal' when regexp_matches(t, 'pensio|pension') then 'pension'
  when regexp_matches(t, 'suites') then 'apartamentos' else 'sin_indicio' end AS subtype FROM n""")
def chain_and_subtype(spark, folder):
    t = text.both_names(F.expr(HOTEL_NAMES), F.lit(None).cast("string"))
    return read(spark, folder, "supplier").select(
        "s_suppkey", text.first_label(t, text.CHAINS, "Independiente").alias("chain"),
        text.first_label(t, text.SUBTYPES, "sin_indicio").alias("subtype"))


SIGNS = ("case p_partkey % 5 when 0 then 'Starbucks Coffee' when 1 then 'MC DONALD''S' when 2 then 'Café ''Zürich''' when 3"
         " then '--' else p_name end")


@query("str16_brands", "STR-16", f"""
SELECT b AS brand, count(*) AS rows FROM (SELECT nullif(replace(case when t = 'STARBUCKS COFFEE' then 'STARBUCKS' else t end,
 'MC DONALDS', 'MCDONALDS'), '') AS b FROM (SELECT trim(regexp_replace(upper(strip_accents({SIGNS})), '[^A-Z0-9& ]', '', 'g'))
 AS t FROM part)) GROUP BY b""")
def brands(spark, folder):
    rows = read(spark, folder, "part").select(text.brand(F.expr(SIGNS)).alias("brand"))
    return rows.groupBy("brand").agg(F.count("*").alias("rows"))


@query("str17_company_names", "STR-17", """
SELECT company, count(*) AS rows FROM (SELECT case when lower(trim(owner)) <> 'no aplica' then nullif(regexp_replace(
  upper(trim(regexp_replace(owner, '\\(.*?\\)', '', 'g'), ' .,')), '\\s+', ' ', 'g'), '') end AS company FROM sites) GROUP BY company""",
       ("sites",))
def company_names(spark, folder):
    rows = standin(spark, folder, "sites").select(text.company(F.col("owner")).alias("company"))
    return rows.groupBy("company").agg(F.count("*").alias("rows"))


@query("str18_identifiers", "STR-18", """
SELECT lid, count(*) AS rows FROM (SELECT substr(lower(trim(case when p_partkey % 2 = 0 then concat('{', upper(md5(p_brand)), '-ABCDE}')
 else concat(md5(p_brand), '-abcde') end, '{}')), 1, 36) AS lid FROM part) GROUP BY lid""")
def identifiers(spark, folder):
    raw = F.expr("case when p_partkey % 2 = 0 then concat('{', upper(md5(p_brand)), '-ABCDE}')"
                 " else concat(md5(p_brand), '-abcde') end")
    rows = read(spark, folder, "part").select(text.identifier(raw).alias("lid"))
    return rows.groupBy("lid").agg(F.count("*").alias("rows"))


@query("str19_sentinels_and_suffixes", "STR-19", """
SELECT name, identified, count(*) AS rows FROM (SELECT case when upper(trim(n)) <> 'SN' then n end AS name,
 not ends_with(a, 'LOC NA') AS identified FROM (SELECT case when p_partkey % 6 = 0 then ' sn ' else p_name end AS n,
 concat('STREET LOC ', case when p_partkey % 9 = 0 then 'NA' else cast(p_partkey as varchar(20)) end) AS a FROM part)) GROUP BY 1, 2""")
def sentinels(spark, folder):
    rows = read(spark, folder, "part").selectExpr(
        "case when p_partkey % 6 = 0 then ' sn ' else p_name end AS n",
        "concat('STREET LOC ', case when p_partkey % 9 = 0 then 'NA' else cast(p_partkey as varchar(20)) end) AS a")
    return rows.groupBy(text.without_sentinel(F.col("n")).alias("name"),
                        (~F.col("a").endswith("LOC NA")).alias("identified")).agg(F.count("*").alias("rows"))


@query("str20_single_category_lookup", "STR-20", """
SELECT case p_type when 'ECONOMY' then 'cheap' when 'SMALL' then 'little' else 'shiny' end AS label, count(*) AS rows
FROM part WHERE p_type IN ('ECONOMY', 'SMALL', 'PROMO') GROUP BY 1""")
def single_category_lookup(spark, folder):
    from hostelry.operators.projection import select_by_category

    rows = select_by_category(read(spark, folder, "part"), "p_type",
                              {"econ": "cheap", "small": "little", "promo": "shiny"}, "label")
    return rows.groupBy("label").agg(F.count("*").alias("rows"))


@query("str21_display_names", "STR-21", r"""
SELECT case s when 'BUILDING' then 'Edificis' else array_to_string(list_transform(regexp_extract_all(s, '(\p{L}+|[^\p{L}]+)'),
 lambda r: concat(upper(r[1]), lower(r[2:]))), '') end AS label, count(*) AS rows FROM (SELECT concat(c_mktsegment, case c_custkey % 5 when 0 then ''
 when 1 then '-MARTÍ' when 2 then ' L''EIXAMPLE (DRETA)' when 3 then ' 3RD ÉTAGE' else ' o''neil' end) AS s FROM customer) GROUP BY 1""")
def display_names(spark, folder):
    rows = read(spark, folder, "customer").select(
        text.display_name(F.expr(
            "concat(c_mktsegment, case c_custkey % 5 when 0 then '' when 1 then '-MARTÍ' when 2 then ' L\\'EIXAMPLE (DRETA)'"
            " when 3 then ' 3RD ÉTAGE' else ' o\\'neil' end)"), {"BUILDING": "Edificis"}).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("rows"))


@query("str22_address_lines", "STR-22", f"""
SELECT line, count(*) AS rows FROM (SELECT trim(concat(trim(concat(coalesce(road_type,''),' ',coalesce(road_name,''))), ' ',
 trim(split_part(coalesce(number,''),'-',1)), ', ', trim(coalesce(town,''))), ' ,') AS line FROM ({ADDRESS_SQL})) GROUP BY line""")
def address_lines(spark, folder):
    c = F.col
    rows = addresses(spark, folder).select(
        text.address_line(c("road_type"), c("road_name"), c("number"), c("town")).alias("line"))
    return rows.groupBy("line").agg(F.count("*").alias("rows"))


@query("str23_bracket_tails", "STR-23", """
SELECT regexp_replace(s, ' \\(.*\\)', '', 'g') AS label, count(*) AS rows FROM (SELECT concat(c_mktsegment, ' (',
 cast(c_custkey % 3 as varchar(20)), ' of 3)') AS s FROM customer) GROUP BY 1""")
def bracket_tails(spark, folder):
    s = F.expr("concat(c_mktsegment, ' (', cast(c_custkey % 3 as varchar(20)), ' of 3)')")
    rows = read(spark, folder, "customer").select(text.without_bracket_tail(s).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("rows"))


@query("dt01_coerced_dates", "DT-01 DT-04 DT-05", """
SELECT y AS year, count(*) AS rows, sum((d >= date '2000-01-01')::INT)::BIGINT AS active, sum((d is null)::INT)::BIGINT AS never FROM
 (SELECT d, year(d) AS y FROM (SELECT try_cast(case when o_orderkey % 7 = 0 then 'not a date' else strftime(o_orderdate, '%Y-%m-%d') end AS DATE) AS d
  FROM orders)) GROUP BY y""")
def coerced_dates(spark, folder):
    raw = F.expr("case when o_orderkey % 7 = 0 then 'not a date' else date_format(o_orderdate, 'yyyy-MM-dd') end")
    rows = read(spark, folder, "orders").select(numeric.to_date(raw).alias("d"))
    return rows.groupBy(F.year("d").alias("year")).agg(
        F.count("*").alias("rows"),
        F.sum(F.coalesce(F.col("d") >= F.lit("2000-01-01").cast("date"), F.lit(None)).cast("long")).alias("active"),
        F.sum(F.col("d").isNull().cast("long")).alias("never"))


@query("dt02_month_labels", "DT-02", """
SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start, count(*) AS rows FROM orders GROUP BY 1""")
def month_labels(spark, folder):
    label = F.date_format("o_orderdate", "MMM yyyy")
    rows = read(spark, folder, "orders").select(numeric.month_label_date(label).cast("string").alias("month_start"))
    return rows.groupBy("month_start").agg(F.count("*").alias("rows"))


@query("dt03_offset_timestamps", "DT-03", """
SELECT strftime(ts - INTERVAL 2 HOUR, '%Y-%m') AS month, count(*) AS rows FROM events GROUP BY 1""")
def offset_timestamps(spark, folder):
    raw = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+02:00"))
    rows = read(spark, folder, "events").select(numeric.utc_month(raw).alias("month"))
    return rows.groupBy("month").agg(F.count("*").alias("rows"))


@query("dt04_case_years", "DT-04", """
SELECT regexp_extract(case_no, '-(\\d{4})-', 1)::INT AS year, count(*) AS cases FROM registry GROUP BY 1""", ("registry",))
def case_years(spark, folder):
    return standin(spark, folder, "registry").groupBy(numeric.case_year(F.col("case_no")).alias("year")).agg(
        F.count("*").alias("cases"))


@query("dt06_occupied_nights", "DT-06", """
SELECT area, sum(greatest(0, least(365, 365 - availability)))::BIGINT AS nights FROM agents GROUP BY area""", ("agents",))
def occupied_nights(spark, folder):
    return standin(spark, folder, "agents").groupBy("area").agg(
        F.sum(numeric.occupied_nights(F.col("availability"))).alias("nights"))
