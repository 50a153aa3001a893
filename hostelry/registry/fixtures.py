"""Stand-in tables derived by arithmetic from the given tables.

Every expression is valid in both engines, so both sides of a comparison start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _geo(k: str) -> list[tuple[str, str]]:
    return [
        ("lat", f"4132e-2 + (({k}*7919) % 1500)/4e4"),
        ("lon", f"205e-2 + (({k}*104729) % 1900)/4e4"),
    ]


_REGION = "Barcelona - Regional registration number<br />"
_NATION = "<br /><br />Spain - National registration number<br />"

TABLES: dict[str, tuple[str, list[tuple[str, str]]]] = {
    # short lets
    "agents": ("customer", [
        ("id", "c_custkey"),
        ("host_id", "c_custkey % 97"),
        ("host_name", "concat('Host ', cast(c_custkey % 97 as varchar(20)))"),
        ("area", "cast(c_nationkey as bigint)"),
        *_geo("c_custkey"),
        ("bedrooms", "nullif(c_custkey % 5, 0)"),
        ("places", "2 + c_custkey % 6"),
        ("price", "case when c_custkey % 23 = 0 then null else c_acctbal end"),
        ("place_price", "case when c_custkey % 23 = 0 then null else 15e0 + c_acctbal/8e1 end"),
        ("band", "c_custkey % 4"),
        ("availability", "(c_custkey*53) % 420"),
        ("segment", "c_mktsegment"),
    ]),
    # hotels
    "sites": ("supplier", [
        ("id", "s_suppkey"),
        ("name", "s_name"),
        ("area", "cast(s_nationkey as bigint)"),
        *_geo("(s_suppkey+13)"),
        ("rooms", "20 + s_suppkey % 80"),
        ("places", "2*(20 + s_suppkey % 80) - s_suppkey % 7"),
        ("band", "1 + s_suppkey % 3"),
        ("category", "case s_suppkey % 7 when 0 then '5 estrelles' when 1 then '4 estrelles superior'"
                     " when 2 then '4 estrelles' when 3 then '3 estrelles' when 4 then '1 estrella'"
                     " when 5 then 'Sense categoritzar' else null end"),
        ("kind", "case when s_suppkey % 11 = 0 then 'apartament_turistic' else 'hotel' end"),
        ("owner", "case when s_suppkey % 9 = 0 then 'No aplica'"
                  " else concat('Company ', cast(s_suppkey % 13 as varchar(20)), ' S.L. (rotulo)') end"),
    ]),
    # food sites
    "food": ("part", [
        ("id", "p_partkey"),
        ("name", "p_name"),
        ("brand", "p_brand"),
        ("kind", "p_type"),
        ("area", "p_partkey % 25"),
        *_geo("(p_partkey+29)"),
        ("visited", "date '2023-01-01' + cast((p_partkey*37) % 700 as int)"),
    ]),
    # rectangles standing for areas
    "polys": ("nation", [
        ("id", "cast(n_nationkey as bigint)"),
        ("name", "n_name"),
        ("region", "cast(n_regionkey as bigint)"),
        ("lat0", "4132e-2 + cast(floor(n_nationkey/5e0) as int)*75e-4"),
        ("lat1", "4132e-2 + (cast(floor(n_nationkey/5e0) as int) + 1)*75e-4"),
        ("lon0", "205e-2 + (n_nationkey % 5)*95e-4"),
        ("lon1", "205e-2 + (n_nationkey % 5 + 1)*95e-4"),
    ]),
    # listings that declare a licence
    "declared": ("orders", [
        ("id", "o_orderkey"),
        ("host_id", "o_custkey"),
        ("name", "concat('Flat ', cast(o_orderkey % 6 as varchar(20)))"),
        ("area", "o_custkey % 25"),
        ("room_type", "case when o_orderkey % 41 = 0 then 'Hotel room' when o_orderkey % 5 < 3 then"
                      " 'Entire home/apt' when o_orderkey % 5 = 3 then 'Private room' else 'Shared room' end"),
        ("price", "floor(o_totalprice/5e4)*1e2"),
        ("places", "2 + o_orderkey % 6"),
        ("min_nights", "case when o_orderkey % 17 = 0 then null when o_orderkey % 13 = 0 then 32 + o_orderkey % 400"
                       " else 1 + o_orderkey % 31 end"),
        ("last_review", "case when o_orderkey % 19 = 0 then null else cast(o_orderdate as date) end"),
        ("reviews_ltm", "o_orderkey % 4"),
        ("license",
         f"case o_orderkey % 7 when 0 then '{_REGION}Exempt{_NATION}ESFCTU0000HUTB-1' when 1 then null"
         f" when 2 then concat('{_REGION}HB-', cast(o_custkey % 500 as varchar(20)))"
         " when 3 then 'ESFCNT00080'"
         f" when 4 then concat('{_REGION}AJ000', cast(o_custkey % 90 as varchar(20)), '{_NATION}ESHFTU')"
         f" when 5 then case when o_orderkey % 10 = 0 then '{_REGION}HUTB-111111' else"
         f" concat('{_REGION}HUTB-', lpad(cast(o_custkey as varchar(20)), 6, '0')) end"
         f" else concat('{_REGION}hutb-', cast(case when o_orderkey % 11 = 0 then o_custkey + 900000"
         " else o_custkey end as varchar(20))) end"),
    ]),
    # official licence registry
    "registry": ("customer", [
        ("code", "concat('HUTB-', lpad(cast(c_custkey + case when c_custkey % 10 = 0 then 500000 else 0 end as varchar(20)), 6, '0'))"),
        ("holder", "c_custkey % 97"),
        ("area", "cast(c_nationkey as bigint)"),
        ("places", "2 + c_custkey % 9"),
        ("case_no", "concat('01-', cast(2012 + c_custkey % 9 as varchar(20)), '-', cast(c_custkey as varchar(20)))"),
        ("district", "c_mktsegment"),
        ("kept", "c_custkey % 10"),
    ]),
    # registry of hotels, checkable prefixes HB
    "hotel_registry": ("supplier", [
        ("code", "concat('HB-', lpad(cast(s_suppkey as varchar(20)), 6, '0'))"),
        ("name", "s_name"),
    ]),
}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def standin(spark: SparkSession, folder: str, name: str) -> DataFrame:
    source, columns = TABLES[name]
    return read(spark, folder, source).selectExpr(*[f"{e} AS {c}" for c, e in columns])


def table_sql(name: str) -> str:
    source, columns = TABLES[name]
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns)} FROM {source}"


def with_tables(sql: str, uses: tuple[str, ...]) -> str:
    """Puts the stand-ins a query reads in front of its own common tables."""
    if not uses:
        return sql
    heads = ", ".join(f"{name} AS ({table_sql(name)})" for name in uses)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads}, {body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {heads}, {body[4:]}"
    return f"WITH {heads} {body}"
