"""Sources and sinks over files that Spark derives from the given tables."""

from pyspark.sql import functions as F

from hostelry.functions import numeric
from hostelry.operators.polygons import rings
from hostelry.registry.core import query
from hostelry.registry.fixtures import read, standin
from hostelry.registry.spatial_queries import features
from hostelry.session import scratch_path
from hostelry.sources import readers, records, writers

c = F.col


def customer_csv(spark, folder, **options):
    path = scratch_path(spark, "csv")
    rows = read(spark, folder, "customer").select(
        "c_custkey", "c_name", F.when(c("c_custkey") % 9 == 0, "none").otherwise(c("c_acctbal").cast("string")).alias("c_acctbal"))
    writers.write_csv(rows, path, **options)
    return path


@query("src01_csv_as_text", "SRC-01 SNK-01 PRJ-06", "SELECT c_custkey, c_name, case when c_custkey % 9 <> 0 then c_acctbal end AS c_acctbal FROM customer")
def csv_as_text(spark, folder):
    rows = readers.read_strings(spark, customer_csv(spark, folder))
    return readers.typed(rows, {"c_custkey": "bigint", "c_acctbal": "double"})


@query("src02_csv_inferred", "SRC-02", "SELECT s_nationkey, count(*) AS sites, round(sum(s_acctbal), 2) AS balance FROM supplier GROUP BY 1")
def csv_inferred(spark, folder):
    path = scratch_path(spark, "csv")
    writers.write_csv(read(spark, folder, "supplier"), path)
    return readers.read_inferred(spark, path).groupBy("s_nationkey").agg(
        F.count("*").alias("sites"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("src03_locale_csv", "SRC-03 SRC-04", "SELECT s_name AS category, case when s_suppkey % 4 <> 0 then s_acctbal end AS adr FROM supplier")
def locale_csv(spark, folder):
    path = scratch_path(spark, "locale")
    rows = read(spark, folder, "supplier").select(
        F.concat(F.lit(readers.BOM), c("s_name")).alias(readers.BOM + "category"),
        F.when(c("s_suppkey") % 4 == 0, "-").otherwise(F.replace(c("s_acctbal").cast("string"), F.lit("."), F.lit(","))).alias("adr"))
    writers.write_csv(rows, path, sep=";")
    return readers.read_locale(spark, path, ["category"])


def drifting_files(spark, folder):
    """Three periods: complete header, fused last name, names missing in the middle; some rows have
    one field too many."""
    path = scratch_path(spark, "periods")
    rows = read(spark, folder, "customer")
    cells = [c("c_custkey").cast("string"), F.concat(F.lit('"Carrer, '), (c("c_custkey") % 50).cast("string"), F.lit('"')), (c("c_custkey") % 7).cast("string"),
             c("c_nationkey").cast("string"), c("c_acctbal").cast("string")]
    line = F.concat_ws(",", *cells)
    line = F.when(c("c_custkey") % 37 == 0, F.concat(line, F.lit(",loose"))).otherwise(line)
    period = F.element_at(F.array(F.lit("2018_1T"), F.lit("2019_1T"), F.lit("2020_3T")), (c("c_custkey") % 3 + 1).cast("int"))
    body = rows.select(period.alias("period"), line.alias("value"))
    heads = {"2018_1T": "N_EXPEDIENT,CARRER,PLACES,LONGITUD_X -LATITUD_Y", "2019_1T": readers.BOM + "N_EXPEDIENT,CARRER,PLACES,LONGITUD_X,LATITUD_Y",
             "2020_3T": "N_EXPEDIENT,CARRER,LONGITUD_X,LATITUD_Y"}
    head = spark.range(1).select(F.explode(F.create_map(*[F.lit(x) for kv in heads.items() for x in kv])).alias("period", "value"))
    head.unionByName(body).write.partitionBy("period").text(path)
    return path


@query("src05_drifting_headers", "SRC-05", """
SELECT case c_custkey % 3 when 0 then '2018_1T' when 1 then '2019_1T' else '2020_3T' end AS period, cast(c_custkey as varchar) AS "N_EXPEDIENT", concat('Carrer, ', cast(c_custkey % 50 as varchar)) AS "CARRER",
 case when c_custkey % 3 < 2 then cast(c_custkey % 7 as varchar) end AS "PLACES", cast(c_nationkey as varchar) AS "LONGITUD_X" FROM customer WHERE c_custkey % 37 <> 0""")
def drifting_headers(spark, folder):
    return readers.read_drifting(spark, drifting_files(spark, folder), r"period=([^/]+)", "N_EXPEDIENT", ["N_EXPEDIENT", "CARRER", "PLACES", "LONGITUD_X"])


@query("src06_lost_rows", "SRC-06", """
SELECT case c_custkey % 3 when 0 then '2018_1T' when 1 then '2019_1T' else '2020_3T' end AS period, count(*) AS rows, sum((c_custkey % 37 = 0)::INT)::BIGINT AS lost, sum((c_custkey % 37 = 0)::INT) > count(*) * 0.01 AS warn FROM customer GROUP BY 1""")
def lost_rows(spark, folder):
    return readers.lost_rows(spark, drifting_files(spark, folder), r"period=([^/]+)", "N_EXPEDIENT")


@query("src05_quoted_records", "SRC-05 SRC-06", """
SELECT cast(doc_id as varchar) AS doc_id, md5(coalesce(text, '') || chr(10) || '"' || coalesce(source, '') || '"') AS digest, length(coalesce(text, '')) AS size FROM documents""")
def quoted_records(spark, folder):
    """Every document as one quoted field over as many lines as it has, with a break and quotes put in."""
    path = scratch_path(spark, "quoted")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit('\n"'), F.coalesce("source", F.lit("")), F.lit('"'))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    rows = read(spark, folder, "documents").withColumn("text", F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))
    rows.select(F.concat_ws(",", c("doc_id").cast("string"), quoted, F.length(F.coalesce("text", F.lit(""))).cast("string")).alias("value")).write.text(path)
    f = records.fields(c("value"))
    return records.read_records(spark, path).select(f.alias("f")).select(
        c("f")[0].alias("doc_id"), F.md5(c("f")[1]).alias("digest"), c("f")[2].cast("bigint").alias("size"))


@query("src07_gzip_csv", "SRC-07", "SELECT count(*) AS rows, sum(c_custkey)::BIGINT AS keys FROM customer")
def gzip_csv(spark, folder):
    rows = readers.read_strings(spark, customer_csv(spark, folder, compression="gzip"))
    return rows.agg(F.count("*").alias("rows"), F.sum(c("c_custkey").cast("bigint")).alias("keys"))


def series_files(spark, folder):
    """One official-looking series per event type and result, a datum per day."""
    path = scratch_path(spark, "series")
    days = read(spark, folder, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count("*").cast("double").alias("v"))
    datum = F.struct(
        F.concat(F.date_format("d", "yyyy-MM-dd"), F.lit("T00:30:00.000+02:00")).alias("Fecha"), F.year("d").alias("Anyo"),
        F.date_format("d", "'M'MM").alias("T3_Periodo"), F.when(F.dayofmonth("d") > 25, "Provisional").otherwise("Definitivo").alias("T3_TipoDato"), c("v").alias("Valor"))
    series = days.groupBy("event_type").agg(F.collect_list(datum).alias("Data")).select(
        F.concat(F.lit("EOT_"), c("event_type")).alias("COD"), F.concat(F.when(c("event_type") == "view", "Girona").otherwise("Barcelona"), F.lit(". "), c("event_type"), F.lit(". ")).alias("Nombre"),
        F.lit("Persons").alias("T3_Unidad"), "Data")
    writers.write_json(series, path)
    return path


@query("src08_nested_series", "SRC-08 SRC-10 DT-03", """
SELECT concat('Barcelona. ', event_type, '.') AS series, strftime(date_trunc('day', ts) - INTERVAL 90 MINUTE, '%Y-%m') AS month, day(ts) > 25 AS provisional, count(*)::DOUBLE AS value
FROM events WHERE event_type <> 'view' GROUP BY 1, 2, 3""")
def nested_series(spark, folder):
    rows = readers.series_rows(readers.named_like(readers.read_series(spark, series_files(spark, folder)), "Barcelona"), "events")
    return rows.groupBy("series", "month", "provisional").agg(F.sum("value").alias("value"))


@query("src09_added_series", "SRC-09", """
SELECT strftime(date_trunc('day', ts) - INTERVAL 90 MINUTE, '%Y-%m') AS month, count(*)::DOUBLE AS value FROM events WHERE event_type IN ('click', 'error') GROUP BY 1""")
def added_series(spark, folder):
    return readers.add_series(readers.series_rows(readers.read_series(spark, series_files(spark, folder)), "events"), ["EOT_click", "EOT_error"])


@query("src11_features", "SRC-11 SNK-04 SRC-14 GEO-03", """
SELECT id, name, case when id % 6 = 0 then 2 else 1 end::BIGINT AS rings, round(lon0, 9) AS first_x FROM polys WHERE region = 1""", ("polys",))
def feature_files(spark, folder):
    path = scratch_path(spark, "features")
    writers.write_features(features(spark, folder), path, ["id", "name", "region"], "coordinates")
    rows = readers.clip(readers.read_features(spark, path, "id:bigint,name:string,region:bigint"), c("region") == 1)
    count = rings(rows, "id", "coordinates").groupBy("id").agg(F.count("*").alias("rings"))
    return rows.join(count, "id").select("id", "name", "rings", F.round(F.col("coordinates")[0][0][0][0], 9).alias("first_x"))


@query("src12_pruned_columns", "SRC-12", "SELECT l_returnflag, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def pruned_columns(spark, folder):
    return read(spark, folder, "lineitem").select("l_returnflag", "l_quantity").groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("src13_split_extract", "SRC-13", "SELECT o_orderstatus, count(*) AS rows FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def split_extract(spark, folder):
    path = scratch_path(spark, "extract")
    readers.split_extract(read(spark, folder, "orders"), c("o_orderpriority") == "1-URGENT", "o_orderstatus", path)
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("rows"))


@query("snk02_json_without_nan", "SNK-02", """
SELECT concat('{"id":', cast(c_custkey as varchar), ',"ratio":', case when c_nationkey = 0 then 'null' else '1.5' end, '}') AS value FROM customer""")
def json_without_nan(spark, folder):
    rows = read(spark, folder, "customer").select(c("c_custkey").alias("id"), F.when(c("c_nationkey") == 0, F.lit(float("nan"))).otherwise(1.5).alias("ratio"))
    path = scratch_path(spark, "json")
    writers.write_json(rows, path)
    return spark.read.text(path)


@query("snk03_point_tuples", "SNK-03", """
SELECT area, round(lat, 5) AS lat, round(lon, 5) AS lon, places, price_known FROM (SELECT area, lat + 1e-7 AS lat, lon + 1e-7 AS lon, places, price IS NOT NULL AS price_known FROM agents)""", ("agents",))
def point_tuples(spark, folder):
    rows = standin(spark, folder, "agents").withColumns({
        "price_known": c("price").isNotNull(), "lat": c("lat") + 1e-7, "lon": c("lon") + 1e-7})
    path = scratch_path(spark, "points")
    writers.point_tuples(rows, "lat", "lon", ["places", "area", "price_known"]).write.text(path)
    parts = F.from_json("value", "array<string>")
    return spark.read.text(path).select(parts.alias("p")).select(
        c("p")[3].cast("bigint").alias("area"), c("p")[0].cast("double").alias("lat"), c("p")[1].cast("double").alias("lon"),
        c("p")[2].cast("bigint").alias("places"), c("p")[4].cast("boolean").alias("price_known"))


GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark",
         "labels", "conversations")


@query("snk05_table_catalogue", "SNK-05", " UNION ALL ".join(
    f"""SELECT '{n}' AS "table", (SELECT count(*) FROM {n}) AS rows, count(*)::INT AS columns, string_agg(column_name, ', ') AS column_names, 'generator' AS producer
 FROM (DESCRIBE SELECT * FROM {n})""" for n in GIVEN))
def table_catalogue(spark, folder):
    return writers.catalogue(spark, {n: (f"{folder}/{n}.parquet", "generator") for n in GIVEN})


@query("js02_json_properties", "JS-01 SRC-08", "SELECT event_type, sum(cast(json_extract(props, '$.k') as bigint))::BIGINT AS k FROM events GROUP BY 1")
def json_properties(spark, folder):
    return read(spark, folder, "events").select("event_type", F.from_json("props", "k bigint").alias("p")).groupBy("event_type").agg(F.sum("p.k").alias("k"))


@query("inc01_resumed_batches", "INC-01", "SELECT c_custkey AS id, concat('place ', cast(c_nationkey as varchar)) AS found FROM customer")
def resumed_batches(spark, folder):
    from hostelry.streaming.resume import run_pending

    inbox, done = scratch_path(spark, "inbox"), scratch_path(spark, "done")
    rows = read(spark, folder, "customer").select(c("c_custkey").alias("id"), "c_nationkey")
    rows.filter("c_nationkey < 15").write.parquet(inbox)
    work = lambda batch: batch.select("id", F.concat(F.lit("place "), c("c_nationkey").cast("string")).alias("found"))
    run_pending(spark, inbox, done, "id", work)
    rows.write.mode("append").parquet(inbox)
    run_pending(spark, inbox, done, "id", work)
    return spark.read.parquet(f"{done}/rows").drop("batch")
