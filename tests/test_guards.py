"""What must fail fails, what must survive survives."""

import json

import pytest
from pyspark.sql import functions as F

from hostelry.operators import funnel, incremental, linkage, projection, quality, series
from hostelry.sources import readers, writers
from hostelry.streaming.resume import run_pending


def test_published_funnel_closes(spark):
    drops = [("a", 915), ("b", 3083), ("c", 1848), ("d", 876), ("e", 1850), ("f", 1849)]
    rows = spark.createDataFrame([(s, n) for s, n in drops] + [(None, 4985)], "reason string, n int").select(
        "reason", F.explode(F.sequence(F.lit(1), "n")).alias("i"), F.lit(2.0).alias("places"))
    out = funnel.funnel(rows, [s for s, _ in drops], "reason", "places").collect()
    assert out[-1]["remaining"] == 4985 and out[0]["remaining"] == 15406 - 915
    with pytest.raises(Exception, match="no declared step"):
        funnel.funnel(rows, ["a", "b"], "reason", "places").collect()


def test_duplicate_keys_raise(spark):
    rows = spark.createDataFrame([("x",), ("x",), (None,), (None,)], "code string")
    with pytest.raises(ValueError, match="repeated code"):
        linkage.require_unique(rows, "code", "registry")


def test_linkage_never_multiplies_rows(spark):
    address = {"town": "T", "road_type": "C", "road_name": "Major", "floor": "1", "door": "A"}
    def row(code, number, **more):
        return {"code": code, "number": number, **address, **more}
    registry = spark.createDataFrame([row("A-1", "1"), row("A-2", "2"), row("A-3", "3"), row("A-4", "3")])
    source = spark.createDataFrame(
        [row("A-1", "9", id=1, lat=1.0), row(None, "2-4", id=2, lat=2.0), row(None, "3", id=3, lat=3.0), row("B-9", "7", id=4, lat=4.0), row(None, "8", id=5, lat=5.0)],
        "code string, number string, town string, road_type string, road_name string, floor string, door string, id long, lat double")
    out = {r["code"]: (r["match_method"], r["lat"]) for r in linkage.link(registry, source, linkage.Profile(["lat"], with_units=True)).collect()}
    assert out == {"A-1": ("registry_code", 1.0), "A-2": ("address", 2.0), "A-3": ("registry_only", None), "A-4": ("registry_only", None),
                   "OPENDATA-3": ("open_only", 3.0), "B-9": ("open_only", 4.0), "OPENDATA-5": ("open_only", 5.0)}


def test_category_key_must_name_one(spark):
    rows = spark.createDataFrame([("Bars   / CIBERCAFÉ",), ("Restaurants",), ("restaurants nous",)], "a string")
    assert projection.select_by_category(rows, "a", {"cibercafe": "bar"}, "t").count() == 1
    with pytest.raises(ValueError):
        projection.select_by_category(rows, "a", {"restaurants": "r"}, "t")


def test_stock_and_flow_case(spark):
    rows = spark.createDataFrame([("2020", "a"), ("2020", "b"), ("2021", "b"), ("2021", "c"), ("2021", "d"), ("2021", "d")], "p string, i string")
    out = [tuple(r) for r in series.stock_and_flow(rows, "p", "i").orderBy("p").collect()]
    assert out == [("2020", 2, None, None, None), ("2021", 3, 2, 1, 1)]


def test_surrogate_keys_are_stable(spark):
    known = spark.createDataFrame([("m", 7)], "k string, n long")
    rows = spark.createDataFrame([("b",), ("a",), ("m",), (None,), ("a",)], "k string")
    first = incremental.surrogate_keys(known, rows, "k", "n")
    assert {r["k"]: r["n"] for r in first.collect()} == {"m": 7, "a": 8, "b": 9}
    again = incremental.surrogate_keys(first, rows.unionByName(spark.createDataFrame([("aa",)], "k string")), "k", "n")
    assert {r["k"]: r["n"] for r in again.collect()} == {"m": 7, "a": 8, "b": 9, "aa": 10}
    held = incremental.with_surrogate(rows, again, "k", "n")
    assert held.count() == 5 and held.filter("k is null and n is null").count() == 1


def test_failing_checks_say_so(spark):
    rows = spark.createDataFrame([(1, "HUTB-1", float("nan")), (1, "b", 2.0)], "id int, t string, lat double")
    out = quality.report(
        quality.unique("unique", rows, "id"), quality.no_text("text", rows, "HUTB"), quality.finite("finite", rows, ["lat"]),
        quality.only_columns("columns", rows, ["id"]), quality.single_valued("single", rows, "id", ["t"]),
        quality.same_rows("same", rows, rows.limit(1)), quality.in_range("range", rows, "id", 1, 100)).collect()
    assert [r["ok"] for r in out] == [False] * 7


def test_one_document_of_features(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "a", "other": 1}, "geometry": {
        "type": "MultiPolygon", "coordinates": [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]]}}]}
    path = tmp_path / "f.geojson"
    path.write_text(json.dumps(doc))
    row = readers.read_features(spark, str(path), "name:string", lines=False).first()
    assert row["name"] == "a" and row["coordinates"][0][0][1] == [1.0, 0.0]


def test_header_repeats_and_gaps(spark, tmp_path):
    folder = tmp_path / "period=2020_3T"
    folder.mkdir()
    (folder / "a.csv").write_text("ID,NAME,NAME,LON,LAT\r\n1,\"a, b\",c,9,2.0,41.0\r\n2,x,y,8,2.1,41.1\r\n3,x,y,7,2.1,41.1,extra\r\n4,z\r\n")
    got = readers.read_drifting(spark, str(tmp_path), r"period=([^/]+)", "ID", ["ID", "NAME", "NAME_1", "UNNAMED_1", "LON", "ABSENT"])
    assert [tuple(r) for r in got.orderBy("ID").collect()] == [
        ("2020_3T", "1", "a, b", "c", "9", "2.0", None), ("2020_3T", "2", "x", "y", "8", "2.1", None), ("2020_3T", "4", "z", None, None, None, None)]
    lost = readers.lost_rows(spark, str(tmp_path), r"period=([^/]+)", "ID").first()
    assert (lost["rows"], lost["lost"], lost["warn"]) == (4, 1, True)


def test_json_has_no_nan(spark):
    rows = spark.createDataFrame([(float("nan"), float("inf"), 1.5)], "a double, b double, c double")
    assert writers.json_document(rows).first()[0] == '{"a":null,"b":null,"c":1.5}'


def test_resumed_stream_does_each_key_once(spark, tmp_path):
    inbox, done = str(tmp_path / "in"), str(tmp_path / "done")
    spark.range(10).write.parquet(inbox)
    calls = lambda b: b.select("id", F.lit("done").alias("r"))
    run_pending(spark, inbox, done, "id", calls)
    spark.range(5, 15).write.mode("append").parquet(inbox)
    run_pending(spark, inbox, done, "id", calls)
    run_pending(spark, inbox, done, "id", calls)
    rows = spark.read.parquet(f"{done}/rows")
    assert rows.count() == 15 and rows.filter("batch = 0").count() == 10


def test_a_resumed_batch_reads_only_the_buckets_of_its_keys(spark, tmp_path):
    inbox, done = str(tmp_path / "in"), str(tmp_path / "done")
    work = lambda b: b.select("id", F.lit("done").alias("r"))
    spark.range(40).write.parquet(inbox)
    run_pending(spark, inbox, done, "id", work, buckets=8)
    bucket = F.pmod(F.xxhash64("id"), F.lit(8))
    mine = spark.range(200).filter(bucket == 3)
    for file in [*tmp_path.glob("done/rows/batch=0/*.parquet"), *(f for f in tmp_path.glob("done/keys/batch=0/bucket=*/*.parquet") if "bucket=3" not in str(f))]:
        file.write_bytes(b"unreadable")
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    mine.coalesce(1).write.mode("append").parquet(inbox)
    run_pending(spark, inbox, done, "id", work, buckets=8)
    got = {r.id for r in spark.read.parquet(f"{done}/rows/batch=1").collect()}
    assert got == {r.id for r in mine.collect() if r.id >= 40}
