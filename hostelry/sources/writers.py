"""Sinks: CSV, compact JSON without NaN, features one per line, table catalogue."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(rows: DataFrame, path: str, **options) -> None:
    rows.write.options(header=True, **options).csv(path)


def finite_or_null(value: Column) -> Column:
    """JSON has no NaN or infinity; Spark would write them as text."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def _clean(rows: DataFrame) -> DataFrame:
    return rows.select(*[
        finite_or_null(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in rows.schema.fields
    ])


def json_document(rows: DataFrame, out: str = "value") -> DataFrame:
    """Each row as compact JSON text, nulls written."""
    clean = _clean(rows)
    return clean.select(F.to_json(F.struct(*clean.columns), {"ignoreNullFields": "false"}).alias(out))


def write_json(rows: DataFrame, path: str) -> None:
    json_document(rows).write.text(path)


def point_tuples(rows: DataFrame, lat: str, lon: str, allowed: Sequence[str], out: str = "value") -> DataFrame:
    """Positional JSON array of rounded coordinates and allowed columns only, nothing that names a
    person."""
    parts = [F.round(lat, 5), F.round(lon, 5), *[F.col(c) for c in allowed]]
    texts = [F.coalesce(F.to_json(F.array(p)), F.lit("[null]")) for p in parts]
    inner = F.concat_ws(",", *[F.substring(t, F.lit(2), F.length(t) - 2) for t in texts])
    return rows.select(F.concat(F.lit("["), inner, F.lit("]")).alias(out))


def features(rows: DataFrame, properties: Sequence[str], coordinates: str, kind: str = "MultiPolygon") -> DataFrame:
    """One GeoJSON feature per line, which splits and streams where one big document would not."""
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"),
        F.struct(F.lit(kind).alias("type"), F.col(coordinates).alias("coordinates")).alias("geometry"))
    return rows.select(F.to_json(feature).alias("value"))


def write_features(rows: DataFrame, path: str, properties: Sequence[str], coordinates: str) -> None:
    features(rows, properties, coordinates).write.text(path)


def catalogue(spark: SparkSession, tables: dict[str, tuple[str, str]]) -> DataFrame:
    """Per table: rows, columns and producer, for ``{name: (path, producer)}`` of parquet tables."""
    lines = []
    for name, (path, producer) in tables.items():
        rows = spark.read.parquet(path)
        lines.append(rows.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(len(rows.columns)).alias("columns"),
            F.lit(", ".join(rows.columns)).alias("column_names"), F.lit(producer).alias("producer")))
    return reduce(DataFrame.unionByName, lines)
