"""Sources: delimited text in its many spellings, nested series, features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostelry.functions.numeric import locale_number
from hostelry.sources import records
from hostelry.sources.records import BOM


def without_bom(rows: DataFrame) -> DataFrame:
    """Drops a byte-order mark from the headers and from the first field."""
    clean = rows.toDF(*[c.lstrip(BOM) for c in rows.columns])
    first = clean.columns[0]
    if clean.schema[first].dataType.simpleString() != "string":
        return clean
    return clean.withColumn(first, F.ltrim(F.col(first), F.lit(BOM)))


def read_strings(spark: SparkSession, path: str, **options) -> DataFrame:
    """Every column as text; compressed files are read as they are."""
    return without_bom(spark.read.options(header=True, **options).csv(path))


def typed(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """Casts the named columns; what does not parse is null."""
    return rows.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(header=True, inferSchema=True).csv(path)


def read_locale(spark: SparkSession, path: str, text_columns: Sequence[str]) -> DataFrame:
    """``;`` between fields, decimal comma, ``-`` for no data."""
    rows = without_bom(spark.read.options(header=True, sep=";", nullValue="-").csv(path))
    return rows.withColumns({c: locale_number(F.col(c)) for c in rows.columns if c not in text_columns})


# ---------------------------------------------------------------- drifting headers

def _names(header: Column, width: Column) -> Column:
    """Header names for the real width: a fused last name is split, names missing in the middle are
    filled in before the two trustworthy last ones, repeated names are numbered."""
    last = F.upper(F.element_at(header, -1))
    fused = (F.size(header) < width) & last.contains("LONGITUD") & last.contains("LATITUD")
    split = F.when(
        fused, F.concat(F.slice(header, 1, F.size(header) - 1), F.array(F.lit("LONGITUD_X"), F.lit("LATITUD_Y")))
    ).otherwise(header)
    def fill(names):
        gap = width - F.size(names)
        extra = F.transform(F.sequence(F.lit(1), F.greatest(gap, F.lit(1))), lambda i: F.concat(F.lit("UNNAMED_"), i.cast("string")))
        return F.when(gap > 0, F.concat(F.slice(names, 1, F.size(names) - 2), extra, F.slice(names, -2, 2))).otherwise(names)
    def number(names):
        return F.transform(names, lambda n, i: F.concat(n, F.when(
            F.size(F.filter(F.slice(names, 1, i), lambda m: m == n)) > 0,
            F.concat(F.lit("_"), F.size(F.filter(F.slice(names, 1, i), lambda m: m == n)).cast("string"))).otherwise(F.lit(""))))
    bound = F.element_at(F.transform(F.array(split), fill), 1)
    return F.element_at(F.transform(F.array(bound), number), 1)


def _period_records(spark: SparkSession, path: str, period: str) -> DataFrame:
    return records.read_records(spark, path).select(F.regexp_extract("file_", period, 1).alias("period"), records.fields(F.col("value")).alias("f"))


def _aligned(spark: SparkSession, path: str, period: str, first_column: str) -> DataFrame:
    lines = _period_records(spark, path, period)
    is_header = F.element_at("f", 1) == first_column
    widths = lines.filter(~is_header).groupBy("period", F.size("f").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    real = widths.groupBy("period").agg(F.max(F.struct("n", "w")).alias("m")).select("period", F.col("m.w").alias("w"))
    headers = lines.filter(is_header).groupBy("period").agg(F.min("f").alias("h")).join(real, "period").select(
        "period", "w", _names(F.col("h"), F.col("w")).alias("names"))
    return lines.filter(~is_header).join(headers, "period")


def read_drifting(spark: SparkSession, path: str, period: str, first_column: str, wanted: Sequence[str]) -> DataFrame:
    """Rows of period files whose headers drift, as ``period`` and the wanted columns in text.

    ``period`` is a pattern whose first group names the period in the file path. The real width of a
    period is its commonest row width; wider rows are dropped, narrower ones end in nulls. A name the
    header lacks is null. Quoted fields may hold separators, line breaks and doubled quotes.
    """
    rows = _aligned(spark, path, period, first_column).filter(F.size("f") <= F.size("names"))
    def at(name):
        place = F.array_position("names", name).cast("int")
        return F.nullif(F.when(place > 0, F.try_element_at("f", F.when(place > 0, place).otherwise(1))), F.lit(""))
    return rows.select("period", *[at(n).alias(n) for n in wanted])


def lost_rows(spark: SparkSession, path: str, period: str, first_column: str, limit: float = 0.01) -> DataFrame:
    """Rows in the file, rows dropped, and whether more than the limit were lost, per period."""
    rows = _aligned(spark, path, period, first_column)
    lost = (F.size("f") > F.size("names")).cast("long")
    return rows.groupBy("period").agg(F.count(F.lit(1)).alias("rows"), F.sum(lost).alias("lost")).withColumn(
        "warn", F.col("lost") > F.col("rows") * limit)


# ---------------------------------------------------------------- nested documents

SERIES = ("COD string, Nombre string, T3_Unidad string, Data array<struct<Fecha:string, Anyo:int, "
          "T3_Periodo:string, T3_TipoDato:string, Valor:double>>")


def read_series(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Official series with their list of data."""
    return spark.read.schema(SERIES).json(path, multiLine=multi_line)


def named_like(series: DataFrame, text: str, name: str = "Nombre") -> DataFrame:
    return series.filter(F.col(name).contains(text))


def series_rows(series: DataFrame, label: str) -> DataFrame:
    """One row per datum with the UTC month of its date."""
    flat = series.select(F.col("COD").alias("code"), F.trim("Nombre").alias("series"), F.col("T3_Unidad").alias("unit"), F.explode("Data").alias("d"))
    when = F.try_to_timestamp(F.col("d.Fecha"))
    return flat.select(
        F.lit(label).alias("source"), "code", "series", "unit", F.col("d.Anyo").alias("year"), F.col("d.T3_Periodo").alias("period"),
        (F.col("d.T3_TipoDato") == "Provisional").alias("provisional"), when.alias("at"),
        F.date_format(when, "yyyy-MM").alias("month"), F.col("d.Valor").alias("value"))


def add_series(rows: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Sum by month of the series with these codes; a month missing in one is null."""
    chosen = rows.filter(F.col("code").isin(*codes)).groupBy("month").agg(
        F.count_distinct("code").alias("__k"), F.sum("value").alias("__v"))
    return chosen.select("month", F.when(F.col("__k") == len(set(codes)), F.col("__v")).alias("value"))


def read_features(spark: SparkSession, path: str, properties: str, *, lines: bool = True, depth: int = 3) -> DataFrame:
    """Features as rows: properties beside ``coordinates`` (arrays nested ``depth`` deep over points).

    ``lines`` reads one feature per line, which splits; otherwise each file is one collection.
    ``properties`` is a DDL list of the properties to keep, so the rest is never parsed.
    """
    nested = "array<" * depth + "array<double>" + ">" * depth
    feature = f"struct<properties:struct<{properties}>, geometry:struct<type:string, coordinates:{nested}>>"
    if lines:
        body = feature[len("struct<"):-1].replace("properties:", "properties ", 1).replace(", geometry:", ", geometry ", 1)
        rows = spark.read.schema(body).json(path)
    else:
        rows = spark.read.schema(f"features array<{feature}>").json(path, multiLine=True).select(
            F.explode("features").alias("f")).select("f.*")
    return rows.select("properties.*", F.col("geometry.coordinates").alias("coordinates"))


def split_extract(rows: DataFrame, region: Column, kind: str, path: str) -> None:
    """Rows of a region, written in one folder per kind."""
    rows.filter(region).write.partitionBy(kind).parquet(path)


def clip(features: DataFrame, region: Column) -> DataFrame:
    return features.filter(region)
