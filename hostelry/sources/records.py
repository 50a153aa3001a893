"""Records of delimited text whose quoted fields hold line breaks, from files that are read in splits.

A line maps the state it starts in (outside or inside a quoted field) to the state it ends in. Such maps compose, so
every split is summed up by one map, the maps of a file's splits give the state each split starts in, and only files
in which a line ends inside a quoted field take this way at all. Lines of all other files are records as they are.

Quotes count at the start of a field only, as in the usual readers of such files; a doubled quote stands for one. Line
ends of any kind become ``\\n`` inside a record. A quote that its file never closes opens nothing: the lines from there
on are records of their own. Blank lines are records inside quotes only. A record is one row, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostelry.operators.distribution import attach

BOM = "﻿"
_INNER = '(?:[^"]++|"")*+'
_QUOTED = f'"{_INNER}"'
_FIELD = f', *+({_QUOTED}[^,]*+|[^,]*+)'
#: Whole fields, then a quote that no other closes.
_OPEN = f'^(?:, *+(?:{_QUOTED}[^,]*+|(?!")[^,]*+))*+, *+"'


def fields(record: Column) -> Column:
    """Fields of a record: quoted ones as they are between their quotes, the others without outer blanks."""
    def plain(field):
        inner = F.replace(F.regexp_replace(field, f'^"({_INNER})"', "$1"), F.lit('""'), F.lit('"'))
        return F.when(field.rlike(f"^{_QUOTED}"), inner).otherwise(F.trim(field))

    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_FIELD), F.lit(1)), plain)


def _opens(line: Column) -> Column:
    return F.when(line.contains('"'), F.concat(F.lit(","), line).rlike(_OPEN)).otherwise(F.lit(False)).cast("int")


def _before(rows: DataFrame, part: list[str], order: str) -> DataFrame:
    """Adds ``b0, b1``: the state before each row if its part starts outside or inside a quoted field."""
    until = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    turns = rows.withColumn("turn", F.sum(((F.col("o0") == 1) & (F.col("o1") == 0)).cast("long")).over(until))
    fixed = F.last(F.when(F.col("o0") == F.col("o1"), F.struct(F.col("o0").alias("v"), F.col("turn").alias("t"))), ignorenulls=True)
    seen = turns.withColumns({"fixed": fixed.over(earlier), "turned": F.coalesce(F.last("turn").over(earlier), F.lit(0))})

    def state(start):
        return F.when(F.col("fixed").isNull(), F.pmod(F.col("turned") + start, F.lit(2))).otherwise(
            F.pmod(F.col("fixed.v") + F.col("turned") - F.col("fixed.t"), F.lit(2)))

    return seen.withColumns({"b0": state(0), "b1": state(1)}).drop("turn", "fixed", "turned")


def _after(start: str) -> Column:
    return F.when(F.col(start) == 0, F.col("o0")).otherwise(F.col("o1"))


def _assembled(lines: DataFrame) -> DataFrame:
    """``file_, value`` of files in which records may go over line ends."""
    split = ["file_", "block_"]
    mapped = _before(lines.withColumn("o1", _opens(F.concat(F.lit('"'), F.col("value")))), split, "line_")
    ends = mapped.groupBy(*split).agg(
        F.max_by(_after("b0"), "line_").alias("o0"), F.max_by(_after("b1"), "line_").alias("o1"),
        F.max(F.when(F.col("b0") == 0, F.col("line_"))).alias("s0"), F.max(F.when(F.col("b1") == 0, F.col("line_"))).alias("s1"))
    ordered = Window.partitionBy("file_").orderBy("block_")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    start = F.when(F.col("b0") == 0, F.col("s0")).otherwise(F.col("s1"))
    begun = F.last(F.when(start.isNotNull(), F.struct(F.col("block_").alias("block_"), start.alias("line_"))), ignorenulls=True)
    splits = _before(ends, ["file_"], "block_").select(
        *split, F.col("b0").alias("carried"), begun.over(ordered.rowsBetween(Window.unboundedPreceding, -1)).alias("begun"),
        F.when(F.last(_after("b0")).over(whole) == 1, begun.over(whole)).alias("never_closed"))

    state = F.when(F.col("carried") == 0, F.col("b0")).otherwise(F.col("b1"))
    here = Window.partitionBy(*split).orderBy("line_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = attach(mapped, splits, split).withColumn("state", state)
    own = F.last(F.when(F.col("state") == 0, F.col("line_")), ignorenulls=True).over(here)
    owned = placed.withColumn("record", F.when(own.isNotNull(), F.struct("block_", own.alias("line_"))).otherwise(F.col("begun")))
    alone = ((F.col("state") == 0) & (_after("state") == 0)) | F.coalesce(F.col("record") == F.col("never_closed"), F.lit(False))
    parts = F.array_sort(F.collect_list(F.struct("block_", "line_", "value")))
    joined = owned.filter(~alone).groupBy("file_", "record").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"))
    return owned.filter(alone).select("file_", "value").unionByName(joined.select("file_", "value"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``file_, value``: the records of all files under ``path``, without byte-order marks and blank lines."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_"), F.col("_metadata.file_block_start").alias("block_"),
        F.monotonically_increasing_id().alias("line_"), F.ltrim("value", F.lit(BOM)).alias("value")).withColumn("o0", _opens(F.col("value")))
    broken = lines.groupBy("file_").agg(F.max("o0").alias("m")).filter("m = 1").select("file_")
    whole = lines.join(broken, "file_", "left_anti").select("file_", "value")
    return whole.unionByName(_assembled(lines.join(broken, "file_", "left_semi"))).filter(F.col("value") != "")
