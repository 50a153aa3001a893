"""Data-quality checks as one job: rows ``check, ok, observed, expected``."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _line(rows: DataFrame, name: str, ok: Column, observed: Column, expected) -> DataFrame:
    return rows.select(
        F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"),
        observed.cast("string").alias("observed"), F.lit(expected).cast("string").alias("expected"))


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def none(name: str, rows: DataFrame) -> DataFrame:
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    return _line(n, name, F.col("n") == 0, F.col("n"), 0)


def same_rows(name: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """Equal as bags of rows: each distinct row (nulls match nulls) as often on one side as on the other."""
    both = a.withColumn("__side", F.lit(1)).unionByName(b.select(*a.columns).withColumn("__side", F.lit(-1)))
    gaps = both.groupBy(*a.columns).agg(F.sum("__side").alias("__gap"))
    return none(name, gaps.filter("__gap <> 0"))


def equal(name: str, a: DataFrame, b: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Two one-value tables agree."""
    left = a.toDF("a").select("a", b.scalar().alias("b"))
    return left.select(
        F.lit(name).alias("check"), F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance, F.lit(False)).alias("ok"),
        F.col("a").cast("string").alias("observed"), F.col("b").cast("string").alias("expected"))


def at_most(name: str, a: DataFrame, b: DataFrame, factor: float = 1.0) -> DataFrame:
    left = a.toDF("a").select("a", b.scalar().alias("b"))
    return left.select(
        F.lit(name).alias("check"), F.coalesce(F.col("a") <= F.col("b") * factor, F.lit(False)).alias("ok"),
        F.col("a").cast("string").alias("observed"), F.col("b").cast("string").alias("expected"))


def only_columns(name: str, rows: DataFrame, allowed: Sequence[str]) -> DataFrame:
    extra = [c for c in rows.columns if c not in allowed]
    one = rows.sparkSession.range(1)
    return _line(one, name, F.lit(not extra), F.lit(",".join(extra)), ",".join(allowed))


def no_text(name: str, rows: DataFrame, pattern: str) -> DataFrame:
    found = reduce(lambda a, b: a | b, [F.col(c).cast("string").rlike(pattern) for c in rows.columns])
    named = any(re.search(pattern, c) for c in rows.columns)
    n = rows.agg(F.count(F.when(found, 1)).alias("n"))
    return _line(n, name, (F.col("n") == 0) & F.lit(not named), F.col("n"), 0)


def single_valued(name: str, rows: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Each key has one value combination and none of it is null."""
    missing = reduce(lambda a, b: a | b, [F.col(v).isNull() for v in values])
    per = rows.groupBy(key, *values).agg(F.max(missing).alias("gap")).groupBy(key).agg(
        F.count(F.lit(1)).alias("k"), F.max("gap").alias("gap"))
    return none(name, per.filter((F.col("k") > 1) | F.col("gap")))


def in_range(name: str, rows: DataFrame, value: str, low: float, high: float) -> DataFrame:
    bad = rows.filter(F.col(value).isNull() | (F.col(value) <= low) | (F.col(value) > high))
    return none(name, bad)


def funnel_closes(name: str, steps: DataFrame, survivors: DataFrame) -> DataFrame:
    start = steps.agg(F.max(F.col("dropped") + F.col("remaining")) - F.sum("dropped"))
    return equal(name, start, survivors.agg(F.count(F.lit(1))))


def finite(name: str, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    broken = reduce(lambda a, b: a | b, [
        F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in columns])
    return none(name, rows.filter(broken))


def unique(name: str, rows: DataFrame, key: str) -> DataFrame:
    return none(name, rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
