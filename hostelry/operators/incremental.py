"""Work that resumes: pending rows, stable surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostelry.operators.distribution import attach, dense_index


def pending(rows: DataFrame, done: DataFrame, key: str, priority: Column) -> DataFrame:
    """Rows whose key is not done yet, priority rows first."""
    known = done.select(F.col(key).alias("__done")).filter(F.col("__done").isNotNull()).distinct()
    left = rows.join(known, rows[key] == known["__done"], "left_anti")
    return left.orderBy(priority.desc(), key)


def surrogate_keys(known: DataFrame, rows: DataFrame, key: str, number: str) -> DataFrame:
    """Key map where known keys keep their number and new ones follow the largest in key order."""
    fresh = (
        rows.select(key).filter(F.col(key).isNotNull()).distinct()
        .join(known.select(F.col(key).alias("__known")), F.col(key) == F.col("__known"), "left_anti")
    )
    start = known.select(F.coalesce(F.max(number), F.lit(0))).scalar()
    numbered = dense_index(fresh, [F.col(key)], "__i")
    return known.select(key, F.col(number).cast("long").alias(number)).unionByName(
        numbered.select(key, (F.col("__i") + 1 + start).cast("long").alias(number)))


def with_surrogate(rows: DataFrame, mapping: DataFrame, key: str, number: str) -> DataFrame:
    return attach(rows, mapping.select(key, number), [key])
