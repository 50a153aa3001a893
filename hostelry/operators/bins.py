"""Classes that depend on the whole table: shares per bucket, root breaks, top quintile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostelry.operators.quantiles import exact_quantiles


def bucket_shares(rows: DataFrame, value: Column, weight: Column, edges: Sequence[float]) -> DataFrame:
    """Weighted percentage per half-open bucket; the last one has no end. Empty buckets show 0."""
    bounds = list(zip(edges, [*edges[1:], None]))
    sums = [F.sum(weight).alias("__all")]
    for i, (low, high) in enumerate(bounds):
        inside = value >= low if high is None else (value >= low) & (value < high)
        sums.append(F.coalesce(F.sum(F.when(inside, weight)), F.lit(0.0)).alias(f"__b{i}"))
    lines = [
        F.struct(F.lit(float(low)).alias("since"), F.lit(high).cast("double").alias("until"),
                 (F.col(f"__b{i}") * 100.0 / F.col("__all")).alias("pct"))
        for i, (low, high) in enumerate(bounds)
    ]
    return rows.agg(*sums).select(F.inline(F.array(*lines)))


def root_class(rows: DataFrame, value: str, classes: int, out: str) -> DataFrame:
    """``floor(sqrt(v / max) * k)`` capped at k-1; zero and null are class -1."""
    top = rows.select(F.max(value)).scalar()
    level = F.floor(F.sqrt(F.col(value) / top) * classes)
    return rows.withColumn(
        out, F.when(F.coalesce(F.col(value), F.lit(0)) == 0, F.lit(-1)).otherwise(
            F.least(level, F.lit(classes - 1))).cast("int"))


def root_breaks(rows: DataFrame, value: str, classes: int) -> DataFrame:
    """Lowest value of each root class, as a legend shows it."""
    lines = [
        F.struct(F.lit(i).alias("class"),
                 F.when(F.lit(i) == 0, F.lit(1)).otherwise(
                     F.ceil(F.col("top") * F.pow(F.lit(i / classes), F.lit(2.0)))).cast("long").alias("since"))
        for i in range(classes)
    ]
    return rows.agg(F.max(value).alias("top")).select(F.inline(F.array(*lines)))


# Change classes from the largest gain down.
CHANGE_CLASSES = [(50, "gains"), (10, "gains a little"), (-10, "same"), (-50, "loses a little")]


def change_class(now: Column, change: Column) -> Column:
    """Class of a percentage change. ``>= 50``, ``>= 10``, ``> -10``, ``> -50``, else loses."""
    c = F.coalesce(change, F.lit(0.0))
    chosen = F.when(F.coalesce(now, F.lit(0.0)) == 0, F.lit("none"))
    for limit, label in CHANGE_CLASSES:
        chosen = chosen.when(c >= limit if limit > 0 else c > limit, F.lit(label))
    return chosen.otherwise(F.lit("loses"))


def top_share_flag(rows: DataFrame, value: str, prob: float, out: str) -> DataFrame:
    """True at or above the quantile of the positive values."""
    limit = exact_quantiles(rows.filter(F.col(value) > 0), [], value, {"limit": prob}).scalar()
    return rows.withColumn(out, F.coalesce(F.col(value) >= limit, F.lit(False)))


def rank_class(rows: DataFrame, value: str, prob: float) -> DataFrame:
    """Value at position ``floor(n * prob)`` of the sorted positives, without interpolation."""
    positive = rows.filter(F.col(value) > 0)
    n = positive.count()
    if n == 0:
        return exact_quantiles(positive, [], value, {"limit": 1.0})
    place = min(int(n * prob), n - 1)
    return exact_quantiles(positive, [], value, {"limit": place / (n - 1) if n > 1 else 0.0})
