"""Period series: stocks and flows, seasonality, trailing windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostelry.operators.distribution import group_stats
from hostelry.operators.quantiles import exact_quantiles


def stock_and_flow(snapshots: DataFrame, period: str, item: str) -> DataFrame:
    """Items present, arrived and gone per period against the period before it.

    Periods are numbered among themselves; an item's row per period is unique, so looking at its
    neighbours needs no self-join and no task holds more than one item's history. The periods themselves
    are numbered in one task, so they must be periods (weeks, quarters), not moments.
    """
    seen = snapshots.filter(F.col(item).isNotNull()).select(period, item).distinct()
    periods = seen.select(period).distinct()
    numbered = periods.select(period, F.dense_rank().over(Window.orderBy(period)).alias("__p"))
    placed = seen.join(numbered, period)
    along = Window.partitionBy(item).orderBy("__p")
    marked = placed.select(
        "__p",
        (F.coalesce(F.lag("__p").over(along), F.lit(-1)) != F.col("__p") - 1).alias("__new"),
        (F.coalesce(F.lead("__p").over(along), F.lit(-1)) != F.col("__p") + 1).alias("__last"),
    )
    sums = marked.groupBy("__p").agg(
        F.count(F.lit(1)).alias("stock"),
        F.sum(F.col("__new").cast("long")).alias("arrived"),
        F.sum(F.col("__last").cast("long")).alias("leaving"),
    )
    order = Window.orderBy("__p")
    flows = sums.select(
        "__p", "stock",
        F.when(F.col("__p") > 1, F.col("arrived")).alias("inflow"),
        F.lag("leaving").over(order).alias("outflow"),
    )
    return flows.join(numbered, "__p").select(
        period, "stock", "inflow", "outflow", (F.col("inflow") - F.col("outflow")).alias("net"))


def span(series: DataFrame, period: str, value: str) -> DataFrame:
    """First, lowest and last value with their periods."""
    return series.agg(
        F.min(period).alias("first_period"), F.min_by(value, period).alias("first_value"),
        F.min_by(period, F.struct(value, period)).alias("lowest_period"), F.min(value).alias("lowest_value"),
        F.max(period).alias("last_period"), F.max_by(value, period).alias("last_value"),
    )


def normalised(series: DataFrame, value: str, group: Sequence[str], out: str) -> DataFrame:
    """Value over the mean of its group, as group sums joined back."""
    joined = group_stats(series, group, __mean=F.avg(value))
    return joined.withColumn(out, F.col(value) / F.col("__mean")).drop("__mean")


def seasonality(series: DataFrame, category: str, date: str, value: str, first_year: int) -> DataFrame:
    """Median over years of each month's ratio to its own year, with the years behind it."""
    recent = series.filter((F.year(date) >= first_year) & F.col(value).isNotNull()).select(
        category, F.year(date).alias("__y"), F.month(date).alias("month"), value)
    ratios = normalised(recent, value, [category, "__y"], "__ratio")
    factor = exact_quantiles(ratios, [category, "month"], "__ratio", {"factor": 0.5})
    support = ratios.groupBy(category, "month").agg(F.count(F.lit(1)).alias("years"))
    return factor.join(support, [category, "month"])


def trailing_mean(series: DataFrame, category: str, date: str, value: str, months: int = 12) -> DataFrame:
    """Mean by category over the last months, anchored on the latest date of the whole series."""
    latest = series.select(F.max(date)).scalar()
    recent = series.filter(F.col(date) >= F.add_months(latest, -(months - 1)))
    return recent.groupBy(category).agg(F.avg(value).alias(value))


def last_periods(series: DataFrame, period: str, k: int = 12) -> DataFrame:
    """Rows of the last k distinct periods."""
    top = series.select(period).distinct().orderBy(F.col(period).desc()).limit(k)
    return series.join(F.broadcast(top), period, "left_semi")


def official_totals(series: DataFrame, period: str, residents: str, foreign: str, nights_a: str, nights_b: str) -> DataFrame:
    """Guests, nights, mean stay, foreign share and nights per day over the last twelve periods."""
    rows = last_periods(series, period)
    guests = F.col(residents) + F.col(foreign)
    nights = F.col(nights_a) + F.col(nights_b)
    return rows.agg(
        F.min(period).alias("since"), F.max(period).alias("until"),
        F.sum(guests).alias("guests"), F.sum(nights).alias("nights"),
        (F.sum(nights) / F.sum(guests)).alias("mean_stay"),
        (F.sum(foreign) * 100.0 / F.sum(guests)).alias("foreign_pct"),
        (F.sum(nights) / 365.0).alias("nights_per_day"),
    )


def wide_to_long(wide: DataFrame, keys: Sequence[str], name: str, value: str) -> DataFrame:
    rest = [c for c in wide.columns if c not in keys]
    return wide.unpivot(list(keys), rest, name, value)


def long_to_wide(rows: DataFrame, row: str, column: str, domain: Sequence, value: Column) -> DataFrame:
    """Pivot over a fixed domain; absent cells are zero. A value outside the domain is an error, not a row less."""
    known = F.coalesce(F.col(column).isin(list(domain)), F.lit(False))
    message = F.concat(F.lit(f"{column} outside its domain: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))
    rows = rows.withColumn(column, F.when(known, F.col(column)).otherwise(F.raise_error(message).cast(rows.schema[column].dataType)))
    wide = rows.groupBy(row).pivot(column, list(domain)).agg(value)
    return wide.na.fill(0, [str(d) for d in domain])


def dense_matrix(rows: DataFrame, row: str, column: str, rows_domain: Mapping | Sequence, domain: Sequence, value: Column) -> DataFrame:
    """Pivot over fixed row and column domains; absent cells and absent rows are zero."""
    spark = rows.sparkSession
    base = spark.range(1).select(F.explode(F.array(*[F.lit(r) for r in rows_domain])).alias(row))
    wide = rows.groupBy(row).pivot(column, list(domain)).agg(value)
    return base.join(wide, row, "left").na.fill(0, [str(d) for d in domain])
