"""Exact quantiles of groups of any size.

Equal values collapse first. A group with many distinct values, by a mergeable sketch of their number, is cut into value
ranges by a sketch of its own splits; range totals say which range holds the answer, and only the rows of that range meet and
are ordered. Sketches and totals combine before the shuffle, so a large group's values are never shuffled as a whole.
Nothing is written in between: the sketches only choose the plan. Weights add as whole billionths, so the answer is that of exact arithmetic on either way.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostelry.operators.distribution import spread_join


RANGES, STRIDE = 256, 16
#: Distinct values of a group that are put in order together, about and by sketch; a larger group is cut into ranges first.
#: Both ways compare the same exact sums, so the setting only chooses the plan, never the answer.
LARGE_FLOOR_SETTING = "spark.hostelry.largeGroup"
LARGE_FLOOR = 2_000_000
#: Weights and shares count in units of 1e-9, as whole numbers, so their sums do not depend on an order.
UNIT = 1_000_000_000


def _large_groups(sizes: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Their keys, if there are any: few rows, as each has at least so many values."""
    spark = sizes.sparkSession
    floor = int(spark.conf.get(LARGE_FLOOR_SETTING, str(LARGE_FLOOR)))
    large = sizes.filter(F.col("__values") >= floor).select(*keys)
    found = large.collect()
    return spark.createDataFrame(found, large.schema) if found else None


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str | Column,
    probs: dict[str, float],
    *,
    weight: Column | None = None,
    times: Column | None = None,
    rule: str = "linear",
) -> DataFrame:
    """One row per group with a column per name in ``probs``. ``times``: how often a row counts, a whole number.

    ``rule="linear"`` interpolates between neighbours (unit weights). ``rule="reach"`` takes the
    first value whose cumulative weight share reaches the probability.
    """
    keys = [f"__k{i}" for i in range(len(by))] or ["__k0"]
    source = [F.col(c) for c in by] or [F.lit(0)]
    column = F.col(value) if isinstance(value, str) else value
    if weight is None:
        kind, amount = "bigint", F.lit(1) if times is None else times
    else:
        kind, amount = "decimal(28,0)", F.when(~F.isnan(weight.cast("double")), F.round(weight.cast("double") * UNIT))
    rows = (
        df.select(
            *[c.alias(k) for c, k in zip(source, keys)],
            column.cast("double").alias("__v"),
            amount.cast(kind).alias("__w"),
        )
        .filter(F.col("__v").isNotNull() & ~F.isnan("__v") & F.col("__w").isNotNull())
    )
    sizes = rows.groupBy(*keys).agg(F.approx_count_distinct("__v", 0.1).alias("__values"))
    marks = {name: _targets(q, rule) for name, q in probs.items()}
    large = _large_groups(sizes, keys)
    if large is None:
        along, whole = Window.partitionBy(*keys).orderBy("__v"), Window.partitionBy(*keys)
        rows = _collapsed(rows, [*keys, "__v"], kind).select(
            *keys, "__v", "__w", F.sum("__w").over(along).cast(kind).alias("__end"), F.sum("__w").over(whole).cast(kind).alias("__total"))
    else:
        rows = _in_ranges(rows, large, keys, marks, rule, kind)
    begin, finish = F.col("__end") - F.col("__w"), F.col("__end")
    parts = []
    for name, (low, high) in marks.items():
        pick = F.max if rule == "linear" else F.min
        parts.append(pick(F.when(_holds(low, begin, finish, rule), F.col("__v"))).alias(f"__lo_{name}"))
        parts.append(pick(F.when(_holds(high, begin, finish, rule), F.col("__v"))).alias(f"__hi_{name}"))
    found = rows.groupBy(*keys).agg(F.max("__total").alias("__total"), *parts)
    out = [F.col(k).alias(c) for k, c in zip(keys, by)]
    for name, q in probs.items():
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        if rule == "linear":
            place = F.lit(q) * (F.col("__total").cast("double") - 1)
            out.append((low + (high - low) * (place - F.floor(place))).alias(name))
        else:
            out.append(low.alias(name))
    return found.select(*out)


def _collapsed(rows: DataFrame, keys: Sequence[str], kind: str, name: str = "__w") -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("__w").cast(kind).alias(name))


def _in_ranges(rows: DataFrame, large: DataFrame, keys: Sequence[str], marks: dict, rule: str, kind: str) -> DataFrame:
    """Values of the ranges that hold an answer, with the cumulative weight at their end; a small group is one range."""
    cuts = (
        _sent(rows, large.select(*keys, F.lit(True).alias("__large")), keys, "left_semi")
        .groupBy(*keys)
        .agg(F.percentile_approx("__v", [i / RANGES for i in range(1, RANGES)], RANGES * 8).alias("__cuts"))
    )
    # two steps of at most STRIDE comparisons: the cuts in between, then those of the stretch
    below = lambda some: F.size(F.filter(some, lambda x: x < F.col("__v")))
    ranged = (
        _sent(rows, cuts.select(*keys, "__cuts", F.filter("__cuts", lambda x, i: i % STRIDE == STRIDE - 1).alias("__coarse")), keys, "left")
        .withColumn("__at", below(F.col("__coarse")) * STRIDE)
        .withColumn("__range", F.coalesce(F.col("__at") + below(F.slice("__cuts", F.col("__at") + 1, F.lit(STRIDE))), F.lit(0)))
        .select(*keys, "__range", "__v", "__w", F.col("__cuts").isNotNull().alias("__large"))
    )
    # one row per (group, range): at most RANGES rows per group from here on
    sums = _collapsed(ranged, [*keys, "__range", "__large"], kind, "__rw")
    along = Window.partitionBy(*keys).orderBy("__range")
    whole = Window.partitionBy(*keys)
    sums = sums.select(
        *keys, "__range", "__large", (F.sum("__rw").over(along) - F.col("__rw")).cast(kind).alias("__before"), "__rw",
        F.sum("__rw").over(whole).cast(kind).alias("__total"))
    start, end = F.col("__before"), F.col("__before") + F.col("__rw")
    wanted = reduce(
        lambda a, b: a | b,
        [_holds(t, start, end, rule) for low, high in marks.values() for t in (low, high)],
    )
    sums = sums.filter(wanted)
    held = _sent(ranged, sums.where("__large").select(*keys, "__range", F.lit(True).alias("__wanted")), [*keys, "__range"], "left").where(
        ~F.col("__large") | F.col("__wanted"))
    inside = Window.partitionBy(*keys, "__range").orderBy("__v")
    return spread_join(_collapsed(held, [*keys, "__range", "__v"], kind), sums.drop("__large"), [*keys, "__range"]).withColumn(
        "__end", F.col("__before") + F.sum("__w").over(inside)
    )


def _sent(rows: DataFrame, few: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join with a few rows that go to every task; nulls match nulls."""
    few = few.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    joined = rows.join(F.broadcast(few), on, how)
    return joined if how == "left_semi" else joined.drop(*[f"__r_{k}" for k in keys])


def _targets(q: float, rule: str) -> tuple[Column, Column]:
    """Cumulative weights that the answer's neighbours hold; for ``reach`` in units of a unit, so it is whole."""
    total = F.col("__total")
    if rule == "linear":
        place = F.lit(float(q)) * (total.cast("double") - 1)
        return F.floor(place).cast("decimal(28,0)"), F.ceil(place).cast("decimal(28,0)")
    share = F.lit(round(q * UNIT)).cast("decimal(10,0)") * total.cast("decimal(28,0)")
    return share, share


def _holds(target: Column, start: Column, end: Column, rule: str) -> Column:
    if rule == "linear":
        return (start <= target) & (target < end)
    start, end = (x.cast("decimal(28,0)") * F.lit(UNIT).cast("decimal(10,0)") for x in (start, end))
    return ((start < target) | ((target <= 0) & (start <= 0))) & (target <= end)
