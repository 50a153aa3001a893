"""Running totals over a global order, without one task seeing all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostelry.session import durable


def running_totals(rows: DataFrame, order: Sequence[Column], totals: dict[str, Column]) -> DataFrame:
    """Adds, per name in ``totals``, the sum of the expression over all rows before this one in ``order``.

    Rows are range-sorted and written; ranges are totalled by themselves, then shifted by the ranges before them. The
    table of shifts has a row per range. Rows that ``order`` cannot tell apart share a range, in any order. Sums are
    those of the expression's type, so whole numbers stay exact. ``discard`` removes what was written.
    """
    named = {name: f"__t{i}" for i, name in enumerate(totals)}
    placed = durable(
        rows.withColumns({named[name]: value for name, value in totals.items()})
        .repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    )
    written = placed.withColumn("__part", F.shiftright("__at", 33))
    sums = written.groupBy("__part").agg(*[F.sum(t).alias(f"__s{t}") for t in named.values()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    shifts = sums.select("__part", *[F.coalesce(F.sum(f"__s{t}").over(before), F.lit(0)).alias(f"__b{t}") for t in named.values()])
    within = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    done = written.join(F.broadcast(shifts), "__part").withColumns({
        name: F.col(f"__b{t}") + F.coalesce(F.sum(t).over(within), F.lit(0)) for name, t in named.items()
    }).drop("__part", "__at", *named.values(), *[f"__b{t}" for t in named.values()])
    done.scratch_path = placed.scratch_path
    return done


def numbered(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Adds the number of rows before this one in ``order``, as above; rows move once. ``discard`` removes what was written."""
    placed = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    written = placed.withColumn("__part", F.shiftright("__at", 33))
    sizes = written.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    shifts = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    done = written.join(F.broadcast(shifts), "__part").withColumn(
        name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__at", "__before")
    done.scratch_path = placed.scratch_path
    return done
