"""How rows meet their keys when one key may hold a large share of the table.

Three rules carry the library:

* aggregates come first, because Spark combines them before the shuffle whatever the skew;
* a per-key result goes back to its rows through :func:`attach`, which lets hot keys be cut up;
* "first of" and "top k of" use a ranked window with a bound, which Spark cuts before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostelry.session import durable


def spread_join(
    rows: DataFrame,
    side: DataFrame,
    keys: Sequence[str],
    *,
    how: str = "inner",
    condition: Column | None = None,
) -> DataFrame:
    """Equi-join where ``rows`` may be skewed on ``keys``; nulls match nulls.

    Adaptive execution cuts an oversized partition of a join into pieces, but only where both
    inputs come straight from a shuffle. A side that was just aggregated by the same keys does not.
    Joining on the keys and on their hash asks for a fresh shuffle of both, so the cut applies to a
    hot key whatever the inputs are, and a side that turns out small is still broadcast at run time.
    ``condition`` is written over the columns of both sides.
    """
    left = rows.withColumn("__hash", F.xxhash64(*[F.col(k) for k in keys]))
    right = side.withColumnsRenamed({k: f"__r_{k}" for k in keys}).withColumn(
        "__r_hash", F.xxhash64(*[F.col(f"__r_{k}") for k in keys])
    )
    on = (F.col("__hash") == F.col("__r_hash")) & reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    )
    if condition is not None:
        on = on & condition
    joined = left.join(right, on, how)
    return joined.drop("__hash", "__r_hash", *[f"__r_{k}" for k in keys])


def attach(rows: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of a one-row-per-key result back to its rows."""
    return spread_join(rows, stats, keys, how="left")


def group_stats(rows: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Adds per-group aggregates to every row without gathering a group in one task."""
    stats = rows.groupBy(*keys).agg(*[c.alias(name) for name, c in aggs.items()])
    return attach(rows, stats, keys)


def keep_first(rows: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """First row per key. The bounded rank lets Spark cut each group before the shuffle."""
    return top_per_group(rows, keys, order, 1)


def top_per_group(
    rows: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], k: int, rank: str | None = None
) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = rows.withColumn("__rank", F.row_number().over(window)).filter(F.col("__rank") <= k)
    return ranked.withColumnRenamed("__rank", rank) if rank else ranked.drop("__rank")


def dense_index(rows: DataFrame, order: Sequence[Column], index: str = "index", only_order: Sequence[str] = ()) -> DataFrame:
    """Numbers rows 0..n-1 in order without one task seeing them all. Columns named in ``only_order`` are left out of the result.

    Range partitions are numbered locally, then shifted by the rows before them; the table of
    shifts has one row per partition.
    """
    placed = (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__at", F.monotonically_increasing_id())
        .drop(*only_order)
    )
    placed = durable(placed).withColumn("__part", F.shiftright("__at", 33))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    shifts = sizes.select(
        "__part",
        (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__before"),
    )
    return (
        placed.join(F.broadcast(shifts), "__part")
        .withColumn(index, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__part", "__at", "__before")
    )
