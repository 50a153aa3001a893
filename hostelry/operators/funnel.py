"""Exclusion funnel: every row counts at the first step it fails."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostelry.operators.distribution import keep_first


def first_reason(rows: DataFrame, steps: Sequence[tuple[str, Column]], reason: str = "reason") -> DataFrame:
    """Adds the name of the first failing step; null for rows that pass all. A condition that is
    null does not fail its row: say so in the condition when it should."""
    chosen = F.when(F.lit(False), F.lit(""))
    for name, fails in steps:
        chosen = chosen.when(fails, F.lit(name))
    return rows.withColumn(reason, chosen)


def funnel(rows: DataFrame, steps: Sequence[str], reason: str, capacity: str) -> DataFrame:
    """Per step: dropped rows and capacity, and what remains after it.

    One pass over the rows gives a row of totals; the running remainder is arithmetic on them.
    Undeclared reasons raise.
    """
    declared = F.col(reason).isNull() | F.col(reason).isin(*steps)
    place = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in steps]), F.col(reason)), F.lit(0))
    size = F.coalesce(F.col(capacity), F.lit(0)).cast("double")
    sums = [
        F.count(F.lit(1)).alias("__n"),
        F.sum(size).alias("__c"),
        F.coalesce(F.sum((~declared).cast("long")), F.lit(0)).alias("__unknown"),
    ]
    for i in range(1, len(steps) + 1):
        sums.append(F.count(F.when(place == i, 1)).alias(f"__n{i}"))
        sums.append(F.coalesce(F.sum(F.when(place == i, size)), F.lit(0.0)).alias(f"__c{i}"))
    totals = rows.agg(*sums)
    lines = []
    for i, name in enumerate(steps, 1):
        gone = reduce(lambda a, b: a + b, [F.col(f"__n{j}") for j in range(1, i + 1)])
        freed = reduce(lambda a, b: a + b, [F.col(f"__c{j}") for j in range(1, i + 1)])
        lines.append(F.struct(
            F.lit(i).alias("step_no"), F.lit(name).alias("step"),
            F.col(f"__n{i}").alias("dropped"), F.col(f"__c{i}").alias("dropped_capacity"),
            (F.col("__n") - gone).alias("remaining"), (F.col("__c") - freed).alias("remaining_capacity"),
        ))
    checked = F.when(
        F.col("__unknown") > 0, F.raise_error(F.lit("a reason has no declared step")).cast(
            "array<struct<step_no:int,step:string,dropped:bigint,dropped_capacity:double,"
            "remaining:bigint,remaining_capacity:double>>")
    ).otherwise(F.array(*lines))
    return totals.select(F.inline(checked))


def undeclared_reasons(rows: DataFrame, steps: DataFrame, reason: str, step: str) -> DataFrame:
    """Reasons in the rows that the step table does not declare, with their counts."""
    seen = rows.filter(F.col(reason).isNotNull()).groupBy(reason).agg(F.count(F.lit(1)).alias("rows"))
    return seen.join(steps, seen[reason] == steps[step], "left_anti")


def survivors_and_reasons(
    rows: DataFrame, steps: Sequence[tuple[str, Column]], duplicate_keys: Sequence[str],
    row_id: str, order: Sequence[Column], duplicate: str = "duplicate", reason: str = "reason",
) -> DataFrame:
    """Reason per row, including ``duplicate`` for rows that pass every step and lose the dedup.

    Winners are found among passing rows only, then joined back on the unique row id.
    """
    marked = first_reason(rows, steps, reason)
    winners = (
        keep_first(marked.filter(F.col(reason).isNull()), duplicate_keys, order)
        .select(F.col(row_id).alias("__winner"))
    )
    joined = marked.join(winners, marked[row_id] == F.col("__winner"), "left")
    lost = F.col(reason).isNull() & F.col("__winner").isNull()
    return joined.withColumn(reason, F.when(lost, F.lit(duplicate)).otherwise(F.col(reason))).drop("__winner")


def breakdown(rows: DataFrame, reason: str, labels: dict[str, Column]) -> DataFrame:
    """Counts per step and per that step's own telling label."""
    label = F.when(F.lit(False), F.lit(""))
    for step, column in labels.items():
        label = label.when(F.col(reason) == step, column)
    return (
        rows.filter(F.col(reason).isNotNull())
        .groupBy(F.col(reason).alias("step"), label.alias("label"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
