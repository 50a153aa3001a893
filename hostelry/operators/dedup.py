"""De-duplication: keep one, flag all, chains of keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostelry.operators.distribution import attach, keep_first


def flag_repeats(rows: DataFrame, keys: Sequence[str], flag: str, when: Column | None = None) -> DataFrame:
    """True on every row whose key occurs more than once; rows outside ``when`` are never flagged."""
    inside = rows if when is None else rows.filter(when)
    counts = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("__copies"))
    joined = attach(rows, counts, keys)
    repeated = F.coalesce(F.col("__copies") > 1, F.lit(False))
    if when is not None:
        repeated = repeated & F.coalesce(when, F.lit(False))
    return joined.withColumn(flag, repeated).drop("__copies")


@dataclass(frozen=True)
class Step:
    """One link of a chain: rows that meet ``applies`` keep one per key, the others pass."""

    keys: Sequence[str]
    applies: Column | None = None
    label: str = field(default="")


def _solo(step: Step, row_id: str) -> Column:
    if step.applies is None:
        return F.lit(None).cast("string")
    return F.when(~F.coalesce(step.applies, F.lit(False)), F.col(row_id).cast("string"))


def _step_keys(step: Step, row_id: str) -> list[Column]:
    """A row outside the step gets its own id for a key, so it never meets another."""
    solo = _solo(step, row_id)
    return [solo, *[F.when(solo.isNull(), F.col(k)) for k in step.keys]]


def dedup_chain(rows: DataFrame, steps: Sequence[Step], row_id: str, order: Sequence[Column]) -> DataFrame:
    """Applies the steps from strict to loose. Each is one bounded rank, no split and union."""
    out = rows
    for step in steps:
        out = keep_first(out, _step_keys(step, row_id), order)
    return out


def chain_report(rows: DataFrame, steps: Sequence[Step], row_id: str, order: Column) -> DataFrame:
    """Rows removed by each step, in one flow: each survivor carries what it absorbed so far."""
    columns = list(rows.columns)
    out = rows
    for i, step in enumerate(steps):
        keys = [k.alias(f"__g{j}") for j, k in enumerate(_step_keys(step, row_id))]
        before = [F.sum(f"__lost{j}").alias(f"__lost{j}") for j in range(i)]
        out = (
            out.groupBy(*keys)
            .agg(
                F.min_by(F.struct(*columns), F.struct(order)).alias("__row"),
                (F.count(F.lit(1)) - 1).alias(f"__lost{i}"),
                *before,
            )
            .select("__row.*", *[f"__lost{j}" for j in range(i + 1)])
        )
    totals = out.agg(
        F.count(F.lit(1)).alias("__kept"), *[F.sum(f"__lost{i}").alias(f"__lost{i}") for i in range(len(steps))]
    )
    lines = [
        F.struct(F.lit(i + 1).alias("step_no"), F.lit(s.label).alias("step"),
                 F.coalesce(F.col(f"__lost{i}"), F.lit(0)).alias("removed"), F.col("__kept").alias("kept_at_end"))
        for i, s in enumerate(steps)
    ]
    return totals.select(F.inline(F.array(*lines)))


def latest_visit(
    rows: DataFrame, keys: Sequence[str], visited: str, identified: str, row_id: str
) -> DataFrame:
    """Latest visit per key among identified rows; the rest pass. A missing date counts as last."""
    order = [F.col(visited).desc_nulls_first(), F.col(row_id).desc()]
    step = Step(keys, F.col(identified))
    return keep_first(rows, _step_keys(step, row_id), order)


def duplicate_report(
    rows: DataFrame, criteria: dict[str, Sequence[str]], segment: str,
    not_null: Sequence[str] = (),
) -> DataFrame:
    """Rows in repeated keys under each criterion, by segment, with the share of the segment.

    Only counts move: per key and segment, then per key with its few segments, then per segment.
    """
    total = rows.groupBy(segment).agg(F.count(F.lit(1)).alias("segment_rows"))
    found = None
    for label, keys in criteria.items():
        inside = rows
        for k in keys:
            if k in not_null:
                inside = inside.filter(F.col(k).isNotNull())
        names = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
        counts = inside.groupBy(*names, F.col(segment).alias("__segment")).agg(F.count(F.lit(1)).alias("__n"))
        repeated = counts.groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(
            F.sum("__n").alias("__all"), F.collect_list(F.struct("__segment", "__n")).alias("__parts")).filter("__all > 1")
        one = repeated.select(F.inline("__parts")).groupBy("__segment").agg(F.sum("__n").alias("repeated")).withColumn("criterion", F.lit(label))
        found = one if found is None else found.unionByName(one)
    lines = total.withColumn("criterion", F.explode(F.array(*[F.lit(label) for label in criteria])))
    found = found.withColumnRenamed("criterion", "__criterion")
    same = F.col(segment).eqNullSafe(F.col("__segment")) & (F.col("criterion") == F.col("__criterion"))
    joined = lines.join(found, same, "left").withColumn("repeated", F.coalesce("repeated", F.lit(0)).cast("long"))
    return joined.select(
        segment, "criterion", "repeated", "segment_rows",
        F.round(F.col("repeated") * 100.0 / F.col("segment_rows"), 2).alias("pct"),
    )


def group_sizes(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many groups have each size, among repeated keys."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def coincidences(rows: DataFrame, keys: Sequence[str], attributes: dict[str, Sequence[str]]) -> DataFrame:
    """Rows that repeat the key and also agree on further attributes, per attribute set."""
    parts = None
    for label, extra in attributes.items():
        sizes = rows.groupBy(*keys, *extra).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        line = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).select(
            F.lit(label).alias("same"), "rows"
        )
        parts = line if parts is None else parts.unionByName(line)
    return parts
