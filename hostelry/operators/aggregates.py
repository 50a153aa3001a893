"""Reports by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequency(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per value with their percentage of all rows."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    whole = counts.select(F.sum("rows")).scalar()
    return counts.withColumn("pct", F.round(F.col("rows") * 100.0 / whole, 2))


def crosstab(rows: DataFrame, a: str, b: str, domain: Sequence, total: str = "Total") -> DataFrame:
    """Counts by a × b with a Total row and column, from one cube."""
    cube = (
        rows.select(F.col(a).cast("string").alias(a), F.col(b).cast("string").alias(b))
        .cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping(a).alias("ga"), F.grouping(b).alias("gb"))
        .select(F.when(F.col("ga") == 1, total).otherwise(F.col(a)).alias(a),
                F.when(F.col("gb") == 1, total).otherwise(F.col(b)).alias(b), "n")
    )
    columns = [*[str(d) for d in domain], total]
    return cube.groupBy(a).pivot(b, columns).agg(F.sum("n")).na.fill(0, columns).orderBy(F.col(total).desc(), a)


def weighted_summary(rows: DataFrame, value: str, weight: str, masks: dict) -> DataFrame:
    """Weighted mean and the weight share of each predicate."""
    w = F.col(weight)
    return rows.agg(
        F.sum(w).alias("weight"), (F.sum(w * F.col(value)) / F.sum(w)).alias("mean"), F.max(value).alias("largest"),
        *[(F.coalesce(F.sum(F.when(m, w)), F.lit(0.0)) * 100.0 / F.sum(w)).alias(n) for n, m in masks.items()],
    )


def mode(rows: DataFrame, by: Sequence[str], value: str, minimum: int = 1, out: str = "mode", n: str = "n") -> DataFrame:
    """Commonest value per group and its count, if it reaches the minimum; ties go to the lower value."""
    from hostelry.operators.distribution import keep_first

    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias(out)).agg(F.count(F.lit(1)).alias(n))
    return keep_first(counts, by, [F.col(n).desc(), F.col(out)]).filter(F.col(n) >= minimum)


def value_sets(rows: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """Distinct values per key as a sorted array; the distinct happens before the gathering."""
    return rows.filter(F.col(value).isNotNull()).select(by, value).distinct().groupBy(by).agg(
        F.array_sort(F.collect_list(value)).alias(out))


def null_profile(rows: DataFrame) -> DataFrame:
    """Nulls per column with percentage, in one pass."""
    sums = rows.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in rows.columns])
    lines = [F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls"),
                      F.round(F.col(c) * 100.0 / F.col("__n"), 2).alias("pct")) for c in rows.columns]
    return sums.select(F.inline(F.array(*lines)))


def coverage_rates(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    sums = rows.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(c) for c in columns])
    lines = [F.struct(F.lit(c).alias("column"), F.col(c).alias("present"),
                      F.round(F.col(c) / F.col("__n"), 4).alias("rate")) for c in columns]
    return sums.select(F.inline(F.array(*lines)))


def correlations(rows: DataFrame, columns: Sequence[str], minimum: float = 0.0) -> DataFrame:
    """Correlation of every pair in one pass; a pair leaves out only its own nulls."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    def paired(a, b):
        known = F.col(a).isNotNull() & F.col(b).isNotNull()
        return F.corr(F.when(known, F.col(a).cast("double")), F.when(known, F.col(b).cast("double")))
    sums = rows.agg(*[paired(a, b).alias(f"__{i}") for i, (a, b) in enumerate(pairs)])
    lines = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"__{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return sums.select(F.inline(F.array(*lines))).filter(F.abs("r") >= minimum)


def determines(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Values per key: median, most, and keys with more than one."""
    from hostelry.operators.quantiles import exact_quantiles

    per = rows.select(key, value).distinct().groupBy(key).agg(F.count(value).alias("k"))
    middle = exact_quantiles(per, [], "k", {"median": 0.5}).scalar()
    return per.agg(F.max("k").alias("most"), F.sum((F.col("k") > 1).cast("long")).alias("broken"),
                   F.count(F.lit(1)).alias("keys")).withColumn("median", middle)


def shared_values(rows: DataFrame, value: str, holder: str) -> DataFrame:
    """Values on more than one row, and on how many holders."""
    pairs = rows.filter(F.col(value).isNotNull()).groupBy(value, holder).agg(F.count(F.lit(1)).alias("__n"))
    return pairs.groupBy(value).agg(F.sum("__n").alias("rows"), F.count(holder).alias("holders")).filter("rows > 1")


def split_by_flag(rows: DataFrame, category: str, flag) -> DataFrame:
    """Flagged rows by category and in all, with shares of the category and of the table."""
    sums = rows.groupBy(category).agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.coalesce(flag, F.lit(False)).cast("long")).alias("flagged"))
    both = sums.groupingSets([[category], []], category).agg(
        F.sum("total").alias("total"), F.sum("flagged").alias("flagged"), F.grouping(category).alias("__g"))
    whole = sums.select(F.sum("total")).scalar()
    return both.select(
        F.when(F.col("__g") == 1, "TOTAL").otherwise(F.col(category)).alias(category), "total", "flagged",
        F.round(F.col("flagged") * 100.0 / F.col("total"), 2).alias("pct_of_category"),
        F.round(F.col("flagged") * 100.0 / whole, 2).alias("pct_of_all"))


def error_report(rows: DataFrame, segment: str, actual: str, predicted: str) -> DataFrame:
    """Rows, median actual, mean absolute error, bias and its share of the median, by segment."""
    from hostelry.operators.quantiles import exact_quantiles

    gap = F.col(predicted) - F.col(actual)
    sums = rows.groupBy(segment).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(gap)).alias("mae"), F.avg(gap).alias("bias"))
    middle = exact_quantiles(rows, [segment], actual, {"median_actual": 0.5})
    return sums.join(middle, segment).withColumn("mape", F.col("mae") * 100.0 / F.col("median_actual"))
