"""Selecting, mapping and completing columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostelry.functions.text import fold_lower, lookup
from hostelry.operators.distribution import keep_first


def rename_select(rows: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return rows.select(*[F.col(old).alias(new) for old, new in mapping.items()])


def reindex(rows: DataFrame, target: Mapping[str, str]) -> DataFrame:
    """Target columns in order with their types; those the table lacks are null."""
    return rows.select(*[
        (F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in target.items()
    ])


def mapped(value: Column, mapping: Mapping[str, str], otherwise: str | None = None) -> Column:
    return F.coalesce(F.try_element_at(lookup(mapping), value), F.lit(otherwise).cast("string"))


def first_match(cases: Sequence[tuple[Column, str]], otherwise: str | None = None) -> Column:
    chosen = F.when(F.lit(False), F.lit(""))
    for condition, label in cases:
        chosen = chosen.when(condition, F.lit(label))
    return chosen.otherwise(F.lit(otherwise).cast("string"))


def relabel(rows: DataFrame, mask: Column, values: Mapping[str, str]) -> DataFrame:
    """Sets several columns at once where the mask holds."""
    hit = F.coalesce(mask, F.lit(False))
    return rows.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def complete_by_source(
    rows: DataFrame, key: str, fields: Sequence[str], own: str,
    sources: Sequence[tuple[str, DataFrame]], origin: str, order: str,
) -> DataFrame:
    """Fills fields from sources in order of trust, never a better one by a worse, with a label.

    Each source is cut to one row per key first, so rows cannot multiply.
    """
    lead = fields[0]
    out = rows.withColumn(origin, F.when(F.col(lead).isNotNull(), F.lit(own)))
    for label, source in sources:
        one = keep_first(source.filter(F.col(key).isNotNull()), [key], [F.col(order)]).select(
            F.col(key).alias("__key"), *[F.col(f).alias(f"__{f}") for f in fields]
        )
        out = out.join(one, out[key] == one["__key"], "left")
        gap = F.col(lead).isNull() & F.col(f"__{lead}").isNotNull()
        filled = {f: F.when(gap, F.col(f"__{f}")).otherwise(F.col(f)) for f in fields}
        filled[origin] = F.when(gap, F.lit(label)).otherwise(F.col(origin))
        out = out.withColumns(filled).drop("__key", *[f"__{f}" for f in fields])
    return out


def select_by_category(rows: DataFrame, column: str, wanted: Mapping[str, str], label: str) -> DataFrame:
    """Keeps rows whose category contains a wanted key, labelled; each key must name exactly one
    category. Categories are few by nature and are what the check looks at."""
    categories = rows.select(column).distinct()
    folded = fold_lower(F.col(column))
    hits = categories.select(
        column, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias(label)) for k, v in wanted.items()])).alias("w")
    ).select(column, "w.*").filter(folded.contains(F.col("k")))
    found = {r["k"]: r["n"] for r in hits.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    wrong = {k: found.get(k, 0) for k in wanted if found.get(k, 0) != 1}
    if wrong:
        raise ValueError(f"keys that do not name exactly one category: {wrong}")
    return rows.join(F.broadcast(hits.select(column, label)), column)


def cap_outliers(
    rows: DataFrame, value: str, segment: Sequence[str], factor: float = 5.0,
    capped: str = "capped", flag: str = "was_capped",
) -> DataFrame:
    """Caps a value at ``factor`` times its segment's median; the row stays, the flag tells."""
    from hostelry.operators.distribution import attach
    from hostelry.operators.quantiles import exact_quantiles

    medians = exact_quantiles(rows, segment, value, {"__median": 0.5})
    top = F.col("__median") * F.lit(float(factor))
    return (
        attach(rows, medians, segment)
        .withColumn(flag, F.coalesce(F.col(value) > top, F.lit(False)))
        .withColumn(capped, F.when(F.col(flag), top).otherwise(F.col(value)))
        .drop("__median")
    )


def mask_persons(rows: DataFrame, tax_id: str, hidden: Sequence[str], marker: str, flag: str) -> DataFrame:
    """Nulls the hidden columns of natural persons, told by the marker or by the number's shape."""
    person = F.coalesce(
        (F.col(tax_id) == marker) | F.col(tax_id).rlike("^[0-9]{8}[A-Za-z]$"), F.lit(False)
    )
    marked = rows.withColumn(flag, person)
    return marked.withColumns({c: F.when(~F.col(flag), F.col(c)) for c in hidden})


def publishable(rows: DataFrame, key: str, name: str, capacity: str, minimum: int, k: int) -> DataFrame:
    """Largest k groups by rows, named only when the group has the minimum support."""
    sums = rows.groupBy(key).agg(
        F.min(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(capacity).alias("capacity")
    )
    return sums.filter(F.col("n") >= minimum).orderBy(F.col("n").desc(), F.col(key)).limit(k)


def move_by_reason(rows: DataFrame, stays, reason: str, value: str) -> DataFrame:
    """Adds a reason to rows that must leave; running it again changes nothing."""
    leaves = ~F.coalesce(stays, F.lit(False)) & F.col(reason).isNull()
    return rows.withColumn(reason, F.when(leaves, F.lit(value)).otherwise(F.col(reason)))
