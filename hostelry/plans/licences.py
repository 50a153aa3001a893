"""Licence jobs: verification in three states, ceilings, shared numbers, host portfolios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostelry.functions.licence import is_filler
from hostelry.operators.aggregates import value_sets
from hostelry.operators.distribution import group_stats, keep_first, spread_join
from hostelry.operators.linkage import member

# Prefixes whose registry can be looked up, and prefixes of establishments.
CHECKABLE = ["HUTB", "HB", "HCC", "ATB", "ATCC"]
ESTABLISHMENT = ["HB", "HCC", "AJ"]
DWELLING_PREFIX = "HUTB"
# States and reasons.
WITH_LICENCE, UNPROVEN, WITHOUT = "with_licence", "unproven_licence", "without_licence"
REASONS = {
    "unverifiable": "declared, cannot be verified",
    "found": "found in the registry",
    "above_max": "number above the highest issued",
    "filler": "filler number",
    "unknown": "number not in the registry",
    "host_establishment": "host proves a hotel or hostel elsewhere",
    "host_dwelling": "host has dwelling licences, none tied to this one",
    "exempt": "declares an exemption",
    "nothing": "declares nothing",
}


def highest_number(registry: DataFrame, code: str, prefix: str = DWELLING_PREFIX) -> DataFrame:
    """Largest number among well-formed codes of the prefix."""
    pattern = rf"^{prefix}-(\d+)$"
    return registry.filter(F.col(code).rlike(pattern)).agg(
        F.max(F.regexp_extract(code, pattern, 1).cast("decimal(38,0)")).cast("bigint").alias("highest"))


def in_registry(rows: DataFrame, code: str, prefix: str, registry: DataFrame, checkable: Sequence[str] = CHECKABLE) -> DataFrame:
    """Adds ``found``: true, false, or null where the prefix has no registry or nothing is declared.

    ``registry`` has the column ``code``. A false number may be shared by very many rows, so the
    lookup spreads hot codes.
    """
    keys = registry.select(F.col("code").alias(code)).filter(F.col(code).isNotNull()).distinct().withColumn("__in", F.lit(True))
    joined = spread_join(rows, keys, [code], how="left")
    found = F.when(F.col(prefix).isin(*checkable), F.coalesce(F.col("__in"), F.lit(False)))
    return joined.withColumn("found", found).drop("__in")


def verification_report(rows: DataFrame, prefix: str, checkable: Sequence[str] = CHECKABLE) -> DataFrame:
    """Declared, found and not found by prefix; null counts where the prefix cannot be checked."""
    able = F.col(prefix).isin(*checkable)
    return rows.filter(F.col(prefix).isNotNull()).groupBy(prefix).agg(
        F.count(F.lit(1)).alias("declared"),
        F.sum(F.when(able, F.col("found").cast("long"))).alias("found"),
        F.sum(F.when(able, (~F.col("found")).cast("long"))).alias("not_found"),
    )


def verify(rows: DataFrame, registry: DataFrame, host: str = "host_id") -> DataFrame:
    """State and reason per row. ``rows`` has ``code``, ``prefix``, ``num`` and ``regional``."""
    looked = in_registry(rows, "code", "prefix", registry)
    hosts = group_stats(
        looked, [host],
        host_establishment=F.max(F.col("prefix").isin(*ESTABLISHMENT)),
        host_dwelling=F.max(F.col("prefix") == DWELLING_PREFIX),
    )
    top = highest_number(registry, "code").scalar()
    number = F.col("num").try_cast("decimal(38,0)")
    declared = F.col("code").isNotNull()
    key = (
        F.when(declared & F.col("found").isNull(), "unverifiable")
        .when(declared & F.col("found"), "found")
        .when(declared & (F.col("prefix") == DWELLING_PREFIX) & (number > top), "above_max")
        .when(declared & is_filler(F.col("num")), "filler")
        .when(declared, "unknown")
        .when(F.col("host_establishment"), "host_establishment")
        .when(F.col("host_dwelling"), "host_dwelling")
        .when(F.upper("regional").contains("EXEMPT"), "exempt")
        .otherwise("nothing")
    )
    state = (
        F.when(F.col("why").isin("unverifiable", "found"), WITH_LICENCE)
        .when(F.col("why").isin("above_max", "filler", "unknown", "host_establishment"), UNPROVEN)
        .otherwise(WITHOUT)
    )
    names = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return hosts.withColumn("why", key).withColumn("state", state).withColumn(
        "reason", F.try_element_at(names, F.col("why")))


def ceiling_split(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Numbers above the highest issued: as many digits as the ceiling, or more."""
    top = highest_number(registry, "code").scalar()
    number = F.col("num").try_cast("decimal(38,0)")
    false = rows.filter((F.col("prefix") == DWELLING_PREFIX) & ~F.coalesce(F.col("found"), F.lit(True)))
    above = number > top
    digits = F.length("num")
    ceiling = F.length(top.cast("string"))
    return false.agg(
        F.count(F.lit(1)).alias("not_found"),
        F.count(F.when(above, 1)).alias("above"),
        F.count(F.when(above & (digits == ceiling), 1)).alias("near"),
        F.count(F.when(above & (digits > ceiling), 1)).alias("far"),
        F.min(F.when(above, number)).cast("bigint").alias("lowest_above"),
    )


def unlicensed_active(rows: DataFrame, since: str, classes: Sequence[str], row_id: str = "id") -> DataFrame:
    """Active rows of the given classes, one per name and host."""
    active = rows.filter(F.col("class").isin(*classes) & (F.col("last_review") >= F.lit(since).cast("date")))
    return keep_first(active, ["name", "host_id"], [F.col(row_id)])


def attributed_regime(pending: DataFrame, rows: DataFrame, establishment: Sequence[str]) -> DataFrame:
    """Counts of unlicensed rows by what their host's other licences allow to conclude."""
    hosts = rows.filter(F.col("regional").isNotNull()).groupBy("host_id").agg(
        F.max(F.col("class").isin(*establishment)).alias("__est"))
    joined = spread_join(pending, hosts, ["host_id"], how="left")
    situation = (
        F.when(F.col("__est"), "host has hotel or hostel: attributed")
        .when(F.col("__est").isNotNull(), "host has other licences: not attributed")
        .otherwise("host has no licence")
    )
    return joined.groupBy(situation.alias("situation")).agg(F.count(F.lit(1)).alias("rows"))


def tied_to_host(pending: DataFrame, rows: DataFrame) -> DataFrame:
    """Unlicensed rows of licensed hosts: same listing, same profile, or undecided."""
    licensed = rows.filter(F.col("regional").isNotNull())
    hosts = licensed.select("host_id").distinct().withColumn("__h", F.lit(True))
    candidates = spread_join(pending, hosts, ["host_id"]).drop("__h")
    exact = member(candidates, licensed, ["host_id", "name"], "__exact")
    strong = member(exact, licensed, ["host_id", "area", "room_type", "price"], "__strong")
    criterion = F.when(F.col("__exact"), "same host and name").when(
        F.col("__strong"), "same host, area, type and price").otherwise("undecided")
    return strong.groupBy(criterion.alias("criterion")).agg(F.count(F.lit(1)).alias("rows"))


def host_classes(rows: DataFrame, none: str) -> DataFrame:
    """Licence classes of each host, the class ``none`` aside. Classes are few by definition."""
    return value_sets(rows.filter(F.col("class") != none), "host_id", "class", "classes")


def host_class_counts(pending: DataFrame, rows: DataFrame, none: str) -> DataFrame:
    """For unlicensed rows, how many have a host with each class, and the share of linked rows."""
    joined = spread_join(pending, host_classes(rows, none), ["host_id"])
    linked = joined.groupBy("classes").agg(F.count(F.lit(1)).alias("__n"))
    whole = linked.select(F.sum("__n")).scalar()
    return linked.select(F.explode("classes").alias("class"), "__n").groupBy("class").agg(
        F.sum("__n").alias("rows")).withColumn("pct", F.round(F.col("rows") * 100.0 / whole, 2))


def host_class_combinations(pending: DataFrame, rows: DataFrame, none: str) -> DataFrame:
    """Combinations of classes in the portfolios of the hosts, "A + B"."""
    joined = spread_join(pending, host_classes(rows, none), ["host_id"])
    return joined.groupBy(F.concat_ws(" + ", "classes").alias("combination")).agg(
        F.max(F.size("classes")).alias("classes"), F.count(F.lit(1)).alias("rows"))


def single_or_multi(pending: DataFrame, rows: DataFrame, none: str, listing_host: str = "host_id") -> DataFrame:
    """Hosts without any licence: how many have one listing and how many several, with their rows."""
    licensed = rows.filter(F.col("class") != none).select("host_id").distinct()
    free = pending.groupBy("host_id").agg(F.count(F.lit(1)).alias("__n")).join(licensed, "host_id", "left_anti")
    kind = F.when(F.col("__n") > 1, "several").otherwise("single")
    return free.groupBy(kind.alias("hosts_with")).agg(F.count(F.lit(1)).alias("hosts"), F.sum("__n").alias("rows"))


def stages_by_class(rows: DataFrame, classes: Sequence[str], since: str, row_id: str = "id") -> DataFrame:
    """Raw, active and de-duplicated rows by class with a TOTAL line."""
    chosen = rows.filter(F.col("class").isin(*classes))
    active = F.coalesce(F.col("last_review") >= F.lit(since).cast("date"), F.lit(False))
    raw = chosen.groupBy("class").agg(F.count(F.lit(1)).alias("raw"), F.sum(active.cast("long")).alias("active"))
    kept = keep_first(chosen.filter(active), ["name", "host_id"], [F.col(row_id)]).groupBy("class").agg(
        F.count(F.lit(1)).alias("distinct_rows"))
    both = raw.join(kept, "class", "left").na.fill(0, ["distinct_rows"])
    return both.rollup("class").agg(
        F.sum("raw").alias("raw"), F.sum("active").alias("active"), F.sum("distinct_rows").alias("distinct_rows"),
        F.grouping("class").alias("__g"),
    ).select(F.when(F.col("__g") == 1, "TOTAL").otherwise(F.col("class")).alias("class"), "raw", "active", "distinct_rows")


def states_by_group(rows: DataFrame, groups: dict[str, Sequence[str]], reason: str, capacity: str) -> DataFrame:
    """Rows and capacity by group of reasons, with the reasons inside it."""
    pairs = [(r, g) for g, reasons in groups.items() for r in reasons]
    to_group = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    lines = rows.groupBy(F.try_element_at(to_group, F.col(reason)).alias("group"), F.col(reason).alias("reason")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(capacity).alias("capacity"))
    return lines.filter(F.col("group").isNotNull()).rollup("group", "reason").agg(
        F.sum("rows").alias("rows"), F.sum("capacity").alias("capacity"), F.grouping_id().alias("level"))


def latent_capacity(rows: DataFrame, by: Column, capacity: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.sum(capacity).alias("capacity"))


def registry_profile(registry: DataFrame, code: str, capacity: str, year: Column, since: int, until: int) -> DataFrame:
    """Median size, highest number, first case year and cases within a range of years."""
    from hostelry.operators.quantiles import exact_quantiles

    middle = exact_quantiles(registry, [], capacity, {"median": 0.5}).scalar()
    number = F.regexp_extract(code, r"(\d+)", 1).try_cast("bigint")
    return registry.agg(
        F.count(F.lit(1)).alias("licences"), F.sum(capacity).alias("capacity"), F.max(number).alias("highest"),
        F.min(year).alias("first_year"), F.count(F.when(year.between(since, until), 1)).alias("in_range"),
    ).withColumn("median_capacity", middle)
