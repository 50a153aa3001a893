"""URL filters: rules by host and path, and empirical-Bayes reputation of hosts.

Labelled page outcomes are counted per host, registered domain (last two labels of the host) and suffix (last
label). Each level is a beta-binomial whose mean is the posterior mean of the level above and whose strength is
estimated from the spread of its groups (method of moments). A host is blocked if the lower bound of its
posterior share of bad pages, mean minus ``z`` standard deviations, is above ``limit``. Hosts without labelled
pages are judged by what their domain or suffix says.

Everything is aggregates and joins of the level tables; a hot host is counted before the shuffle and its rows
are cut up when its verdict comes back. ``rules`` is a short list; it becomes one expression.

Cases: a null url, or one without ``://``, has an empty host and path and no rule, and its verdict is that of the
empty host; ids may be null or repeat; outcomes may be null, missing or repeated (any bad one counts); without
outcomes nothing is blocked but by rules; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostelry.operators.distribution import attach

#: (verdict, host, path)
Rule = tuple[str, str, str]
LIMIT, Z = 0.5, 1.645
#: Bounds of the intra-group correlation that the strength comes from.
RHO = (0.001, 0.5)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.coalesce(F.position(F.lit("://"), url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Longest rule that fits, and its verdict; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _strength(groups: DataFrame, mean: str) -> DataFrame:
    """One row: how many observations the mean of the level above is worth."""
    spread = F.col(mean) * (1 - F.col(mean))
    seen = F.col("n") > 0
    sums = groups.agg(
        F.sum(F.when(seen, F.col("n") * F.pow(F.col("k") / F.col("n") - F.col(mean), 2))).alias("a_"),
        F.sum(F.when(seen, spread)).alias("b_"), F.sum(F.when(seen, (F.col("n") - 1) * spread)).alias("c_"))
    rho = F.when(F.col("c_") > 0, F.greatest(F.lit(RHO[0]), F.least(F.lit(RHO[1]), (F.col("a_") - F.col("b_")) / F.col("c_")))).otherwise(0.1)
    return sums.select(((1 - rho) / rho).alias("strength_"))


def _posterior(groups: DataFrame, prior: str, name: str) -> DataFrame:
    """Adds the strength of the level above (a scalar subquery) and the posterior mean."""
    return groups.withColumn("strength_", _strength(groups, prior).scalar()).withColumn(
        name, (F.col("k") + F.col("strength_") * F.col(prior)) / (F.col("n") + F.col("strength_")))


def reputations(pages: DataFrame, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """``host, n, k, mean, bound, blocked`` from rows of ``host`` and ``bad`` (0, 1 or null: not labelled)."""
    hosts = pages.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    hosts = hosts.withColumn("domain_", F.regexp_extract("host", r"([^.]*\.)?[^.]*\z", 0)).withColumn(
        "suffix_", F.regexp_extract("host", r"[^.]*\z", 0))

    def level(*keys):
        return hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))

    whole = hosts.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("whole_"))
    suffixes = _posterior(level("suffix_").withColumn("whole_", whole.scalar()), "whole_", "of_suffix_").select("suffix_", "of_suffix_")
    domains = _posterior(attach(level("domain_", "suffix_"), suffixes, ["suffix_"]), "of_suffix_", "of_domain_").select("domain_", "of_domain_")
    mine = _posterior(attach(hosts, domains, ["domain_"]), "of_domain_", "mean")
    total = F.col("n") + F.col("strength_")
    bound = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (total + 1))
    return mine.select("host", "n", "k", "mean", bound.alias("bound"), (bound > limit).alias("blocked"))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], page_col: str = "page_id", url_col: str = "url",
    outcome_id: str = "page_id", bad_col: str = "bad", limit: float = LIMIT, z: float = Z,
) -> DataFrame:
    """``page, host, path, rule, verdict, bound`` of every page. ``outcomes`` has a page id and 1 for a bad page, else 0."""
    host, path = parts(F.col(url_col))
    slim = pages.select(F.col(page_col).alias(page_col), host.alias("host"), path.alias("path"))
    bad = outcomes.where(F.col(outcome_id).isNotNull() & F.col(bad_col).isNotNull()).groupBy(
        F.col(outcome_id).alias("key_")).agg(F.max(F.col(bad_col).cast("int")).alias("bad"))
    labelled = slim.select(F.col(page_col).alias("key_"), "host").join(bad, "key_", "left").select("host", "bad")
    known = reputations(labelled, limit, z).select("host", "bound", "blocked")
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    return attach(slim, known, ["host"]).select(
        page_col, "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"), "bound")
