"""Ridge regression of a log price over numbers and categories, for many folds, repeats and penalties at once.

One pass sums the cross-products of all columns per scope, repeat and fold. The sums of a training set are those of its
folds, so every fold, repeat and penalty is solved exactly without another pass over the rows, and a singular design
(indicators of one column add up to one) costs nothing: without a penalty the shortest solution is taken.

What differs between training sets is put in after the sums. A missing number is kept as a zero and a flag, and the
median of the training set enters as a multiple of the flag. A category keeps one sum per level that can ever be common,
and one for all others; which levels of a training set are common, rare or absent follows from its counts.

Columns are scaled by the training set's deviations (``1/n``) and the penalty is divided by that of the target, as the
engine's own linear regression does. A prediction is the inverse of ``log1p``.

Sums, solutions and medians have a size given by the columns, ``MAX_PLACES`` and the number of folds, not by the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostelry.operators.distribution import spread_join
from hostelry.operators.quantiles import exact_quantiles
from hostelry.plans.pricemodel import MIN_FREQUENCY, MISSING_LEVEL, Table, fold
from hostelry.session import discard, durable

#: Largest number of columns after encoding; the solution of one training set is a matrix of that side in one task.
MAX_PLACES = 4096
#: Fold number of the training set that leaves nothing out.
ALL = -1
_KEYS = ["scope", "seed", "fold"]
#: Rows of levels or solutions that are sent to every task; a larger table is joined by a shuffle.
MAX_SENT = 100_000


def with_folds(rows: DataFrame, table: Table, k: int, seeds: Sequence[int]) -> DataFrame:
    """Every row with its fold in each repeat, so that one written row stands for all repeats."""
    return rows.withColumn("__folds", F.array(*[F.struct(F.lit(s).alias("seed"), fold(F.col(table.key), k, s).alias("fold")) for s in seeds]))


def split_folds(rows: DataFrame, segment: str | None = None) -> DataFrame:
    """Every row of ``with_folds`` once per repeat (``seed``, ``fold``) and scope: ``""`` for the model of all rows and, where
    ``segment`` names a column, the row's own value for the model of its segment."""
    scopes = [F.lit("")] + ([F.col(segment).cast("string")] if segment else [])
    return rows.select("*", F.explode(F.array(*scopes)).alias("scope")).where("scope is not null").select(
        "*", F.inline("__folds")).drop("__folds")


def split_rows(rows: DataFrame, table: Table, k: int, seeds: Sequence[int], segment: str | None = None) -> DataFrame:
    """``split_folds`` of rows that have no folds yet."""
    return split_folds(with_folds(rows, table, k, seeds), segment)


def _meet(rows: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join with a written table, which is sent to every task unless it is large; nulls match nulls."""
    if side.count() > MAX_SENT:
        return spread_join(rows, side, keys, how="left")
    few = side.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return rows.join(F.broadcast(few), on, "left").drop(*[f"__r_{k}" for k in keys])


def _terms(table: Table) -> list[str]:
    """Names of the plain terms: one, each number, each missing flag, the target."""
    return ["__one", *[f"__v{i}" for i in range(len(table.numeric))], *[f"__u{i}" for i in range(len(table.numeric))], "__y"]


def _with_terms(rows: DataFrame, table: Table) -> DataFrame:
    out = {"__one": F.lit(1.0), "__y": F.log1p(F.col(table.target).cast("double"))}
    for i, n in enumerate(table.numeric):
        number = F.col(n).cast("double")
        known = number.isNotNull() & ~F.isnan(number)
        out[f"__v{i}"] = F.when(known, number).otherwise(0.0)
        out[f"__u{i}"] = F.when(known, 0.0).otherwise(1.0)
    for i, c in enumerate(table.categorical):
        out[f"__s{i}"] = F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LEVEL))
    return rows.withColumns(out)


def _levels(ready: DataFrame, table: Table) -> DataFrame:
    """``scope, seed, fold, c, level, n, total``: rows of each level in each fold, and in all."""
    listed = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"__s{i}").alias("level")) for i in range(len(table.categorical))])).alias("x")
    counts = ready.select(*_KEYS, listed).groupBy(*_KEYS, "x.c", "x.level").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("scope", "seed", "c", "level").agg(F.sum("n").alias("total"))
    return spread_join(counts, totals, ["scope", "seed", "c", "level"])


def _cross_products(ready: DataFrame, table: Table, levels: DataFrame | None) -> DataFrame:
    """``scope, seed, fold, a, b, s``: sums of products of terms; a level is ``<column>|<level>``, the rare ones are ``<column>``."""
    known = None if levels is None else levels.where(F.col("total") >= MIN_FREQUENCY).select("scope", "seed", "c", "level").distinct()
    for i in range(len(table.categorical)):
        mine = known.where(F.col("c") == i).select("scope", "seed", F.col("level").alias(f"__s{i}"), F.concat(F.lit(f"{i}|"), "level").alias(f"__p{i}"))
        ready = _meet(ready, mine, ["scope", "seed", f"__s{i}"]).withColumn(f"__p{i}", F.coalesce(f"__p{i}", F.lit(str(i))))
    places = [f"__p{i}" for i in range(len(table.categorical))]
    terms = _terms(table)
    slim = ready.select(*_KEYS, *terms, *places)

    def long(grouped: DataFrame, a, sums: Sequence[tuple]) -> DataFrame:
        return grouped.select(*_KEYS, F.inline(F.array(*[F.struct(a(x).alias("a"), F.lit(y).alias("b"), F.col(f"{x}{y}").alias("s")) for x, y in sums])))

    both = [(x, y) for i, x in enumerate(terms) for y in terms[i:]]
    plain = long(slim.groupBy(*_KEYS).agg(*[F.sum(F.col(x) * F.col(y)).alias(x + y) for x, y in both]), F.lit, both)
    if not places:
        return plain
    one = slim.select(*_KEYS, *terms, F.explode(F.array(*places)).alias("p")).groupBy(*_KEYS, "p").agg(*[F.sum(t).alias(t) for t in terms])
    single = long(one, lambda x: F.col("p"), [("", t) for t in terms])
    out = plain.unionByName(single)
    if len(places) > 1:
        pairs = F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in combinations(places, 2)])).alias("x")
        out = out.unionByName(slim.select(*_KEYS, pairs).groupBy(*_KEYS, "x.a", "x.b").agg(F.count(F.lit(1)).cast("double").alias("s")))
    return out


def _medians(ready: DataFrame, table: Table, k: int) -> DataFrame | None:
    """``scope, seed, fold, i, median`` of the numbers that have gaps; ``fold`` is the one left out (or ``ALL``)."""
    gaps = ready.agg(*[F.max(f"__u{i}").alias(str(i)) for i in range(len(table.numeric))]).first()
    wanted = [i for i in range(len(table.numeric)) if gaps[str(i)]]
    if not wanted:
        return None
    listed = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.when(F.col(f"__u{i}") == 0, F.col(f"__v{i}")).alias("v")) for i in wanted])).alias("x")
    # equal numbers of a fold are counted before they are copied to the training sets it is in
    counts = durable(ready.select(*_KEYS, listed).select(*_KEYS, "x.*").where("v is not null").groupBy(*_KEYS, "i", "v").agg(F.count(F.lit(1)).alias("n")))
    out = counts.select("scope", "seed", "i", "v", "n", F.explode(_others(k)).alias("fold"))
    return exact_quantiles(out, [*_KEYS, "i"], "v", {"median": 0.5}, times=F.col("n"))


def _others(k: int):
    """Training sets that a row of a fold is in."""
    return F.filter(F.array(*[F.lit(f) for f in (ALL, *range(k))]), lambda f: f != F.col("fold"))


def _solve(table: Table, penalties: Sequence[float]):
    terms = _terms(table)
    numbers = len(table.numeric)

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        scope, seed, left_out = part[_KEYS].iloc[0]
        medians = np.zeros(numbers)
        given = part["a"] == "median"
        for i, m in zip(part["b"][given], part["s"][given]):
            medians[int(i)] = m
        part = part[~given]
        raw = [*terms, *sorted(set(part["a"]) - set(terms))]
        at = {name: i for i, name in enumerate(raw)}
        gram = np.zeros((len(raw), len(raw)))
        a, b = part["a"].map(at).to_numpy(), part["b"].map(at).to_numpy()
        gram[a, b] = gram[b, a] = part["s"].to_numpy()
        levels = range(len(terms), len(raw))
        gram[levels, levels] = gram[levels, 0]
        n = gram[0, 0]
        # from terms to columns: numbers with their median put in, common levels, and per category its rare ones
        columns, shown = np.zeros((numbers, len(raw))), {}
        for i in range(numbers):
            columns[i, 1 + i], columns[i, 1 + numbers + i] = 1, medians[i]
        for j in levels:
            c, bar, _ = raw[j].partition("|")
            if gram[j, 0] > 0:
                shown.setdefault(raw[j] if bar and gram[j, 0] >= MIN_FREQUENCY else c, []).append(j)
        for members in shown.values():
            columns = np.vstack([columns, np.isin(np.arange(len(raw)), members)])
        if len(columns) > MAX_PLACES:
            raise ValueError(f"{len(columns)} columns after encoding; at most {MAX_PLACES} are solved in closed form")
        target = terms.index("__y")
        mean = columns @ gram[0] / n
        cov = columns @ gram @ columns.T / n - np.outer(mean, mean)
        middle = gram[target, 0] / n
        with_target = columns @ gram[target] / n - mean * middle
        deviation = np.sqrt(max(gram[target, target] / n - middle**2, 0))
        spread = np.sqrt(np.maximum(np.diag(cov), 0))
        used = spread > 1e-9 * np.maximum(np.abs(mean), 1e-300)
        scale = np.where(used, spread, 1)
        system, right = (cov / np.outer(scale, scale))[np.ix_(used, used)], (with_target / scale)[used]
        value, vector = np.linalg.eigh(system) if used.any() else (np.zeros(0), np.zeros((0, 0)))
        inner = vector.T @ right
        slopes = np.zeros((len(penalties), len(columns)))
        for p, penalty in enumerate(penalties):
            if deviation > 0:
                shift = value + penalty / deviation
                slopes[p, used] = vector @ np.where(shift > 1e-10, inner / np.where(shift > 1e-10, shift, 1), 0)
        slopes /= scale
        start = middle - slopes @ mean
        rows = [(-1, "0", start.tolist())]
        rows += [(-1, str(1 + i), slopes[:, i].tolist()) for i in range(numbers)]
        rows += [(-1, str(1 + numbers + i), (slopes[:, i] * medians[i]).tolist()) for i in range(numbers)]
        for i, (name, members) in enumerate(shown.items()):
            # levels outside the sums share the place of rare ones, where the training set has any
            names = {raw[j] for j in members} | ({name} if "|" not in name else set())
            rows += [(int(name.partition("|")[0]), place, slopes[:, numbers + i].tolist()) for place in sorted(names)]
        return pd.DataFrame([(scope, seed, left_out, *r) for r in rows], columns=[*_KEYS, "c", "place", "slopes"])

    return solve


class Solutions:
    """Solved training sets of a job: ``plain`` (per training set, the slopes of the plain terms) and ``level`` (those of every level)."""

    def __init__(self, known: DataFrame, table: Table, penalties: Sequence[float], k: int):
        self.table, self.penalties, self.k = table, list(penalties), k
        ready = _with_terms(known, table)
        levels = durable(_levels(ready, table)) if table.categorical else None
        sums = _cross_products(ready, table, levels)
        train = sums.select("scope", "seed", "a", "b", "s", F.explode(_others(k)).alias("fold")).groupBy(*_KEYS, "a", "b").agg(F.sum("s").alias("s"))
        middle = _medians(ready, table, k)
        if middle is not None:
            train = train.unionByName(middle.select(*_KEYS, F.lit("median").alias("a"), F.col("i").cast("string").alias("b"), F.col("median").alias("s")))
        solved = durable(train.groupBy(*_KEYS).applyInPandas(
            _solve(table, penalties), "scope string, seed int, fold int, c int, place string, slopes array<double>"))
        self.plain = durable(solved.where("c = -1").groupBy(*_KEYS).agg(
            F.transform(F.sort_array(F.collect_list(F.struct(F.col("place").cast("int").alias("i"), "slopes"))), lambda x: x["slopes"]).alias("__plain")))
        self.level = None
        if levels is not None:
            # per training set, the rows of each level it has
            inside = levels.select("scope", "seed", "c", "level", "n", "total", F.explode(_others(k)).alias("fold")).groupBy(
                *_KEYS, "c", "level").agg(F.max("total").alias("total"))
            own = F.col("c").cast("string")
            name = F.when(F.col("total") >= MIN_FREQUENCY, F.concat(own, F.lit("|"), "level")).otherwise(own)
            slopes = solved.where("c >= 0").drop("c")
            self.level = durable(spread_join(inside.withColumn("place", name), slopes, [*_KEYS, "place"]).select(*_KEYS, "c", "level", "slopes"))
        discard(levels)

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds ``predictions`` (one per penalty) to rows with ``scope``, ``seed`` and ``fold``: by the training set that left the fold out."""
        table, terms = self.table, _terms(self.table)[:-1]
        out = _meet(_with_terms(rows, table), self.plain, _KEYS)
        for i in range(len(table.categorical)):
            mine = self.level.where(F.col("c") == i).select(*_KEYS, F.col("level").alias(f"__s{i}"), F.col("slopes").alias(f"__b{i}"))
            out = _meet(out, mine, [*_KEYS, f"__s{i}"])

        def value(p):
            parts = [F.col(t) * F.col("__plain")[j][p] for j, t in enumerate(terms)]
            parts += [F.coalesce(F.col(f"__b{i}")[p], F.lit(0.0)) for i in range(len(table.categorical))]
            return F.expm1(reduce(lambda x, y: x + y, parts))

        return out.withColumn("predictions", F.array(*[value(p) for p in range(len(self.penalties))])).select(*rows.columns, "predictions")


def out_of_fold(
    rows: DataFrame, table: Table, penalties: Sequence[float], k: int = 5, seeds: Sequence[int] = (42,), segment: str | None = None,
) -> DataFrame:
    """Known rows with ``scope``, ``seed``, ``fold`` and, per penalty, ``predictions`` of a model that did not see the fold."""
    known = split_folds(durable(with_folds(rows.where(F.col(table.target).isNotNull()), table, k, seeds)), segment)
    return Solutions(known, table, penalties, k).predict(known)


def fill(rows: DataFrame, table: Table, penalty: float) -> DataFrame:
    """Rows without a target with ``prediction`` of the model of all known rows."""
    every = rows.withColumns({"scope": F.lit(""), "seed": F.lit(0), "fold": F.lit(ALL)})
    model = Solutions(durable(every.where(F.col(table.target).isNotNull()).withColumn("fold", F.lit(0))), table, [penalty], 1)
    open_ = every.where(F.col(table.target).isNull())
    return model.predict(open_).withColumn("prediction", F.col("predictions")[0]).drop("scope", "seed", "fold", "predictions")
