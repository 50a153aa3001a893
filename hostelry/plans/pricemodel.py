"""Estimating missing prices with the machine-learning library that ships with the engine."""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostelry.operators.distribution import dense_index
from hostelry.operators.quantiles import exact_quantiles
from hostelry.session import durable

#: Place of a level that the training rows do not have.
UNSEEN = 2.0**31 - 2
# Level of a missing category, level of all rare ones, rows a level needs.
MISSING_LEVEL, RARE_LEVEL, MIN_FREQUENCY = "?", "infrequent", 10


@dataclass(frozen=True)
class Table:
    """What a model reads: row id, target, numeric and categorical columns."""

    key: str
    target: str
    numeric: Sequence[str]
    categorical: Sequence[str]


@dataclass
class Fitted:
    """Levels learnt from the training rows and the fitted pipeline.

    Fitting runs jobs: one for the levels, one for the medians, those of the learner."""

    table: Table
    levels: DataFrame
    model: PipelineModel
    log_target: bool
    extra: dict = field(default_factory=dict)

    def predict(self, rows: DataFrame, out: str = "prediction") -> DataFrame:
        ready = _fold_levels(rows, self.table, self.levels)
        scored = self.model.transform(ready)
        value = F.expm1("prediction") if self.log_target else F.col("prediction")
        return scored.withColumn("__p", value).select(*rows.columns, F.col("__p").alias(out))

    def features(self, rows: DataFrame) -> DataFrame:
        """What the learner sees: the key, ``x_<number>`` imputed and scaled, ``l_<category>`` as shown, and ``coded``,
        how many places of the encoded categories are set."""
        scored = self.model.transform(_fold_levels(rows, self.table, self.levels))
        scaled = vector_to_array("__scaled")
        ones = F.aggregate(F.slice(vector_to_array("features"), len(self.table.numeric) + 1, 2**30), F.lit(0.0), lambda a, x: a + x)
        return scored.select(
            self.table.key, *[scaled[i].alias(f"x_{n}") for i, n in enumerate(self.table.numeric)],
            *[F.col(f"__s_{c}").alias(f"l_{c}") for c in self.table.categorical], ones.cast("int").alias("coded"))


class ExactMedian(Estimator):
    """Fills missing numbers with the exact median of the column (0 if it has no number)."""

    def __init__(self, inputs: Sequence[str], outputs: Sequence[str]):
        super().__init__()
        self.inputs, self.outputs = list(inputs), list(outputs)

    def _fit(self, dataset: DataFrame) -> Model:
        long = dataset.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in self.inputs])))
        found = {r["c"]: r["m"] for r in exact_quantiles(long, ["c"], "v", {"m": 0.5}).collect()}  # one row per column
        return FilledByMedian(self.inputs, self.outputs, found)


class FilledByMedian(Model):
    def __init__(self, inputs: Sequence[str], outputs: Sequence[str], medians: dict[str, float]):
        super().__init__()
        self.inputs, self.outputs, self.medians = inputs, outputs, medians

    def _transform(self, dataset: DataFrame) -> DataFrame:
        known = {o: F.when(~F.isnan(i), F.col(i)) for i, o in zip(self.inputs, self.outputs)}
        return dataset.withColumns({
            o: F.coalesce(known[o], F.lit(float(self.medians.get(i, 0.0)))) for i, o in zip(self.inputs, self.outputs)})


def fold(key: Column, k: int, seed: int) -> Column:
    """Fold number by a hash of the row id, the same on every run and in any engine."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 8)
    return (F.conv(digits, 16, 10).cast("long") % k).cast("int")


def _learn_levels(rows: DataFrame, table: Table) -> DataFrame:
    """Levels of every categorical column with what is shown for them and its place, most frequent first.

    The table has a row per level and stays distributed; only the number of places comes to the driver.
    """
    if not table.categorical:
        return rows.sparkSession.createDataFrame([], "c string, level string, shown string, place double")
    long = rows.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LEVEL)).alias("level"))
        for c in table.categorical])).alias("x")).select("x.*")
    counts = long.groupBy("c", "level").agg(F.count(F.lit(1)).alias("n"))
    shown = counts.select("c", "level", "n", F.when(F.col("n") >= MIN_FREQUENCY, F.col("level")).otherwise(RARE_LEVEL).alias("shown"))
    each = shown.groupBy("c", "shown").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("n"), "shown")) - 1
    return durable(shown.drop("n").join(each.select("c", "shown", place.cast("double").alias("place")), ["c", "shown"]))


def _fold_levels(rows: DataFrame, table: Table, levels: DataFrame) -> DataFrame:
    """Rare levels become one; a level the training never saw has a place that encodes as zeros."""
    out = rows
    for c in table.categorical:
        mine = levels.filter(F.col("c") == c).select(F.col("level").alias(f"__l_{c}"), F.col("shown").alias(f"__s_{c}"), F.col("place").alias(f"__i_{c}"))
        out = out.join(mine, F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LEVEL)) == F.col(f"__l_{c}"), "left").drop(f"__l_{c}").withColumn(
            f"__i_{c}", F.coalesce(f"__i_{c}", F.lit(UNSEEN)))
    return out.withColumns({f"__n_{n}": F.col(n).cast("double") for n in table.numeric})


def _stages(table: Table, learner: Estimator) -> list:
    numbers = [f"__n_{n}" for n in table.numeric]
    filled = [f"__f_{n}" for n in table.numeric]
    placed, coded = [f"__i_{c}" for c in table.categorical], [f"__o_{c}" for c in table.categorical]
    encoder = [OneHotEncoder(inputCols=placed, outputCols=coded, handleInvalid="keep")] if placed else []
    return [
        ExactMedian(numbers, filled),
        VectorAssembler(inputCols=filled, outputCol="__numbers"),
        StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=True),
        *encoder,
        VectorAssembler(inputCols=["__scaled", *coded], outputCol="features"),
        learner,
    ]


def fit(rows: DataFrame, table: Table, learner: Estimator, log_target: bool = True) -> Fitted:
    """Impute, scale, encode and learn; the target goes through ``log1p`` when asked."""
    train = rows.filter(F.col(table.target).isNotNull())
    levels = _learn_levels(train, table)
    label = F.log1p(table.target) if log_target else F.col(table.target).cast("double")
    ready = _fold_levels(train, table, levels).withColumn("label", label)
    return Fitted(table, levels, Pipeline(stages=_stages(table, learner)).fit(ready), log_target)


def mae(scored: DataFrame, target: str, by: Sequence[str] = (), prediction: str = "prediction") -> DataFrame:
    return scored.groupBy(*by).agg(F.avg(F.abs(F.col(prediction) - F.col(target))).alias("mae"), F.count(F.lit(1)).alias("rows"))


def baseline(rows: DataFrame, target: str) -> DataFrame:
    """Error of always predicting the median."""
    middle = exact_quantiles(rows, [], target, {"m": 0.5}).scalar()
    known = rows.filter(F.col(target).isNotNull())
    return known.agg(F.avg(F.abs(F.col(target) - middle)).alias("mae")).withColumn("median", middle)


def _penalty(learner: Estimator) -> float | None:
    """Penalty of a linear regression that sums over the rows solve exactly (``plans/ridge``); nothing for any other learner."""
    if type(learner) is not LinearRegression or learner.isSet("weightCol"):
        return None
    wanted = {"elasticNetParam": 0.0, "fitIntercept": True, "standardization": True, "loss": "squaredError", "featuresCol": "features", "labelCol": "label"}
    return learner.getRegParam() if all(learner.getOrDefault(k) == v for k, v in wanted.items()) else None


def _from_sums(rows: DataFrame, table: Table, penalty: float, k: int, seeds: Sequence[int], segment: str | None = None) -> DataFrame:
    """All folds of all splits (``scope``, ``seed``, ``fold``) from one pass of sums, with ``prediction``."""
    from hostelry.plans import ridge

    scored = ridge.out_of_fold(rows, table, [penalty], k, seeds, segment)
    return scored.withColumn("prediction", F.col("predictions")[0]).drop("predictions")


def out_of_fold(rows: DataFrame, table: Table, learner: Estimator, k: int = 5, seed: int = 42, log_target: bool = True) -> DataFrame:
    """Every known row with a prediction from a model that did not see it, and its fold."""
    penalty = _penalty(learner) if log_target else None
    if penalty is not None:
        return _from_sums(rows, table, penalty, k, (seed,)).drop("scope", "seed")
    known = durable(rows.filter(F.col(table.target).isNotNull()).withColumn("fold", fold(F.col(table.key), k, seed)))
    parts = None
    for f in range(k):
        held = fit(known.filter(F.col("fold") != f), table, learner, log_target).predict(known.filter(F.col("fold") == f))
        parts = held if parts is None else parts.unionByName(held)
    return parts


def cross_validated(rows: DataFrame, table: Table, learner: Estimator, k: int = 5, seed: int = 42) -> DataFrame:
    """Error per fold."""
    return mae(out_of_fold(rows, table, learner, k, seed), table.target, ["fold"])


def repeated(rows: DataFrame, table: Table, learner: Estimator, k: int = 5, seeds: Sequence[int] = (0, 1, 2, 3, 4)) -> DataFrame:
    """Mean, spread, worst and best fold error over several splits."""
    penalty = _penalty(learner)
    if penalty is not None:
        parts = mae(_from_sums(rows, table, penalty, k, seeds), table.target, ["seed", "fold"])
    else:
        parts = None
        for s in seeds:
            one = cross_validated(rows, table, learner, k, s).withColumn("seed", F.lit(s))
            parts = one if parts is None else parts.unionByName(one)
    return parts.agg(F.avg("mae").alias("mean"), F.stddev_pop("mae").alias("spread"), F.max("mae").alias("worst"),
                     F.min("mae").alias("best"), F.count(F.lit(1)).alias("folds"))


class NaturalError(Evaluator):
    """Mean absolute error in the target's own units for a model of its logarithm."""

    def _evaluate(self, dataset: DataFrame) -> float:
        gap = F.abs(F.expm1("prediction") - F.expm1("label"))
        return dataset.agg(F.avg(gap).alias("e")).first()["e"]

    def isLargerBetter(self) -> bool:
        return False


def learners() -> dict[str, tuple[Estimator, dict[str, Sequence]]]:
    """Learners with the grids that random search draws from. The two boosted ones of the original
    catalogue are one here, as the library has one; its deepest tree, 30, stands for no limit."""
    forest, boosted, line = RandomForestRegressor(seed=42), GBTRegressor(seed=42), LinearRegression(elasticNetParam=0.0)
    return {
        "ridge": (line, {"regParam": [0.001, 0.01, 0.1, 1.0]}),
        "forest": (forest, {
            "numTrees": [300, 600], "maxDepth": [12, 20, 30],
            "minInstancesPerNode": [1, 2, 4, 8], "featureSubsetStrategy": ["sqrt", "0.3", "0.6"]}),
        "boosted": (boosted, {
            "stepSize": [0.03, 0.06, 0.1], "maxIter": [300, 600],
            "maxDepth": [4, 5, 6], "minInstancesPerNode": [10, 20, 40]}),
    }


def _errors_from_sums(known: DataFrame, table: Table, penalties: Sequence[float], k: int, seed: int) -> list[float]:
    """Mean fold error of every penalty."""
    from hostelry.plans import ridge

    each = ridge.out_of_fold(known, table, penalties, k, (seed,)).select(table.target, "fold", F.posexplode("predictions").alias("i", "prediction"))
    found = mae(each, table.target, ["i", "fold"]).groupBy("i").agg(F.avg("mae").alias("mae")).collect()
    return [m for _, m in sorted((r["i"], r["mae"]) for r in found)]


def search(rows: DataFrame, table: Table, catalogue, draws: int = 20, k: int = 5, seed: int = 42, parallelism: int = 4):
    """Best cross-validated error per learner over random draws from its grid. Returns the report
    rows ``(learner, mae, params)`` best first, and the winning estimator."""
    train = rows.filter(F.col(table.target).isNotNull())
    ready, report = None, []
    for name, (learner, grid) in catalogue.items():
        builder = ParamGridBuilder()
        for param, values in grid.items():
            builder = builder.addGrid(getattr(learner, param), list(values))
        maps = builder.build()
        picked = random.Random(seed).sample(maps, min(draws, len(maps)))
        penalties = [_penalty(learner.copy(p)) for p in picked]
        if not table.categorical and None not in penalties:  # with categories the levels are those of all known rows, not of each training set
            errors = _errors_from_sums(train, table, penalties, k, seed)
        else:
            if ready is None:
                levels = _learn_levels(train, table)
                ready = durable(_fold_levels(train, table, levels).withColumns({
                    "label": F.log1p(table.target), "fold": fold(F.col(table.key), k, seed)}))
            cv = CrossValidator(
                estimator=Pipeline(stages=_stages(table, learner)), estimatorParamMaps=picked, evaluator=NaturalError(),
                numFolds=k, foldCol="fold", parallelism=parallelism)
            errors = cv.fit(ready).avgMetrics
        best = min(range(len(errors)), key=errors.__getitem__)
        params = {p.name: v for p, v in picked[best].items()}
        report.append((name, float(errors[best]), str(params), learner.copy(picked[best])))
    report.sort(key=lambda r: r[1])
    return report


def importance(rows: DataFrame, fitted: Fitted, blocks: dict[str, Sequence[str]], repeats: int = 10, seed: int = 42) -> DataFrame:
    """Error lost when a block of columns is shuffled together, mean over repeats; a block of one column
    gives that column's own. ``rows`` must be rows that the model was not fitted to (see ``split``).

    Shuffled rows are drawn by a second numbering of the same rows, by a hash per repeat; both numberings are distributed
    and meet once, and every block is scored on the rows of that one join.
    """
    table = fitted.table
    reads = list(dict.fromkeys([*table.numeric, *table.categorical]))
    moved = list(dict.fromkeys(c for columns in blocks.values() for c in columns))
    known = durable(rows.filter(F.col(table.target).isNotNull()))
    n = known.count()
    kept = dict.fromkeys([table.target, *reads, *moved])
    base = dense_index(known.select(*[F.col(c).alias(f"__b_{c}") for c in kept], F.col(table.key).alias("__o")), [F.col("__o")], "__pos", only_order=["__o"])
    order = F.unhex(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("__r").cast("string"), F.col(table.key).cast("string"))))
    mixed = known.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).select(
        "__r", order.alias("__o"), *[F.col(c).alias(f"__x_{c}") for c in moved])
    mixed = dense_index(mixed, [F.col("__r"), F.col("__o")], "__g", only_order=["__o"]).withColumn("__pos", F.col("__g") - F.col("__r") * n).drop("__g")
    variants = F.inline(F.array(*[
        F.struct(F.lit(name).alias("__block"), *[F.col(f"__x_{c}" if c in columns else f"__b_{c}").alias(c) for c in kept])
        for name, columns in blocks.items()]))
    shuffled = base.join(mixed, "__pos").select("__r", variants)
    errors = mae(fitted.predict(shuffled), table.target, ["__block", "__r"]).groupBy("__block").agg(F.avg("mae").alias("mae"))
    reference = mae(fitted.predict(known), table.target).select(F.col("mae").alias("reference"))
    listed = rows.sparkSession.createDataFrame([(name, len(columns)) for name, columns in blocks.items()], "block string, columns int")
    lines = listed.join(errors, F.col("block") == F.col("__block"), "left")
    return lines.select("block", "columns", "mae", (F.col("mae") - reference.scalar()).alias("lost"))


def split(rows: DataFrame, key: str, held: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows to fit on, and one part in ``held`` to measure on."""
    part = fold(F.col(key), held, seed)
    return rows.filter(part != 0), rows.filter(part == 0)


def one_or_many(rows: DataFrame, table: Table, learner: Estimator, segment: str, values: Sequence, k: int = 5, seed: int = 42) -> DataFrame:
    """Error by segment of one model and of one per segment, on the same folds."""
    penalty = _penalty(learner)
    if penalty is not None:
        gap = F.abs(F.col("prediction") - F.col(table.target))
        scored = _from_sums(rows, table, penalty, k, (seed,), segment).where(F.col(segment).isin(list(values)))
        return scored.groupBy(segment).agg(
            F.avg(F.when(F.col("scope") == "", gap)).alias("one_model"), F.count(F.when(F.col("scope") == "", 1)).alias("rows"),
            F.avg(F.when(F.col("scope") != "", gap)).alias("own_model"))
    whole = mae(out_of_fold(rows, table, learner, k, seed), table.target, [segment]).select(segment, F.col("mae").alias("one_model"), "rows")
    parts = None
    for v in values:
        own = mae(out_of_fold(rows.filter(F.col(segment) == v), table, learner, k, seed), table.target, [segment])
        parts = own if parts is None else parts.unionByName(own)
    return whole.join(parts.select(segment, F.col("mae").alias("own_model")), segment)


def fill_missing(rows: DataFrame, fitted: Fitted, error: float, out: str = "final") -> DataFrame:
    """Predicts rows without a target, flags them, and carries the model's error beside the value."""
    target = fitted.table.target
    known = rows.filter(F.col(target).isNotNull()).withColumn("prediction", F.lit(None).cast("double"))
    guessed = fitted.predict(rows.filter(F.col(target).isNull())).withColumn("prediction", F.round("prediction", 2))
    both = known.unionByName(guessed)
    return both.withColumns({
        "estimated": F.col(target).isNull(), out: F.coalesce(F.col(target).cast("double"), F.col("prediction")),
        "model_mae": F.lit(round(error, 2))})


def estimate(
    rows: DataFrame, table: Table, catalogue, draws: int = 20, k: int = 5, seeds: Sequence[int] = (0, 1, 2, 3, 4), seed: int = 42,
) -> DataFrame:
    """Search, repeated cross-validation of the winner, and the missing prices filled by it, as one job.

    The error beside the values is the winner's mean over all folds of all splits."""
    rows = durable(rows)
    winner = search(rows, table, catalogue, draws, k, seed)[0][3]
    error = repeated(rows, table, winner, k, seeds).first()["mean"]
    return fill_missing(rows, fit(rows, table, winner), error)


def impute_by_host(rows: DataFrame, evidence: DataFrame, row_id: str, host: str, area: str, capacity: str, price: str) -> DataFrame:
    """Mean price of the host's rows with the same area and capacity, only where its nearest priced
    row is far. ``evidence`` has the row id and ``far``."""
    means = rows.filter(F.col(price).isNotNull()).groupBy(host, area, capacity).agg(F.avg(price).alias("__mean"))
    far = evidence.filter(F.col("far")).select(F.col(row_id).alias("__far"))
    from hostelry.operators.distribution import spread_join

    open_rows = rows.filter(F.col(price).isNull()).join(far, F.col(row_id) == F.col("__far"), "left")
    known = F.col("__far").isNotNull() & F.col(capacity).isNotNull()
    filled = spread_join(open_rows, means, [host, area, capacity], how="left").withColumn(
        "imputed", F.when(known, F.col("__mean"))).drop("__mean", "__far")
    return filled.withColumn(price, F.coalesce(F.col(price), F.col("imputed")))
