"""Price models over order lines, and imputation."""

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from hostelry.operators import spatial
from hostelry.operators.aggregates import error_report
from hostelry.plans import pricemodel as pm
from hostelry.plans import pricesearch as ps
from hostelry.registry.core import query
from hostelry.registry.fixtures import read
from hostelry.registry.spatial_queries import metres, points
from hostelry.session import durable

c = F.col
TABLE = pm.Table("id", "price", ["quantity", "discount", "tax", "size", "retail"], ["flag", "kind", "brand", "segment"])


# One number and plain least squares: SQL can say the same in closed form. These twins check the plans; the whole jobs,
# over all columns of TABLE, are the ``_full`` queries beside them.
ONE = pm.Table("id", "price", ["quantity"], [])


def least_squares():
    return LinearRegression(regParam=0.0, solver="normal")


def each_learner(run):
    """``run`` of every learner with one setting, with its name; a learner's rows are written before the next one's plan."""
    parts = None
    for name, spec in ps.DEFAULTS.items():
        part = durable(run(spec).withColumn("learner", F.lit(name)))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def fold_errors(scored):
    return pm.mae(scored, "price", ["seed", "fold"])


def of_folds(errors):
    return errors.agg(F.avg("mae").alias("mean"), F.stddev_pop("mae").alias("spread"), F.max("mae").alias("worst"),
                      F.min("mae").alias("best"), F.count(F.lit(1)).alias("folds"))


#: Penalty of the ridge queries that have SQL.
PENALTY = 0.1


def cut_errors(scored):
    """Error by segment, flag and kind."""
    parts = [error_report(scored, cut, "price", "prediction").withColumnRenamed(cut, "label").withColumn("cut", F.lit(cut))
             for cut in ("segment", "flag", "kind")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def lines(spark, folder):
    """Order lines with part and customer columns; one part of the numbers and prices is missing."""
    rows = read(spark, folder, "lineitem").join(read(spark, folder, "part"), c("l_partkey") == c("p_partkey")).join(
        read(spark, folder, "orders").select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey")).join(
        read(spark, folder, "customer").select("c_custkey", "c_mktsegment"), c("o_custkey") == c("c_custkey"))
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("id"),
        F.when(c("l_orderkey") % 20 != 7, c("l_extendedprice")).alias("price"),
        F.when(c("l_partkey") % 20 != 3, c("l_quantity")).alias("quantity"), c("l_discount").alias("discount"), c("l_tax").alias("tax"),
        c("p_size").alias("size"), c("p_retailprice").alias("retail"), c("l_returnflag").alias("flag"),
        c("p_type").alias("kind"), F.when(c("l_partkey") % 20 != 5, c("p_brand")).alias("brand"), c("c_mktsegment").alias("segment"))


LINES_SQL = """lines AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS id, case when l_orderkey % 20 <> 7 then l_extendedprice end AS price,
 case when l_partkey % 20 <> 3 then l_quantity end AS quantity, l_discount AS discount, l_tax AS tax, p_size AS size, p_retailprice AS retail, l_returnflag AS flag,
 p_type AS kind, case when l_partkey % 20 <> 5 then p_brand end AS brand, c_mktsegment AS segment
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def fold_sql(seed, k=5):
    return f"(('0x' || substr(md5(concat({seed}, '|', id)), 1, 8))::BIGINT % {k})"


#: Out-of-fold predictions ``p`` of every known row for each seed; ``rows_`` is the table they come from.
def folds_sql(seeds, rows="lines", name="oof"):
    listed = ", ".join(map(str, seeds))
    return f"""{name}_k AS (SELECT l.*, s.seed, {fold_sql('s.seed')} AS fold FROM {rows} l, (SELECT unnest([{listed}]) AS seed) s WHERE price IS NOT NULL),
{name}_f AS (SELECT unnest([0, 1, 2, 3, 4]) AS f),
{name}_m AS (SELECT seed, f, median(quantity) AS med FROM {name}_k JOIN {name}_f ON fold <> f GROUP BY 1, 2),
{name}_fit AS (SELECT k.seed, f, any_value(med) AS med, regr_slope(ln(1 + price), coalesce(quantity, med)) AS slope, regr_intercept(ln(1 + price), coalesce(quantity, med)) AS start
 FROM {name}_k k JOIN {name}_m m ON k.seed = m.seed AND fold <> f GROUP BY 1, 2),
{name} AS (SELECT k.*, exp(start + slope * coalesce(quantity, med)) - 1 AS p FROM {name}_k k JOIN {name}_fit t ON k.seed = t.seed AND fold = f)"""


def _numbers_sql():
    return ", ".join(
        f"round((coalesce({n}, (SELECT median({n}) FROM k)) - (SELECT avg(coalesce({n}, (SELECT median({n}) FROM k))) FROM k))"
        f" / (SELECT stddev_samp(coalesce({n}, (SELECT median({n}) FROM k))) FROM k), 6) AS x_{n}" for n in TABLE.numeric)


def _levels_sql():
    return ", ".join(
        f"(SELECT any_value(case when n >= 10 then v else 'infrequent' end) FROM (SELECT coalesce({x}, '?') AS v, count(*) AS n FROM k GROUP BY 1) z"
        f" WHERE z.v = coalesce(lines.{x}, '?')) AS l_{x}" for x in TABLE.categorical)


@query("ml01_fitted_features", "ML-01 ML-10", f"""
WITH {LINES_SQL}, k AS (SELECT * FROM lines WHERE price IS NOT NULL), f AS (SELECT id, {_numbers_sql()}, {_levels_sql()} FROM lines)
SELECT *, (l_flag IS NOT NULL)::INT + (l_kind IS NOT NULL)::INT + (l_brand IS NOT NULL)::INT + (l_segment IS NOT NULL)::INT AS coded FROM f""")
def fitted_features(spark, folder):
    rows = durable(lines(spark, folder))
    seen = pm.fit(rows, TABLE, least_squares()).features(rows)
    return seen.select("id", *[F.round(f"x_{n}", 6).alias(f"x_{n}") for n in TABLE.numeric], *[f"l_{x}" for x in TABLE.categorical], "coded")


@query("ml02_median_baseline", "ML-02", """
WITH p AS (SELECT case when l_orderkey % 20 <> 7 then l_extendedprice end AS price FROM lineitem) SELECT round((SELECT median(price) FROM p), 3) AS median, round(avg(abs(price - (SELECT median(price) FROM p))), 4) AS mae FROM p""")
def median_baseline(spark, folder):
    rows = read(spark, folder, "lineitem").select(F.when(c("l_orderkey") % 20 != 7, c("l_extendedprice")).alias("price"))
    return pm.baseline(rows, "price").select(F.round("median", 3).alias("median"), F.round("mae", 4).alias("mae"))


@query("ml03_cross_validation", "ML-03", f"""
WITH {LINES_SQL}, {folds_sql([42])} SELECT fold::INT AS fold, round(avg(abs(p - price)), 3) AS mae, count(*) AS rows FROM oof GROUP BY 1""")
def cross_validation(spark, folder):
    return pm.cross_validated(lines(spark, folder), ONE, least_squares()).select("fold", F.round("mae", 3).alias("mae"), "rows")


@query("ml03_full_cross_validation", "ML-03")
def full_cross_validation(spark, folder):
    rows = durable(lines(spark, folder))
    return each_learner(lambda spec: fold_errors(ps.out_of_fold(rows, TABLE, spec)).drop("seed"))


@query("ml04_model_search", "ML-04", f"""
WITH {LINES_SQL}, {folds_sql([42])}, g AS (SELECT unnest([0.001, 0.01, 0.1, 1.0])::DOUBLE AS reg),
t AS (SELECT reg, f, any_value(m.med) AS med, regr_slope(ln(1 + price), coalesce(quantity, m.med)) AS s0, avg(ln(1 + price)) AS ym, avg(coalesce(quantity, m.med)) AS xm,
 stddev_samp(ln(1 + price)) AS sd FROM oof_k k JOIN oof_m m ON fold <> f, g GROUP BY 1, 2),
e AS (SELECT reg, f, avg(abs(exp(ym + s0 / (1 + reg / sd) * (coalesce(quantity, med) - xm)) - 1 - price)) AS mae FROM oof_k JOIN t ON fold = f GROUP BY 1, 2)
SELECT 'ridge' AS learner, round(min(mae), 1) AS mae, arg_min(reg, mae) AS reg FROM (SELECT reg, avg(mae) AS mae FROM e GROUP BY 1)""")
def model_search(spark, folder):
    """The whole grid of the learner that has a closed form."""
    line, grid = pm.learners()["ridge"]
    report = pm.search(lines(spark, folder), ONE, {"ridge": (line, grid)})
    return spark.createDataFrame(
        [(n, round(e, 1), best.getRegParam()) for n, e, _, best in report], "learner string, mae double, reg double")


@query("ml04_full_model_search", "ML-04")
def full_model_search(spark, folder):
    """Every learner with 20 draws from its grid (ridge: all four settings), over all columns."""
    report = ps.search(durable(lines(spark, folder)), TABLE)
    return spark.createDataFrame([(n, e, str(p)) for n, e, p in report], "learner string, mae double, params string")


@query("ml05_repeated_cross_validation", "ML-05", f"""
WITH {LINES_SQL}, {folds_sql(range(5))}, e AS (SELECT seed, fold, avg(abs(p - price)) AS mae FROM oof GROUP BY 1, 2)
SELECT round(avg(mae), 3) AS mean, round(stddev_pop(mae), 3) AS spread, round(max(mae), 3) AS worst, round(min(mae), 3) AS best, count(*) AS folds FROM e""")
def repeated_cross_validation(spark, folder):
    return pm.repeated(lines(spark, folder), ONE, least_squares()).select(
        *[F.round(x, 3).alias(x) for x in ("mean", "spread", "worst", "best")], "folds")


@query("ml05_full_repeated_cross_validation", "ML-05")
def full_repeated_cross_validation(spark, folder):
    rows = durable(lines(spark, folder))
    return each_learner(lambda spec: of_folds(fold_errors(ps.out_of_fold(rows, TABLE, spec, seeds=range(5)))))


@query("ml06_out_of_fold", "ML-06 AG-30", f"""
WITH {LINES_SQL}, {folds_sql([42])}, u AS (SELECT 'segment' AS cut, segment AS label, price, p FROM oof UNION ALL SELECT 'flag', flag, price, p FROM oof UNION ALL SELECT 'kind', kind, price, p FROM oof)
SELECT cut, label, count(*) AS rows, round(avg(abs(p - price)), 3) AS mae, round(avg(p - price), 3) AS bias, round(median(price), 3) AS median_actual,
 round(avg(abs(p - price)) * 100 / median(price), 3) AS mape FROM u GROUP BY 1, 2""")
def out_of_fold(spark, folder):
    scored = durable(pm.out_of_fold(lines(spark, folder), ONE, least_squares()))
    return cut_errors(scored).select(
        "cut", "label", "rows", *[F.round(x, 3).alias(x) for x in ("mae", "bias", "median_actual", "mape")])


@query("ml06_full_out_of_fold", "ML-06 AG-30")
def full_out_of_fold(spark, folder):
    rows = durable(lines(spark, folder))
    return each_learner(lambda spec: cut_errors(durable(ps.out_of_fold(rows, TABLE, spec))))


@query("ml07_block_importance", "ML-07", f"""
WITH {LINES_SQL}, k AS (SELECT *, {fold_sql(42)} AS part FROM lines WHERE price IS NOT NULL),
t AS (SELECT (SELECT median(quantity) FROM k WHERE part <> 0) AS med, regr_slope(ln(1 + price), coalesce(quantity, (SELECT median(quantity) FROM k WHERE part <> 0))) AS slope,
 regr_intercept(ln(1 + price), coalesce(quantity, (SELECT median(quantity) FROM k WHERE part <> 0))) AS start FROM k WHERE part <> 0),
h AS (SELECT id, price, quantity, row_number() over (order by id) AS pos FROM k WHERE part = 0), r AS (SELECT unnest(range(10)) AS r),
m AS (SELECT r, quantity, row_number() over (partition by r order by md5(concat('42|', r, '|', id))) AS pos FROM h, r),
e0 AS (SELECT avg(abs(exp(start + slope * coalesce(quantity, med)) - 1 - price)) AS mae FROM h, t),
e1 AS (SELECT avg(mae) AS mae FROM (SELECT m.r, avg(abs(exp(start + slope * coalesce(m.quantity, med)) - 1 - price)) AS mae FROM h JOIN m USING (pos), t GROUP BY 1))
SELECT 'quantity' AS block, 1 AS columns, round(e1.mae, 2) AS mae, round(e1.mae - e0.mae, 2) AS lost FROM e0, e1
UNION ALL SELECT 'amount and part', 3, round(e1.mae, 2), round(e1.mae - e0.mae, 2) FROM e0, e1
UNION ALL SELECT 'size', 1, round(e0.mae, 2), 0.0 FROM e0""")
def block_importance(spark, folder):
    seen, held = pm.split(durable(lines(spark, folder)), "id")
    fitted = pm.fit(seen, ONE, least_squares())
    blocks = {"quantity": ["quantity"], "amount and part": ["quantity", "size", "kind"], "size": ["size"]}
    out = pm.importance(held, fitted, blocks)
    return out.select("block", "columns", F.round("mae", 2).alias("mae"), (F.round("lost", 2) + F.lit(0.0)).alias("lost"))


#: Columns shuffled together, then every column by itself.
BLOCKS = {"amount": ["quantity", "discount", "tax"], "part": ["size", "retail", "kind", "brand"], "order": ["flag", "segment"]} | {
    f"{name} alone": [name] for name in [*TABLE.numeric, *TABLE.categorical]}


@query("ml07_full_block_importance", "ML-07")
def full_block_importance(spark, folder):
    seen, held = pm.split(durable(lines(spark, folder)), "id")
    return each_learner(lambda spec: pm.importance(held, ps.fit(seen, TABLE, spec), BLOCKS))


@query("ml08_one_model_or_many", "ML-08", f"""
WITH {LINES_SQL}, a AS (SELECT * FROM lines WHERE flag = 'A'), n AS (SELECT * FROM lines WHERE flag = 'N'), r AS (SELECT * FROM lines WHERE flag = 'R'),
{folds_sql([42])}, {folds_sql([42], 'a', 'oa')}, {folds_sql([42], 'n', 'ona')}, {folds_sql([42], 'r', 'ora')},
many AS (SELECT flag, p, price FROM oa UNION ALL SELECT flag, p, price FROM ona UNION ALL SELECT flag, p, price FROM ora)
SELECT flag, round(avg(abs(p - price)), 3) AS one_model, count(*) AS rows, (SELECT round(avg(abs(p - price)), 3) FROM many WHERE many.flag = oof.flag) AS own_model FROM oof GROUP BY 1""")
def one_model_or_many(spark, folder):
    out = pm.one_or_many(lines(spark, folder), ONE, least_squares(), "flag", ["A", "N", "R"])
    return out.select("flag", F.round("one_model", 3).alias("one_model"), "rows", F.round("own_model", 3).alias("own_model"))


@query("ml08_full_one_model_or_many", "ML-08")
def full_one_model_or_many(spark, folder):
    rows = durable(lines(spark, folder))
    return each_learner(lambda spec: ps.one_or_many(rows, TABLE, spec, "flag"))


@query("ml09_filled_prices", "ML-09", f"""
WITH {LINES_SQL}, {folds_sql(range(5))}, e AS (SELECT avg(mae) AS mae FROM (SELECT avg(abs(p - price)) AS mae FROM oof GROUP BY seed, fold)),
k AS (SELECT *, (SELECT median(quantity) FROM lines WHERE price IS NOT NULL) AS med FROM lines),
t AS (SELECT regr_slope(ln(1 + price), coalesce(quantity, med)) AS slope, regr_intercept(ln(1 + price), coalesce(quantity, med)) AS start FROM k WHERE price IS NOT NULL)
SELECT price IS NULL AS estimated, count(*) AS rows, count(coalesce(price, 0)) AS priced, round(avg(coalesce(price, exp(start + slope * coalesce(quantity, med)) - 1)), 1) AS mean_final,
 round(any_value(mae), 2) AS model_mae FROM k, t, e GROUP BY 1""")
def filled_prices(spark, folder):
    out = pm.estimate(lines(spark, folder), ONE, {"line": (least_squares(), {"regParam": [0.0]})})
    return out.groupBy("estimated").agg(
        F.count("*").alias("rows"), F.count("final").alias("priced"), F.round(F.avg("final"), 1).alias("mean_final"), F.max("model_mae").alias("model_mae"))


@query("ml09_full_filled_prices", "ML-09")
def full_filled_prices(spark, folder):
    """Filled by the winner of the whole search, one row per order line."""
    out = ps.estimate(durable(lines(spark, folder)), TABLE)
    return out.select("id", "price", "estimated", "final", "model_mae")


# Ridge over all nine columns, against normal equations in SQL: the columns of every training set are built row by row, and
# its system is solved by conjugate gradients.

_SET = "scope, seed, f"


def ridge_sql(known, penalties=(PENALTY,), folds=range(5), name="rg"):
    """CTEs up to ``<name>``: the rows of ``known`` (scope, seed, fold, and the columns of ``lines``) in fold ``f``, per penalty ``pen``,
    with the prediction ``p`` by the rows outside it. Ids may repeat, so rows are numbered."""
    n = name
    numbers = " UNION ALL ".join(
        f"SELECT {_SET}, rid, fold = f AS held, '{x}' AS place, coalesce({x}, m_{x})::DOUBLE AS v FROM {n}_e JOIN {n}_med USING ({_SET})" for x in TABLE.numeric)
    cats = " UNION ALL ".join(f"SELECT {_SET}, rid, fold = f AS held, '{x}' AS c, coalesce({x}, '?') AS level FROM {n}_e" for x in TABLE.categorical)
    add = "list_transform(list_zip({0}, {1}), lambda z: z[1] + {2} * z[2])"
    return f"""{n}_e AS MATERIALIZED (SELECT k.*, f FROM (SELECT *, row_number() OVER () AS rid FROM ({known})) k, (SELECT unnest([{", ".join(map(str, folds))}]) AS f)),
{n}_t AS (SELECT * FROM {n}_e WHERE fold <> f AND price IS NOT NULL),
{n}_y AS (SELECT {_SET}, count(*)::DOUBLE AS n, avg(ln(1 + price)) AS ym, stddev_pop(ln(1 + price)) AS sd FROM {n}_t GROUP BY ALL),
{n}_med AS (SELECT {_SET}, {", ".join(f"median({x}) AS m_{x}" for x in TABLE.numeric)} FROM {n}_t GROUP BY ALL),
{n}_c AS (SELECT * FROM ({cats})),
{n}_l AS (SELECT {_SET}, c, level, c || '|' || case when count(*) >= 10 then level else 'infrequent' end AS place FROM {n}_c
 JOIN (SELECT {_SET}, rid FROM {n}_t) USING ({_SET}, rid) GROUP BY {_SET}, c, level),
{n}_w AS (SELECT * FROM ({numbers}) UNION ALL SELECT {_SET}, rid, held, place, 1.0 FROM {n}_c JOIN {n}_l USING ({_SET}, c, level)),
{n}_i AS (SELECT place, row_number() over (order by place) AS i FROM (SELECT DISTINCT place FROM {n}_w)),
{n}_x AS MATERIALIZED (SELECT {_SET}, rid, held, i, v FROM {n}_w JOIN {n}_i USING (place)),
{n}_xt AS MATERIALIZED (SELECT x.*, ln(1 + price) AS y FROM {n}_x x JOIN {n}_t USING ({_SET}, rid)),
{n}_s AS (SELECT {_SET}, i, sum(v) / any_value(n) AS mu, sum(v * y) / any_value(n) - sum(v) / any_value(n) * any_value(ym) AS cy,
  sqrt(greatest(sum(v * v) / any_value(n) - pow(sum(v) / any_value(n), 2), 0)) AS sc FROM {n}_xt JOIN {n}_y USING ({_SET}) GROUP BY {_SET}, i),
{n}_d AS (SELECT y.*, i.i, coalesce(mu, 0) AS mu, case when sc > 1e-9 * abs(mu) then sc else 1 end AS sc, case when sc > 1e-9 * abs(mu) then cy else 0 end AS cy,
  sc > 1e-9 * abs(mu) AS used FROM {n}_y y CROSS JOIN {n}_i i LEFT JOIN {n}_s USING ({_SET}, i)),
{n}_g AS MATERIALIZED (SELECT {_SET}, a.i AS i, b.i AS j, sum(a.v * b.v) AS g FROM {n}_xt a JOIN {n}_xt b USING ({_SET}, rid) GROUP BY ALL),
{n}_r AS (SELECT a.scope, a.seed, a.f, a.i, list(case when a.used and b.used then (coalesce(g, 0) / a.n - a.mu * b.mu) / (a.sc * b.sc) else 0 end ORDER BY b.i) AS line
 FROM {n}_d a JOIN {n}_d b ON a.scope = b.scope AND a.seed = b.seed AND a.f = b.f LEFT JOIN {n}_g g ON g.scope = a.scope AND g.seed = a.seed AND g.f = a.f AND g.i = a.i AND g.j = b.i
 GROUP BY ALL),
{n}_a AS MATERIALIZED (SELECT {_SET}, list(line ORDER BY i) AS a FROM {n}_r GROUP BY ALL),
{n}_b AS (SELECT {_SET}, pen, list(cy / sc ORDER BY i) AS b, any_value(pen / sd) AS shift FROM {n}_d, (SELECT unnest([{", ".join(map(str, penalties))}])::DOUBLE AS pen) GROUP BY ALL),
{n}_cg AS (
 SELECT {_SET}, pen, 0 AS it, list_transform(b, lambda z: 0.0::DOUBLE) AS x, b AS r, b AS p, list_inner_product(b, b) AS rs FROM {n}_b
 UNION ALL SELECT {_SET}, pen, it, x, r, {add.format("r", "p", "rs / old")}, rs FROM (
  SELECT {_SET}, pen, it, x, r, p, list_inner_product(r, r) AS rs, old FROM (
   SELECT {_SET}, pen, it + 1 AS it, {add.format("x", "p", "(rs / pap)")} AS x, {add.format("r", "ap", "(-rs / pap)")} AS r, p, rs AS old FROM (
    SELECT *, list_inner_product(p, ap) AS pap FROM (
     SELECT c.*, list_transform(list_zip(list_transform(a.a, lambda line: list_inner_product(line, c.p)), c.p), lambda z: z[1] + b.shift * z[2]) AS ap
     FROM {n}_cg c JOIN {n}_a a USING ({_SET}) JOIN {n}_b b USING ({_SET}, pen) WHERE it < 1500 AND rs > 1e-24))))),
{n}_o AS (SELECT {_SET}, pen, arg_max(x, it) AS x FROM {n}_cg GROUP BY ALL),
{n}_k AS (SELECT {_SET}, pen, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM {n}_o),
{n}_q AS (SELECT k.*, w / sc AS beta, mu FROM {n}_k k JOIN {n}_d USING ({_SET}, i)),
{n}_z AS (SELECT {_SET}, pen, any_value(ym) - sum(beta * mu) AS start FROM {n}_q JOIN {n}_y USING ({_SET}) GROUP BY {_SET}, pen),
{n}_p AS (SELECT {_SET}, pen, rid, exp(any_value(start) + sum(v * beta)) - 1 AS p FROM {n}_x JOIN {n}_q USING ({_SET}, i) JOIN {n}_z USING ({_SET}, pen) WHERE held GROUP BY {_SET}, pen, rid),
{n} AS (SELECT * FROM {n}_p JOIN {n}_e USING ({_SET}, rid))"""


def known_sql(seeds, scope="''", where="price IS NOT NULL"):
    listed = ", ".join(map(str, seeds))
    return f"SELECT {scope} AS scope, s.seed, {fold_sql('s.seed')} AS fold, lines.* FROM lines, (SELECT unnest([{listed}]) AS seed) s WHERE {where}"


@query("ml03_ridge_cross_validation", "ML-03", f"""
WITH RECURSIVE {LINES_SQL}, {ridge_sql(known_sql([42]))}
SELECT f::INT AS fold, round(avg(abs(p - price)), 3) AS mae, count(*) AS rows FROM rg GROUP BY 1""")
def ridge_cross_validation(spark, folder):
    return fold_errors(ps.out_of_fold(lines(spark, folder), TABLE, PENALTY)).select("fold", F.round("mae", 3).alias("mae"), "rows")


@query("ml04_ridge_search", "ML-04", f"""
WITH RECURSIVE {LINES_SQL}, {ridge_sql(known_sql([42]), ps.PENALTIES)},
e AS (SELECT pen, avg(mae) AS mae FROM (SELECT pen, f, avg(abs(p - price)) AS mae FROM rg GROUP BY 1, 2) GROUP BY 1)
SELECT 'ridge' AS learner, round(min(mae), 2) AS mae, arg_min(pen, mae) AS penalty FROM e""")
def ridge_search(spark, folder):
    name, mae, penalty = ps.search(durable(lines(spark, folder)), TABLE, {"ridge": ps.PENALTIES})[0]
    return spark.createDataFrame([(name, round(mae, 2), penalty)], "learner string, mae double, penalty double")


@query("ml05_ridge_repeated", "ML-05", f"""
WITH RECURSIVE {LINES_SQL}, {ridge_sql(known_sql(range(5)))}, e AS (SELECT seed, f, avg(abs(p - price)) AS mae FROM rg GROUP BY 1, 2)
SELECT round(avg(mae), 3) AS mean, round(stddev_pop(mae), 3) AS spread, round(max(mae), 3) AS worst, round(min(mae), 3) AS best, count(*) AS folds FROM e""")
def ridge_repeated(spark, folder):
    return of_folds(fold_errors(ps.out_of_fold(lines(spark, folder), TABLE, PENALTY, seeds=range(5)))).select(
        *[F.round(x, 3).alias(x) for x in ("mean", "spread", "worst", "best")], "folds")


@query("ml06_ridge_out_of_fold", "ML-06 AG-30", f"""
WITH RECURSIVE {LINES_SQL}, {ridge_sql(known_sql([42]))}, oof AS (SELECT * FROM rg),
u AS (SELECT 'segment' AS cut, segment AS label, price, p FROM oof UNION ALL SELECT 'flag', flag, price, p FROM oof UNION ALL SELECT 'kind', kind, price, p FROM oof)
SELECT cut, label, count(*) AS rows, round(avg(abs(p - price)), 3) AS mae, round(avg(p - price), 3) AS bias, round(median(price), 3) AS median_actual,
 round(avg(abs(p - price)) * 100 / median(price), 3) AS mape FROM u GROUP BY 1, 2""")
def ridge_out_of_fold(spark, folder):
    return cut_errors(durable(ps.out_of_fold(lines(spark, folder), TABLE, PENALTY))).select(
        "cut", "label", "rows", *[F.round(x, 3).alias(x) for x in ("mae", "bias", "median_actual", "mape")])


@query("ml08_ridge_one_or_many", "ML-08", f"""
WITH RECURSIVE {LINES_SQL}, {ridge_sql(known_sql([42]) + " UNION ALL " + known_sql([42], "flag"))},
e AS (SELECT flag, scope, abs(p - price) AS gap FROM rg)
SELECT flag, round(avg(gap) FILTER (scope = ''), 3) AS one_model, count(*) FILTER (scope = '') AS rows, round(avg(gap) FILTER (scope <> ''), 3) AS own_model FROM e GROUP BY 1""")
def ridge_one_or_many(spark, folder):
    out = ps.one_or_many(lines(spark, folder), TABLE, PENALTY, "flag")
    return out.select("flag", F.round("one_model", 3).alias("one_model"), "rows", F.round("own_model", 3).alias("own_model"))


@query("ml09_ridge_filled_prices", "ML-09", f"""
WITH RECURSIVE {LINES_SQL}, {ridge_sql(known_sql(range(5)))}, e AS (SELECT avg(mae) AS mae FROM (SELECT seed, f, avg(abs(p - price)) AS mae FROM rg GROUP BY 1, 2)),
{ridge_sql("SELECT '' AS scope, 0 AS seed, case when price is null then -1 else 0 end AS fold, lines.* FROM lines", folds=[-1], name="fl")}
SELECT id, price, estimated, final, round(mae, 2) AS model_mae FROM (
 SELECT id, price, false AS estimated, price AS final FROM lines WHERE price IS NOT NULL UNION ALL SELECT id, NULL, true, round(p, 2) FROM fl), e""")
def ridge_filled_prices(spark, folder):
    """Every order line; missing prices by the one penalty, so that SQL can say the same."""
    out = ps.estimate(durable(lines(spark, folder)), TABLE, {"ridge": [PENALTY]})
    return out.select("id", "price", "estimated", "final", "model_mae")


@query("ml11_host_imputation", "ML-11 SJ-07", f"""
WITH u AS (SELECT * FROM agents WHERE price IS NULL), k AS (SELECT * FROM agents WHERE price IS NOT NULL),
e AS (SELECT u.id, min({metres('u', 'k')}) >= 150 AS far FROM u JOIN k USING (host_id) GROUP BY u.id)
SELECT u.id, case when far then round(avg(k.price), 4) end AS price FROM u LEFT JOIN e USING (id) LEFT JOIN k ON k.host_id = u.host_id AND k.area = u.area AND k.places = u.places GROUP BY u.id, far""", ("agents",))
def host_imputation(spark, folder):
    rows = points(spark, folder, "agents")
    evidence = spatial.evidence_of_host(rows, "id", "host_id", "price", "area", "places", "bedrooms", 150.0)
    return pm.impute_by_host(rows, evidence, "id", "host_id", "area", "places", "price").select("id", F.round("price", 4).alias("price"))
