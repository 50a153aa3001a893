"""Hot keys: right results and plans that can cut them up."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostelry.operators import dedup
from hostelry.operators.distribution import dense_index, group_stats, keep_first, spread_join
from hostelry.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key; some keys are null."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 977)
    return spark.range(0, 60_000, 1, 8).select("id", key.alias("k"), ((F.col("id") * 7919) % 10_007 / 3).alias("v"))


def executed_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_join_is_cut_up(spark, skewed, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
             spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
             spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
             spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB", spark__sql__shuffle__partitions="16")
    out = group_stats(skewed, ["k"], n=F.count(F.lit(1)))
    assert "skew=true" in executed_plan(out)
    hot = out.filter("k = 7").agg(F.count("*").alias("rows"), F.max("n").alias("n")).first()
    assert hot["rows"] == hot["n"] >= 20_000
    assert out.count() == 60_000
    assert out.filter("k is null").select("n").distinct().count() == 1


def test_first_per_key_is_cut_before_the_shuffle(skewed):
    plan = executed_plan(keep_first(skewed, ["k"], [F.col("id")]))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_null_keys_match_null_keys(spark, skewed):
    side = spark.createDataFrame([(None, "none"), (7, "hot")], "k long, label string")
    out = spread_join(skewed, side, ["k"])
    assert out.filter("label = 'none'").count() == skewed.filter("k is null").count()


@pytest.mark.parametrize("large", ["2000000", "10"])
def test_quantiles_match_numpy(skewed, settings, large):
    settings(spark__hostelry__largeGroup=large)
    got = {r["k"]: r for r in exact_quantiles(skewed, ["k"], "v", {"a": 0.0, "b": 0.37, "c": 1.0}).collect()}
    rows = skewed.toPandas()
    for k in (7.0, 100.0):
        values = rows[rows.k == k].v
        assert np.allclose([got[int(k)][c] for c in "abc"], np.quantile(values, [0, 0.37, 1.0]))
    assert got[None]["c"] == rows[rows.k.isna()].v.max()


@pytest.mark.parametrize("large", ["2000000", "10"])
def test_weighted_quantile_matches_search(skewed, settings, large):
    settings(spark__hostelry__largeGroup=large)
    weighted = skewed.withColumn("w", (F.col("id") % 5 + 1).cast("double"))
    got = exact_quantiles(weighted, [], "v", {"q": 0.9}, weight=F.col("w"), rule="reach").first()["q"]
    rows = weighted.toPandas().sort_values("v")
    share = rows.w.cumsum() / rows.w.sum()
    assert got == rows.v.to_numpy()[np.searchsorted(share, 0.9)]


@pytest.mark.parametrize("large", ["2000000", "10"])
@pytest.mark.parametrize("weight", [0.1, 0.383, 0.7])
def test_equal_weights_of_any_size_give_the_exact_median(spark, settings, large, weight):
    settings(spark__hostelry__largeGroup=large)
    rows = spark.range(300).selectExpr("id + 1 as g").selectExpr("g", "explode(sequence(1L, 2 * g)) as v")
    got = exact_quantiles(rows, ["g"], "v", {"q": 0.5}, weight=F.lit(weight), rule="reach")
    assert got.where("q <> g").count() == 0 and got.count() == 300


def test_dense_index_is_a_ranking(skewed):
    rows = dense_index(skewed, [F.col("v"), F.col("id")]).orderBy("v", "id").select("index").collect()
    assert [r["index"] for r in rows] == list(range(60_000))


def test_chain_and_its_report_agree(spark, skewed):
    steps = [dedup.Step(["k", "v"], F.col("k").isNotNull(), "strict"), dedup.Step(["k"], F.col("k").isNotNull(), "loose")]
    left = dedup.dedup_chain(skewed, steps, "id", [F.col("id")])
    report = dedup.chain_report(skewed, steps, "id", F.col("id")).collect()
    assert left.count() == report[0]["kept_at_end"] == 60_000 - sum(r["removed"] for r in report)
    assert left.filter("k is null").count() == skewed.filter("k is null").count()
    assert left.filter("k = 7").first()["id"] == 0


@pytest.mark.parametrize("large", ["2000000", "10"])
def test_rows_that_count_several_times(spark, skewed, settings, large):
    settings(spark__hostelry__largeGroup=large)
    counts = skewed.groupBy("k", "v").agg(F.count("*").alias("n"))
    got = exact_quantiles(counts, ["k"], "v", {"a": 0.1, "b": 0.5}, times=F.col("n"))
    assert got.exceptAll(exact_quantiles(skewed, ["k"], "v", {"a": 0.1, "b": 0.5})).count() == 0 and got.count() == skewed.select("k").distinct().count()


def test_a_large_group_is_not_shuffled_as_a_whole(spark, settings):
    settings(spark__hostelry__largeGroup="1000")
    rows = spark.range(0, 100_000, 1, 4).select((F.col("id") % 2).alias("k"), ((F.col("id") * 7919) % 100_003).cast("double").alias("v"))
    out = exact_quantiles(rows, ["k"], "v", {"m": 0.5})
    values = rows.toPandas()
    assert {r["k"]: r["m"] for r in out.collect()} == {k: values[values.k == k].v.median() for k in (0, 1)}
    # the values that meet are those of the ranges: a left join with the ranges that hold an answer goes before their aggregate
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    totals = [i for i, x in enumerate(plan) if "Aggregate [" in x and "__v" in x.split("],")[0]]
    assert totals and all(any("__wanted" in x for x in plan[i:]) for i in totals)
