"""Resumable enrichment as a stream: each arriving file is done once, done keys are skipped."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostelry.operators.distribution import keep_first


#: Parts that done keys are dealt to by their hash; a folder keeps the number it began with.
BUCKETS = 64


def run_pending(
    spark: SparkSession, inbox: str, done: str, key: str, work: Callable[[DataFrame], DataFrame],
    order: Sequence[Column] = (), buckets: int = BUCKETS,
) -> None:
    """Processes what arrived since the last run and appends it to ``done``/rows.

    The stream's checkpoint remembers the files, the anti join skips keys an earlier file brought,
    and a batch replayed after a failure overwrites its own part, so nothing is done or kept twice. Of the
    rows of one key in a batch the first by ``order`` counts (by all columns, unless stated).

    ``done``/keys holds the keys of the rows once more, in ``buckets`` by hash: a batch reads the buckets that its
    own keys fall into and no earlier row.
    """
    rows, keys = f"{done}/rows", f"{done}/keys"
    schema = spark.read.parquet(inbox).schema
    kind = schema[key].dataType
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")

    def step(batch: DataFrame, number: int) -> None:
        fresh = keep_first(batch, [key], list(order) or [F.col(c) for c in batch.columns])
        if number > 0:
            met = [r.bucket for r in batch.select(bucket).distinct().collect()]  # at most ``buckets``
            layout = T.StructType([T.StructField("done_", kind), T.StructField("batch", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
            earlier = batch.sparkSession.read.schema(layout).parquet(keys).filter((F.col("batch") < number) & F.col("bucket").isin(met)).select("done_", "bucket")
            fresh = fresh.join(earlier, (F.col(key) == F.col("done_")) & (bucket == F.col("bucket")), "left_anti")
        work(fresh).write.mode("overwrite").parquet(f"{rows}/batch={number}")
        kept = batch.sparkSession.read.parquet(f"{rows}/batch={number}").select(F.col(key).cast(kind).alias("done_"), bucket)
        kept.distinct().repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{keys}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(inbox)
    query = (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{done}/progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
