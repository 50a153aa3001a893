"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostelry.operators.distribution import attach
from hostelry.session import discard, durable


def components(links: DataFrame) -> DataFrame:
    """``node, component``: every node of ``links`` (columns ``a``, ``b``) with the smallest node it reaches.

    Alternating large and small stars: each step hangs the larger neighbours, then the smaller ones, of every node
    on its smallest neighbour, which takes a number of steps that grows with the logarithm of a path's length. A
    node's neighbours are only ever reduced to their minimum, so a hub with many links is an aggregate and a join
    that can be cut up. Each round is written to the shared folder,
    and the round before it goes.
    """
    edges = durable(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = attach(both, low, ["a"]).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        small = attach(down, low, ["a"]).select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct(F.col("a"), F.col("low").alias("b")))).alias("e"))
        last, edges = edges, durable(small.select("e.a", "e.b").where("a <> b").distinct())
        discard(last)
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if now == before:
            break
        before = now
    ends = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return ends.unionByName(roots)
