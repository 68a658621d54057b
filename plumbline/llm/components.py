"""Connected components by alternating large-star and small-star steps, as equi-joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch


def components(edges: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """edges (a, b) -> (node, component): the smallest node reachable, for every node that has an edge to another.

    Each step is written to the shared folder; hubs are only ever met in a partial minimum or on the side of a join
    that adaptive execution can split.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = scratch.keep(e, "edges")
    mark = None
    for _ in range(most):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select("b", "a"))
        # dealt anew, so that both sides of the join are plain exchanges and a hub's partition can be split
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).hint("rebalance")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m")).hint("rebalance")
        small = large.join(lowest, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        new = scratch.keep(small.where("a <> b").distinct(), "edges")
        scratch.drop(now)
        got = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = new
        if got == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select("b", "b").distinct())
        mark = got
    raise RuntimeError("components did not settle")
