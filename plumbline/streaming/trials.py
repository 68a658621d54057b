"""Trials as a stream: the confidence sequence of each arm after every micro-batch. The sequence is valid at every time
of looking, so a running query may be watched and stopped at will."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequential import confidence_sequence


def watch(trials: DataFrame, arm: str = "arm", outcome: str = "outcome", alpha: float = 0.05) -> DataFrame:
    """A streaming (or plain) table of outcomes 0 and 1 -> arm, s, t, lo, hi. The state is two counts for each arm; write
    it in update or complete mode."""
    counts = trials.groupBy(arm).agg(F.sum(F.col(outcome).cast("long")).alias("s"), F.count(outcome).alias("t"))
    return counts.withColumn("cs", confidence_sequence(F.col("s"), F.col("t"), alpha)).select(arm, "s", "t", F.col("cs.lo").alias("lo"), F.col("cs.hi").alias("hi"))
