"""Regularity of a sampled stream: rate, percentiles of jitter, and the gate on both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequence import changes

LEAST_SAMPLES = 10


def stream_jitter(df: DataFrame, by: list[str], order: str, stamp: str, hz: float, least_rate: float = 0.96, most_us: float = 2_500.0) -> DataFrame:
    """df with a stamp in microseconds -> by, samples, rate, p50, p99, p999, passed. Only rows whose stamp differs from
    the one before are samples; fewer than ten fail. Percentiles interpolate."""
    kept = changes(df.select(*by, order, stamp), by, order, stamp)
    w = Window.partitionBy(*by).orderBy(order)
    gaps = kept.withColumn("gap", F.col(stamp) - F.lag(stamp).over(w)).withColumn("off", F.abs(F.col("gap") - F.lit(1e6 / hz)))
    g = gaps.groupBy(*by).agg(
        F.count("*").alias("samples"), ((F.count("*") - 1) * 1e6 / F.nullif(F.max(stamp) - F.min(stamp), F.lit(0))).alias("rate"), F.percentile("off", F.array(F.lit(0.5), F.lit(0.99), F.lit(0.999))).alias("p")
    )
    enough = F.col("samples") >= LEAST_SAMPLES
    p = [F.when(enough, F.get("p", i)).alias(n) for i, n in enumerate(("p50", "p99", "p999"))]
    passed = enough & (F.col("rate") >= least_rate * hz) & (F.get("p", F.lit(2)) < most_us)
    return g.select(*by, "samples", F.when(enough, F.col("rate")).alias("rate"), *p, F.coalesce(passed, F.lit(False)).alias("passed"))
