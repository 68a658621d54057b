"""Cross-correlation of action and state over shifts, as windows over one dimension of one episode."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import unless_nan
from .frames import KEY
from .sequence import episode_window, stackable

LAGS = tuple(range(-5, 11))
LEAST_FRAMES, LEAST_OVERLAP = 30, 20


def scores(frames: DataFrame, lags: tuple[int, ...] = LAGS, swapped: bool = False) -> DataFrame:
    """One row for each episode and shift: lag, r. Both series are centred and scaled over the whole episode; the mean
    is over the overlap, then over the dimensions that have a value."""
    w = episode_window()
    df = frames.where("episode is not null").withColumn("t", F.count("*").over(w))
    usable = F.col("has_action") & F.col("has_state") & stackable("action", w) & stackable("state", w) & (F.size("action") == F.size("state"))
    df = df.withColumn("usable", usable).where((F.col("t") >= LEAST_FRAMES) & F.col("usable"))
    a, s = ("state", "action") if swapped else ("action", "state")
    cells = df.select(*KEY, "pos", "t", F.posexplode(F.arrays_zip(F.col(a).alias("a"), F.col(s).alias("s"))).alias("dim", "x"))
    cells = cells.select(*KEY, "dim", "pos", "t", F.col("x.a").alias("a"), F.col("x.s").alias("s"))
    order = Window.partitionBy(*KEY, "dim").orderBy("pos")
    series = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = cells.withColumn("a", F.col("a") - F.avg("a").over(series)).withColumn("s", F.col("s") - F.avg("s").over(series))
    products = [F.when(F.col("t") - abs(k) >= LEAST_OVERLAP, F.col("a") * F.lead("s", k).over(order)).alias(f"p{i}") for i, k in enumerate(lags)]
    cells = cells.select(*KEY, "dim", "a", "s", *products)
    scale = (F.stddev_pop("a") + 1e-9) * (F.stddev_pop("s") + 1e-9)
    dims = cells.groupBy(*KEY, "dim").agg(scale.alias("scale"), *[F.avg(f"p{i}").alias(f"p{i}") for i in range(len(lags))])
    means = dims.groupBy(*KEY).agg(*[F.avg(unless_nan(F.col(f"p{i}") / F.col("scale"))).alias(f"p{i}") for i in range(len(lags))])
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"p{i}").alias("r")) for i, k in enumerate(lags)])
    return means.select(*KEY, F.explode(pairs).alias("x")).select(*KEY, "x.lag", "x.r").where("r is not null")


def best_lag(frames: DataFrame, lags: tuple[int, ...] = LAGS, swapped: bool = False) -> DataFrame:
    """One row an episode: lag, r_lag0, r_best. Of equal scores the smallest shift wins."""
    g = scores(frames, lags, swapped).groupBy(*KEY)
    top = g.agg(F.max(F.struct("r", (-F.col("lag")).alias("minus"))).alias("top"), F.max(F.when(F.col("lag") == 0, F.col("r"))).alias("r_lag0"))
    return top.select(*KEY, (-F.col("top.minus")).alias("lag"), "r_lag0", F.col("top.r").alias("r_best"))
