"""Ordered-sequence checks of an episode.

All of them come from one pass: rows are dealt by episode once, sorted once, and compared with the row before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import close, finite, same
from .frames import KEY

#: Share of the nominal period by which an interval may be off.
TOLERANCE = 0.25


def ordered():
    return Window.partitionBy(*KEY).orderBy("pos")


def episode_window():
    """The whole episode, in the order of the other windows, so that one sort serves all."""
    return ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def stackable(column: str, w) -> Column:
    """All vectors of the episode there and of one length."""
    c = F.col(column)
    return (F.count(c).over(w) == F.count(F.lit(1)).over(w)) & (F.min(F.size(c)).over(w) == F.max(F.size(c)).over(w))


def steps(frames: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Every frame with what the checks see in it. Rows without an episode are left out; counts of frames are taken
    before."""
    every, o = episode_window(), ordered()
    df = frames.where("episode is not null")
    df = df.withColumn("ok_action", F.col("has_action") & stackable("action", every)).withColumn("ok_state", F.col("has_state") & stackable("state", every))
    df = df.withColumn("alike", F.col("ok_action") & F.col("ok_state") & (F.size("action") == F.size("state")))
    before = {c: F.lag(c).over(o) for c in ("ts", "frame_index", "state", "action")}
    df = df.withColumn("pair", F.row_number().over(o) > 1)
    for c, x in before.items():
        df = df.withColumn(f"last_{c}", x)
    period = F.when(F.col("fps") > 0, 1 / F.col("fps"))
    dt = F.col("ts") - F.col("last_ts")
    df = df.withColumn("dt", dt).withColumn("timed", F.col("pair") & F.col("has_ts") & F.coalesce(F.col("fps") > 0, F.lit(False)))
    real = F.col("dt").isNotNull() & ~F.isnan("dt")
    no = F.lit(False)
    return (
        df.withColumn("bad_dt", F.coalesce(F.col("timed") & real & (F.abs(F.col("dt") - period) > F.lit(tolerance) * period), no))
        .withColumn("back", F.coalesce(F.col("pair") & F.col("has_ts") & real & (F.col("dt") <= 0), no))
        .withColumn("gap", F.col("pair") & F.col("has_index") & F.coalesce(F.col("frame_index") - F.col("last_frame_index") != 1, F.lit(True)))
        .withColumn("stuck", F.coalesce(F.col("pair") & F.col("ok_state") & same(F.col("state"), F.col("last_state")), no))
        .withColumn("held", F.coalesce(F.col("pair") & F.col("ok_action") & same(F.col("action"), F.col("last_action")), no))
        .withColumn("identical", F.coalesce(F.col("alike") & close(F.col("action"), F.col("state")), no))
    )


def _n(condition: str) -> Column:
    return F.count_if(F.expr(condition))


def episodes(frames: DataFrame) -> DataFrame:
    """One row an episode: numerators and denominators of every check, never ratios."""
    g = steps(frames).groupBy(*KEY)
    return g.agg(
        F.count("*").alias("frames"),
        _n("bad_dt").alias("bad_dt"),
        _n("timed").alias("n_dt"),
        F.bool_or("back").alias("ts_nonmonotonic"),
        F.bool_or("gap").alias("frame_gap"),
        _n("stuck").alias("stuck"),
        _n("pair and ok_state").alias("n_stuck"),
        _n("stuck and alike and not held").alias("stuck_commanded"),
        _n("pair and alike").alias("n_commanded"),
        _n("identical").alias("identical"),
        _n("alike").alias("n_identical"),
        F.bool_or(F.expr("(has_action and not ok_action) or (has_state and not ok_state)")).alias("stack_error"),
        F.max("fps").alias("fps"),
    )


def ratio(num: str, den: str) -> Column:
    """Null where nothing could be measured."""
    return F.try_divide(F.col(num), F.nullif(F.col(den), F.lit(0)))


def per_episode(frames: DataFrame) -> DataFrame:
    """The checks as values of each episode."""
    e = episodes(frames)
    return e.select(
        *KEY,
        "frames",
        ratio("bad_dt", "n_dt").alias("frac_bad_dt"),
        F.col("ts_nonmonotonic").cast("int").alias("ts_nonmonotonic"),
        F.col("frame_gap").cast("int").alias("frame_gap"),
        ratio("stuck", "n_stuck").alias("stuck_state_frac"),
        ratio("stuck_commanded", "n_commanded").alias("stuck_while_commanded"),
        ratio("identical", "n_identical").alias("identity_frac"),
    )


def jitter(frames: DataFrame) -> DataFrame:
    """dataset, dt_jitter_ratio: median absolute deviation of all intervals from their median, in periods. Any interval
    that is not a number makes it null. A median's buffer holds the different intervals of a dataset, each once."""
    dts = steps(frames).where("timed").select("dataset", "dt", "fps")
    odd = F.bool_or(~F.coalesce(finite(F.col("dt")), F.lit(False)))
    middle = dts.groupBy("dataset").agg(F.median("dt").alias("middle"), odd.alias("odd"))
    off = dts.join(middle, "dataset").groupBy("dataset").agg((F.median(F.abs(F.col("dt") - F.col("middle"))) * F.max("fps")).alias("r"), F.bool_or("odd").alias("odd"))
    return off.select("dataset", F.when(~F.col("odd"), F.col("r")).alias("dt_jitter_ratio"))


def stuck_runs(frames: DataFrame) -> DataFrame:
    """Runs of stuck steps by dataset: their number, median and longest length, and how many are single."""
    o = ordered()
    s = steps(frames).where("pair").select(*KEY, "pos", "stuck")
    s = s.withColumn("island", F.row_number().over(o) - F.row_number().over(Window.partitionBy(*KEY, "stuck").orderBy("pos")))
    runs = s.where("stuck").groupBy(*KEY, "island").agg(F.count("*").alias("length"))
    return runs.groupBy("dataset").agg(F.count("*").alias("n_runs"), F.median("length").alias("median_run"), F.max("length").alias("longest_run"), _n("length = 1").alias("single_runs"))


def cofreeze(frames: DataFrame) -> DataFrame:
    """How often the action is held, overall, in stuck steps and in others, and the ratio of the last two."""
    held = F.col("held").cast("double")
    g = steps(frames).where("pair and alike").groupBy("dataset").agg(
        F.avg(held).alias("p_held"), F.avg(F.when(F.col("stuck"), held)).alias("p_held_stuck"), F.avg(F.when(~F.col("stuck"), held)).alias("p_held_moving")
    )
    return g.withColumn("ratio", F.try_divide("p_held_stuck", F.nullif("p_held_moving", F.lit(0.0))))


def changes(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from the row before; the first stays."""
    w = Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)
    marked = df.withColumn("__last", F.lag(value).over(w)).withColumn("__nth", F.row_number().over(w))
    return marked.where((F.col("__nth") == 1) | ~F.col("__last").eqNullSafe(F.col(value))).drop("__last", "__nth")
