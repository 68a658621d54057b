"""The pooled report of a dataset and its flags, derived from one registry.

Shares are sums of numerators over sums of denominators over all episodes of all files, never means of ratios.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.thresholds import DEFAULTS
from .hashing import duplicate_share, episode_hashes
from .lag import best_lag
from .sequence import episodes, jitter, ratio

Thresholds = dict


@dataclass(frozen=True)
class Measure:
    """A column of the report: either num / den pooled over episodes, or a count of episodes with a condition, or a
    column that another operator brings (aggregate)."""

    name: str
    num: str | None = None
    den: str | None = None
    episodes_with: str | None = None


@dataclass
class Flag:
    name: str
    rule: Callable[[Thresholds], Column]
    needs: list[str] = field(default_factory=list)


MEASURES: dict[str, Measure] = {}
FLAGS: dict[str, Flag] = {}


def measure(m: Measure) -> None:
    if m.name in MEASURES:
        raise ValueError(f"measure {m.name} exists")
    MEASURES[m.name] = m


def flag(name: str, *needs: str):
    def add(rule: Callable[[Thresholds], Column]):
        if name in FLAGS:
            raise ValueError(f"flag {name} exists")
        FLAGS[name] = Flag(name, rule, list(needs))
        return rule

    return add


measure(Measure("ts_nonmonotonic_eps", episodes_with="ts_nonmonotonic"))
measure(Measure("frac_bad_dt", "bad_dt", "n_dt"))
measure(Measure("frame_gap_eps", episodes_with="frame_gap"))
measure(Measure("stuck_state_frac", "stuck", "n_stuck"))
measure(Measure("stuck_while_commanded", "stuck_commanded", "n_commanded"))
measure(Measure("identity_frac", "identical", "n_identical"))
measure(Measure("stack_errors", episodes_with="stack_error"))


def _over(column: str, key: str):
    return lambda th: F.col(column) > th[key]


flag("ts_nonmonotonic", "ts_nonmonotonic_eps")(lambda th: F.col("ts_nonmonotonic_eps") > 0)
flag("bad_dt", "frac_bad_dt")(_over("frac_bad_dt", "frac_bad_dt"))
flag("frame_gaps", "frame_gap_eps")(lambda th: F.col("frame_gap_eps") > 0)
flag("stuck_state", "stuck_state_frac")(_over("stuck_state_frac", "stuck_state_frac"))
flag("action_equals_state", "identity_frac")(_over("identity_frac", "identity_frac"))


def _correlated(th: Thresholds) -> Column:
    """A lag counts only where the correlation behind it is strong enough: constant data score alike at every shift."""
    return F.abs(F.col("r_best")) >= th["min_lag_correlation"]


flag("negative_lag", "lag_frames", "r_best")(lambda th: _correlated(th) & (F.col("lag_frames") < 0))
flag("large_lag", "lag_frames", "r_best")(lambda th: _correlated(th) & (F.col("lag_frames") >= 0) & (F.col("lag_frames") >= th["lag_large"]))
flag("duplicate_episodes", "dup_episode_frac")(_over("dup_episode_frac", "dup_episode_frac"))


def flags(thresholds: Thresholds | None = None) -> Column:
    """Names of all flags that hold, in the order of the registry, joined by |. A measure that is null holds none."""
    th = {**DEFAULTS, **(thresholds or {})}
    return F.concat_ws("|", *[F.when(f.rule(th), F.lit(f.name)) for f in FLAGS.values()])


def has_flag(column: Column, name: str) -> Column:
    return F.array_contains(F.split(column, "[|]"), name)


def pooled(frames: DataFrame) -> DataFrame:
    """dataset and all measures of the registry, with numbers of episodes and frames. Frames without an episode count
    as frames alone."""
    e = episodes(frames)
    columns = [F.sum(F.col(m.episodes_with).cast("long")).alias(m.name) for m in MEASURES.values() if m.episodes_with]
    sums = sorted({c for m in MEASURES.values() if m.num for c in (m.num, m.den)})
    g = e.groupBy("dataset").agg(F.count("*").alias("episodes_sampled"), F.max("fps").alias("fps"), *columns, *[F.sum(c).alias(c) for c in sums])
    total = frames.groupBy("dataset").agg(F.count("*").alias("frames_sampled"))
    shares = [ratio(m.num, m.den).alias(m.name) for m in MEASURES.values() if m.num]
    kept = [m.name for m in MEASURES.values() if m.episodes_with]
    return total.join(g, "dataset", "left").select("dataset", "fps", F.coalesce("episodes_sampled", F.lit(0)).alias("episodes_sampled"), "frames_sampled", *[F.coalesce(c, F.lit(0)).alias(c) for c in kept], *shares)


def lags(frames: DataFrame, swapped: bool = False) -> DataFrame:
    """dataset: median of the episodes' best shifts and means of their correlations."""
    return best_lag(frames, swapped=swapped).groupBy("dataset").agg(F.median("lag").alias("lag_frames"), F.avg("r_lag0").alias("r_lag0"), F.avg("r_best").alias("r_best"))


def report(frames: DataFrame, thresholds: Thresholds | None = None, head: int | None = None) -> DataFrame:
    """The whole report, one row a dataset, with flags that stay provisional until a person confirms them."""
    dup = duplicate_share(episode_hashes(frames, head), ["dataset"]).select("dataset", F.col("dup_frac").alias("dup_episode_frac"))
    out = pooled(frames).join(jitter(frames), "dataset", "left").join(lags(frames), "dataset", "left").join(dup, "dataset", "left")
    return out.withColumn("flags", flags(thresholds))


#: Columns of a report record, in order; what a tier does not fill stays at its default.
RECORD = (
    ("repo", "string", ""), ("codebase", "string", ""), ("fps", "double", None), ("episodes_sampled", "int", 0), ("frames_sampled", "bigint", 0),
    ("ts_nonmonotonic_eps", "int", 0), ("frac_bad_dt", "double", None), ("dt_jitter_ratio", "double", None), ("frame_gap_eps", "int", 0),
    ("stuck_state_frac", "double", None), ("identity_frac", "double", None), ("lag_frames", "double", None), ("r_lag0", "double", None),
    ("r_best", "double", None), ("dup_episode_frac", "double", None), ("flags", "string", ""), ("note", "string", ""), ("confirmed", "string", ""),
    ("source", "string", ""), ("revision", "string", ""), ("error", "string", ""), ("total_episodes", "int", 0), ("total_frames", "bigint", 0),
    ("chunk_size", "int", 0), ("layout_family", "string", ""), ("feature_names", "string", ""), ("n_features", "int", 0), ("stack_errors", "int", 0),
)


def as_records(df: DataFrame) -> DataFrame:
    """Any report as records of the fixed schema, absent columns at their defaults."""
    cols = []
    for name, kind, default in RECORD:
        value = F.col(name).cast(kind) if name in df.columns else F.lit(default).cast(kind)
        cols.append((value if default is None else F.coalesce(value, F.lit(default).cast(kind))).alias(name))
    return df.select(*cols)


def evidence(frames: DataFrame, rows: int = 3, dims: int = 6, least_dims: int = 6) -> DataFrame:
    """What a person needs to look at first: widths, exactly identical frames, and the first rows of both vectors of
    each dataset's first episode."""
    from ..functions.vectors import same
    from .frames import KEY
    from .hashing import first_rows

    g = frames.where("episode is not null")
    widths = g.groupBy("dataset").agg(
        F.max(F.size("action")).alias("action_dims"), F.max(F.size("state")).alias("state_dims"), F.count("*").alias("n_frames"),
        F.count_if(F.coalesce((F.size("action") == F.size("state")) & same(F.col("action"), F.col("state")), F.lit(False))).alias("n_identical"),
        F.min(F.struct("file", "episode")).alias("first"),
    )
    head = g.join(widths.select(F.col("dataset").alias("d"), "first"), (F.col("dataset") == F.col("d")) & (F.struct("file", "episode") == F.col("first")))
    shown = lambda c: F.array_join(F.transform(F.slice(c, 1, dims), lambda x: F.format_string("%.5f", x)), " ")
    lines = first_rows(head.select(*g.columns), rows).select(*KEY, "nth", shown("action").alias("action"), shown("state").alias("state"))
    preview = lines.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("nth", "action", "state"))).alias("preview"))
    return widths.drop("first").join(preview, "dataset", "left").withColumn("narrow", F.col("action_dims") < least_dims)
