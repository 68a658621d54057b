"""The one shape all checks read: a row for each time step of an episode.

    dataset string, file string, episode long, pos long (physical order), ts double, frame_index long,
    action array<double>, state array<double>, has_ts, has_index, has_action, has_state boolean, fps double

An episode is (dataset, file, episode): the same index in two files is two episodes. has_* say whether the file had the
column at all, which is not the same as a value that cannot be used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import widen

KEY = ["dataset", "file", "episode"]


def frames(
    df: DataFrame,
    dataset: Column,
    episode: Column,
    pos: Column,
    ts: Column | None = None,
    frame_index: Column | None = None,
    action: Column | None = None,
    state: Column | None = None,
    fps: Column | None = None,
    file: Column | None = None,
) -> DataFrame:
    """Any table as frames. Columns that are not given are absent, not null."""

    def given(x: Column | None, kind: str) -> Column:
        return F.lit(None).cast(kind) if x is None else x.cast(kind)

    vector = lambda x: F.lit(None).cast("array<double>") if x is None else widen(x)
    return df.select(
        dataset.cast("string").alias("dataset"),
        (F.lit("") if file is None else file).alias("file"),
        episode.cast("long").alias("episode"),
        pos.cast("long").alias("pos"),
        given(ts, "double").alias("ts"),
        given(frame_index, "long").alias("frame_index"),
        vector(action).alias("action"),
        vector(state).alias("state"),
        *[F.lit(x is not None).alias(f"has_{n}") for n, x in (("ts", ts), ("index", frame_index), ("action", action), ("state", state))],
        given(fps, "double").alias("fps"),
    )
