from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.operators.frames import frames
from plumbline.operators.report import report
from plumbline.sources.datasource import SyntheticFrames


def test_synthetic_frames_through_the_reader_interface(spark):
    spark.dataSource.register(SyntheticFrames)
    df = spark.read.format("plumbline_synthetic").option("defects", "clean,identity").option("n_eps", "2").option("T", "60").load()
    f = frames(df, F.col("dataset"), F.col("episode_index"), F.col("pos"), F.col("timestamp"), F.col("frame_index"), F.col("action"), F.col("state"), F.col("fps"))
    got = {r["dataset"]: r for r in report(f).collect()}
    assert got["synthetic/identity"]["flags"] == "action_equals_state" and got["synthetic/clean"]["flags"] == ""
    assert got["synthetic/clean"]["frames_sampled"] == 120
    with pytest.raises(Exception, match="defect"):
        spark.read.format("plumbline_synthetic").option("defects", "odd").load().count()
