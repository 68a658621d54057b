"""Properties over drawn settings; each example is a batch of datasets in one job."""

from __future__ import annotations

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.operators import lag, sequence
from plumbline.operators.frames import frames
from plumbline.operators.report import report
from plumbline.sources.synth import synthetic_frames

SLOW = {"deadline": None, "suppress_health_check": [HealthCheck.function_scoped_fixture, HealthCheck.too_slow]}
spec = st.fixed_dictionaries({"seed": st.integers(0, 2**31), "n_eps": st.integers(1, 4), "T": st.integers(120, 260), "n_joints": st.integers(6, 14), "lag": st.integers(0, 6), "fps": st.sampled_from([10.0, 30.0, 50.0])})


def named(specs, **more):
    return [{**s, **more, "dataset": str(i)} for i, s in enumerate(specs)]


@settings(max_examples=3, **SLOW)
@given(specs=st.lists(spec, min_size=25, max_size=25))
def test_clean_data_raise_no_flag_but_their_lag(spark, specs):
    got = {r["dataset"]: r for r in report(synthetic_frames(spark, named(specs))).collect()}
    for i, s in enumerate(specs):
        r = got[str(i)]
        assert r["flags"] == ("large_lag" if s["lag"] >= 3 else "") and r["lag_frames"] == s["lag"], s
        assert (r["episodes_sampled"], r["frames_sampled"]) == (s["n_eps"], s["n_eps"] * s["T"])


@settings(max_examples=2, **SLOW)
@given(specs=st.lists(spec, min_size=20, max_size=20))
def test_identity_is_always_caught(spark, specs):
    assert all("action_equals_state" in r["flags"] for r in report(synthetic_frames(spark, named(specs, defect="identity"))).collect())


vector = st.lists(st.sampled_from([0.0, -0.0, 1.0, 1.000001, 2.5, float("nan"), float("inf")]), min_size=2, max_size=2)
episode = st.lists(st.tuples(vector, vector, st.one_of(st.floats(0, 3), st.just(float("nan"))), st.integers(0, 4)), min_size=1, max_size=9)


@settings(max_examples=4, **SLOW)
@given(eps=st.lists(episode, min_size=12, max_size=12))
def test_checks_are_the_numpy_checks(spark, eps):
    rows = [(e, i, a, s, t, k) for e, ep in enumerate(eps) for i, (a, s, t, k) in enumerate(ep)]
    df = spark.createDataFrame(rows, "e long, i long, a array<double>, s array<double>, t double, k long")
    f = frames(df, F.lit("d"), F.col("e"), F.col("i"), F.col("t"), F.col("k"), F.col("a"), F.col("s"), F.lit(2.0))
    got = {r["episode"]: r for r in sequence.episodes(f).collect()}
    for e, ep in enumerate(eps):
        a, s, t, k = (np.array(x) for x in zip(*ep))
        dt, r = np.diff(t), got[e]
        assert r["bad_dt"] == int((np.abs(dt - 0.5) > 0.125).sum()) and r["n_dt"] == len(dt)
        assert r["ts_nonmonotonic"] == bool((dt <= 0).any()) and r["frame_gap"] == bool((np.diff(k) != 1).any())
        frozen, moved = (s[1:] == s[:-1]).all(1), ~(a[1:] == a[:-1]).all(1)
        assert (r["stuck"], r["n_stuck"], r["stuck_commanded"]) == (int(frozen.sum()), len(frozen), int((frozen & moved).sum()))
        with np.errstate(invalid="ignore"):
            assert r["identical"] == int(np.isclose(a, s, atol=0).all(1).sum())


def test_shuffled_rows_change_nothing(spark):
    f = synthetic_frames(spark, named([{"T": 90, "n_eps": 3}])).persist()
    rows = lambda d: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.collect())
    mixed = f.repartition(7, F.xxhash64("pos"))
    assert rows(sequence.episodes(f)) == rows(sequence.episodes(mixed)) and rows(lag.best_lag(f)) == rows(lag.best_lag(mixed))
    f.unpersist()
