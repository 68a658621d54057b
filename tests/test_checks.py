"""Sequence checks, lags, hashes and the pooled report on hand-made episodes and against a NumPy version."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import hashing, jitter, lag, report, sequence
from plumbline.operators.frames import frames

NAN = float("nan")


def make(spark, episodes, fps=30.0, dataset="d", shuffle=True):
    """episodes: dicts with ts, index, action, state, file; what is missing everywhere is an absent column."""
    rows = []
    for e, ep in enumerate(episodes):
        n = max(len(ep[k]) for k in ("ts", "index", "action", "state") if k in ep)
        at = lambda k, i: ep[k][i] if k in ep else None
        rows += [(ep.get("dataset", dataset), ep.get("file", "f"), ep.get("episode", e), i, at("ts", i), at("index", i), at("action", i), at("state", i), ep.get("fps", fps)) for i in range(n)]
    df = spark.createDataFrame(rows, "dataset string, file string, episode long, pos long, ts double, idx long, action array<double>, state array<double>, fps double")
    if shuffle:
        df = df.orderBy(F.xxhash64("episode", "pos"))
    have = {k for ep in episodes for k in ep}
    col = lambda k, c: F.col(c) if k in have else None
    return frames(df, F.col("dataset"), F.col("episode"), F.col("pos"), col("ts", "ts"), col("index", "idx"), col("action", "action"), col("state", "state"), F.col("fps"), F.col("file"))


def one(df):
    (row,) = df.collect()
    return row


def hold(v, n):
    return [[float(x) for x in v] for _ in range(n)]


def test_clean_episode_raises_nothing(spark):
    rng = np.random.default_rng(0)
    walk = rng.standard_normal((60, 3)).cumsum(0)
    ep = {"ts": [i / 30 for i in range(60)], "index": list(range(60)), "action": walk[1:].tolist() + [walk[0].tolist()], "state": walk.tolist()}
    r = one(sequence.per_episode(make(spark, [ep])))
    assert (r["ts_nonmonotonic"], r["frame_gap"], r["frac_bad_dt"], r["stuck_state_frac"], r["identity_frac"]) == (0, 0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("ts, want", [([0, 0.033, 0.033, 0.1], 1), ([0, 0.1, 0.05], 1), ([0, 1, 2], 0), ([5.0], 0), ([0, NAN, 1], 0)])
def test_time_must_go_forward(spark, ts, want):
    assert one(sequence.per_episode(make(spark, [{"ts": [float(x) for x in ts]}])))["ts_nonmonotonic"] == want


@pytest.mark.parametrize("index, want", [([0, 1, 3], 1), ([0, 1, 1], 1), ([3, 4, 5], 0), ([9], 0), ([0, None, 2], 1)])
def test_indices_must_step_by_one(spark, index, want):
    assert one(sequence.per_episode(make(spark, [{"index": index}])))["frame_gap"] == want


def test_intervals_off_the_period(spark):
    ts = [0.0, 0.1, 0.2, 0.35, 0.45, 0.575]
    assert one(sequence.per_episode(make(spark, [{"ts": ts}], fps=10.0)))["frac_bad_dt"] == pytest.approx(1 / 5)
    for fps in (0.0, None, -1.0):
        assert one(sequence.per_episode(make(spark, [{"ts": ts}], fps=fps)))["frac_bad_dt"] is None
    odd = one(sequence.episodes(make(spark, [{"ts": [0.0, NAN, 0.2, None]}], fps=10.0)))
    assert (odd["bad_dt"], odd["n_dt"]) == (0, 3)


def test_holding_is_not_ignoring_a_command(spark):
    n = 200
    moving = [[float(i), 0.0] for i in range(n)]
    held, ignored = {"action": hold([1, 2], n), "state": hold([1, 2], n)}, {"action": moving, "state": hold([1, 2], n)}
    a, b = (r for r in sequence.per_episode(make(spark, [held, ignored])).orderBy("episode").collect())
    assert a["stuck_state_frac"] > 0.9 and a["stuck_while_commanded"] == 0 and b["stuck_while_commanded"] > 0.9
    wide = one(sequence.per_episode(make(spark, [{"action": [[1.0, 2.0, 3.0]] * 5, "state": [[1.0, 2.0]] * 5}])))
    assert wide["identity_frac"] is None and wide["stuck_while_commanded"] is None and wide["stuck_state_frac"] == 1.0


def test_vectors_that_cannot_be_stacked(spark):
    ragged = one(sequence.episodes(make(spark, [{"action": [[1.0, 2.0], [1.0, 2.0, 3.0], [1.0]], "state": hold([1], 3)}])))
    assert ragged["stack_error"] and ragged["n_identical"] == 0
    missing = one(sequence.episodes(make(spark, [{"action": [[1.0], None, [1.0]], "ts": [0.0, 1.0, 2.0]}])))
    assert missing["stack_error"]
    absent = one(sequence.episodes(make(spark, [{"ts": [0.0, 1.0]}])))
    assert not absent["stack_error"]
    element = one(sequence.episodes(make(spark, [{"action": [[1.0], [None], [1.0]], "state": hold([1], 3)}])))
    assert not element["stack_error"] and (element["identical"], element["n_identical"]) == (2, 3)


def test_equality_follows_numpy(spark):
    a = [[1.0], [1.000001], [1.1], [0.0], [NAN], [math.inf], [-0.0], [1e-12]]
    s = [[1.0], [1.0], [1.0], [1e-12], [NAN], [math.inf], [0.0], [0.0]]
    r = one(sequence.episodes(make(spark, [{"action": a, "state": s}])))
    assert r["identical"] == int(np.isclose(np.array(a), np.array(s), atol=0).all(1).sum())
    stuck = one(sequence.episodes(make(spark, [{"state": [[NAN], [NAN], [0.0], [-0.0]]}])))
    assert stuck["stuck"] == 1


def numpy_lag(a, s, lags=range(-5, 11)):
    a, s = a - a.mean(0), s - s.mean(0)
    scale, got = (a.std(0) + 1e-9) * (s.std(0) + 1e-9), {}
    for k in lags:
        x, y = (a[: len(a) - k], s[k:]) if k >= 0 else (a[-k:], s[: len(s) + k])
        got[k] = float(np.mean((x * y).mean(0) / scale))
    best = max(got, key=got.get)
    return best, got[0], got[best]


@pytest.mark.parametrize("shift", [-3, 0, 4])
def test_lag_is_the_numpy_lag(spark, shift):
    rng = np.random.default_rng(shift + 9)
    walk = rng.standard_normal((140, 6)).cumsum(0)
    a, s = walk[10 + shift : 110 + shift], walk[10:110] + rng.normal(0, 1e-3, (100, 6))
    r = one(lag.best_lag(make(spark, [{"action": a.tolist(), "state": s.tolist()}])))
    want = numpy_lag(a, s)
    assert r["lag"] == want[0] == shift and (r["r_lag0"], r["r_best"]) == pytest.approx(want[1:], abs=1e-12)
    swapped = one(lag.best_lag(make(spark, [{"action": a.tolist(), "state": s.tolist()}]), swapped=True))
    assert swapped["lag"] == -shift


def test_short_or_unlike_episodes_have_no_lag(spark):
    short = {"action": hold([1.0], 5), "state": hold([1.0], 5)}
    unlike = {"action": hold([1.0, 2.0], 40), "state": hold([1.0], 40)}
    assert lag.best_lag(make(spark, [short, unlike])).count() == 0


def test_constant_data_are_not_lagging(spark):
    ep = {"action": hold([0.0] * 3, 200), "state": hold([0.0] * 3, 200), "ts": [i / 30 for i in range(200)], "index": list(range(200))}
    r = one(report.report(make(spark, [ep])))
    assert "lag" not in r["flags"] and "stuck_state" in r["flags"] and "action_equals_state" in r["flags"]


def test_shared_start_is_no_copy(spark):
    rng = np.random.default_rng(1)
    head = rng.standard_normal((60, 2))
    eps = [{"action": np.vstack([head, rng.standard_normal((20, 2))]).tolist()} for _ in range(4)]
    f = make(spark, eps)
    assert one(hashing.duplicate_share(hashing.episode_hashes(f), ["dataset"]))["dup_frac"] == 0
    assert one(hashing.duplicate_share(hashing.episode_hashes(f, head=50), ["dataset"]))["dup_frac"] == 0.75
    copies = make(spark, [eps[0], eps[0], {**eps[0], "file": "g"}])
    assert one(hashing.duplicate_share(hashing.episode_hashes(copies), ["dataset"]))["dup_frac"] == pytest.approx(2 / 3)
    near = [{"action": [[0.00004]] * 3}, {"action": [[0.0]] * 3}, {"action": [[-0.0]] * 3}, {"action": [[0.0]] * 4}]
    assert one(hashing.duplicate_share(hashing.episode_hashes(make(spark, near)), ["dataset"]))["kinds"] == 3


def test_pooling_is_not_a_mean_of_ratios(spark):
    eps = [{"state": hold([1.0], 3)}, {"state": [[float(i)] for i in range(101)]}]
    assert one(report.pooled(make(spark, eps)))["stuck_state_frac"] == pytest.approx(2 / 102)


def test_same_index_in_two_files_is_two_episodes(spark):
    eps = [{"index": [0, 1], "episode": 0, "file": "a"}, {"index": [5, 6], "episode": 0, "file": "b"}, {"index": [7], "episode": None, "file": "b"}]
    r = one(report.pooled(make(spark, eps)))
    assert (r["episodes_sampled"], r["frames_sampled"], r["frame_gap_eps"]) == (2, 5, 0)


def test_jitter_is_the_median_deviation(spark):
    ts = np.cumsum([0, 0.1, 0.12, 0.1, 0.09, 0.1, 0.3]).tolist()
    dt = np.diff(ts)
    want = float(np.median(np.abs(dt - np.median(dt)))) * 10
    assert one(sequence.jitter(make(spark, [{"ts": ts}], fps=10.0)))["dt_jitter_ratio"] == pytest.approx(want)
    assert one(sequence.jitter(make(spark, [{"ts": [0.0, NAN, 1.0]}], fps=10.0)))["dt_jitter_ratio"] is None
    assert sequence.jitter(make(spark, [{"ts": ts}], fps=0.0)).count() == 0


def test_runs_and_cofreeze(spark):
    state = [[float(x)] for x in (1, 1, 1, 2, 2, 3, 4, 4)]
    action = [[float(x)] for x in (1, 1, 2, 2, 3, 3, 3, 4)]
    f = make(spark, [{"state": state, "action": action}])
    r = one(sequence.stuck_runs(f))
    assert (r["n_runs"], r["median_run"], r["longest_run"], r["single_runs"]) == (3, 1.0, 2, 2)
    c = one(sequence.cofreeze(f))
    assert c["p_held"] == pytest.approx(4 / 7) and c["p_held_stuck"] == pytest.approx(1 / 4) and c["p_held_moving"] == 1.0


def test_registry_gives_schema_and_flags():
    assert list(report.FLAGS) == ["ts_nonmonotonic", "bad_dt", "frame_gaps", "stuck_state", "action_equals_state", "negative_lag", "large_lag", "duplicate_episodes"]
    assert len(report.RECORD) == 28
    with pytest.raises(ValueError):
        report.measure(report.MEASURES["frac_bad_dt"])


def test_stream_jitter_gate(spark):
    even = [(i, 2_000 * i) for i in range(600)]
    twice = [(2 * i + k, s) for i, s in even for k in (0, 1)]
    late = [(i, s + (40_000 if i > 300 else 0)) for i, s in even]
    few = even[:5]
    rows = [(n, *r) for n, rs in (("even", even), ("twice", twice), ("late", late), ("few", few)) for r in rs]
    got = {r["stream"]: r for r in jitter.stream_jitter(spark.createDataFrame(rows, "stream string, n long, us long"), ["stream"], "n", "us", 500.0).collect()}
    assert got["even"]["passed"] and got["twice"]["samples"] == 600 and got["twice"]["passed"]
    assert not got["late"]["passed"] and got["late"]["p50"] == 0 and not got["few"]["passed"] and got["few"]["p50"] is None
    want = np.percentile(np.abs(np.diff([s for _, s in late]) - 2_000), [50, 99, 99.9])
    assert [got["late"][c] for c in ("p50", "p99", "p999")] == pytest.approx(want.tolist())
