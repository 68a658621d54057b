"""Intervals, sequences, exact tests and descriptive tables against vectors and plain versions."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import exact, sequential, vectors
from plumbline.functions.intervals import trials_needed, two_sided, wilson
from plumbline.operators import describe, hashing


def row(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


@pytest.mark.parametrize("s, n, lo, hi", [(18, 20, 0.699, 0.972), (229, 353, 0.5976, 0.6967), (12, 353, 0.0195, 0.0585), (0, 353, 0, 0.0108), (187, 353, 0.4776, 0.5812)])
def test_wilson_vectors(spark, s, n, lo, hi):
    r = row(spark, w=wilson(F.lit(s), F.lit(n)))["w"]
    assert (r["lo"], r["hi"]) == pytest.approx((lo, hi), abs=6e-4)


def test_wilson_of_the_impossible_is_null(spark):
    for s, n in ((1, 0), (5, 4), (-1, 4), (None, 4)):
        assert row(spark, w=wilson(F.lit(s).cast("int"), F.lit(n)))["w"] is None


def test_trials_needed_vectors(spark):
    for a, b, want in ((0.9, 0.7, 49), (0.9, 0.8, 157), (0.9, 0.85, 540), (0.5, 0.5, None), (1.0, 0.5, None)):
        assert row(spark, t=trials_needed(F.lit(a), F.lit(b)))["t"] == want
    assert round(two_sided(0.05), 3) == 1.96


def test_log_gamma(spark):
    xs = [0.3, 1.0, 2.0, 7.5, 40.0, 1e4, 1e7]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", sequential.log_gamma(F.col("x")).alias("g")).collect()
    for r in got:
        assert r["g"] == pytest.approx(math.lgamma(r["x"]), rel=1e-12, abs=1e-11)


def cs(spark, s, t, alpha=0.05):
    df = spark.createDataFrame([(s, t)], "s long, t long")
    r = df.select(sequential.confidence_sequence(F.col("s"), F.col("t"), alpha).alias("c")).first()["c"]
    return r["lo"], r["hi"]


def test_confidence_sequence_vectors(spark):
    assert cs(spark, 17, 20) == pytest.approx((0.529500, 0.985999), abs=1e-6)
    assert cs(spark, 0, 0) == (0.0, 1.0)
    assert cs(spark, 29, 30, 0.025) == pytest.approx((0.728, 0.9995), abs=1e-3) and cs(spark, 8, 30, 0.025) == pytest.approx((0.072, 0.560), abs=1e-3)


def test_compare_and_running(spark):
    pairs = spark.createDataFrame([(29, 30, 8, 30), (2, 4, 2, 4), (8, 30, 29, 30), (0, 0, 3, 4)], "sa long, ta long, sb long, tb long")
    assert [r["decision"] for r in sequential.compare(pairs).collect()] == ["A>B", "continue", "B>A", "continue"]
    assert sequential.compare(pairs).collect()[3]["rate_a"] is None
    trials = spark.createDataFrame([("x", i, i % 2) for i in range(12)], "arm string, n long, y int")
    last = sequential.running(trials, "arm", "n", "y").orderBy(F.desc("n")).first()
    assert (last["lo"], last["hi"]) == cs(spark, 6, 12)


def test_sequence_covers_at_every_time(spark):
    """150 runs of 40 trials at 0.7: the true rate is missed at some time in few of them."""
    rng = np.random.default_rng(3)
    rows = [(str(r), i, int(y)) for r in range(150) for i, y in enumerate(rng.random(40) < 0.7)]
    run = sequential.running(spark.createDataFrame(rows, "arm string, n long, y int"), "arm", "n", "y")
    assert run.where("lo > 0.7 or hi < 0.7").select("arm").distinct().count() / 150 <= 0.08


def plain_barnard(x, n, y, m):
    best, wald = 0.0, {}
    for i, j in itertools.product(range(n + 1), range(m + 1)):
        p = (i + j) / (n + m)
        sd = math.sqrt(p * (1 - p) * (1 / n + 1 / m))
        wald[i, j] = (i / n - j / m) / sd if sd else 0.0
    for p in np.linspace(0.0005, 0.9995, 2000):
        best = max(best, sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) * math.comb(m, j) * p**j * (1 - p) ** (m - j) for (i, j), w in wald.items() if w >= wald[x, y] - 1e-12))
    return best


def test_barnard():
    assert exact.barnard(17, 20, 10, 20) < 0.05
    assert exact.barnard(7, 8, 3, 9, margins="arms") == pytest.approx(plain_barnard(7, 8, 3, 9), abs=1e-5)
    assert exact.barnard(7, 8, 3, 9) == pytest.approx(plain_barnard(7, 10, 1, 7), abs=1e-5)
    assert exact.barnard(5, 10, 5, 10, "two-sided", "arms") == pytest.approx(1.0)
    with pytest.raises(ValueError):
        exact.barnard(5, 4, 1, 2)


@pytest.mark.parametrize("alternative", ["greater", "less", "two-sided"])
def test_barnard_is_the_largest_tail_of_all_outcomes(alternative):
    inside = {"greater": lambda w, s: w >= s - 1e-12, "less": lambda w, s: w <= s + 1e-12, "two-sided": lambda w, s: abs(w) >= abs(s) - 1e-12}[alternative]
    for sa, n, sb, m in ((9, 12, 3, 7), (0, 5, 6, 6), (4, 30, 1, 3), (2, 2, 0, 9), (3, 9, 2, 6)):
        pooled = {(i, j): (i + j) / (n + m) for i in range(n + 1) for j in range(m + 1)}
        wald = {(i, j): (i / n - j / m) / math.sqrt(p * (1 - p) * (1 / n + 1 / m)) if 0 < p < 1 else 0.0 for (i, j), p in pooled.items()}
        tail = [k for k, w in wald.items() if inside(w, wald[sa, sb])]
        want = max(sum(math.comb(n, i) * math.comb(m, j) * p ** (i + j) * (1 - p) ** (n + m - i - j) for i, j in tail) for p in np.sin(np.linspace(0, math.pi / 2, 2001)) ** 2)
        assert exact.barnard(sa, n, sb, m, alternative, "arms") == pytest.approx(want, abs=2e-5)


def test_barnard_of_large_arms(spark):
    """Tables of all outcomes would have 4e9 cells; at this size the tail is near that of the normal law."""
    arms = (54_000, 60_000, 62_500, 70_000)
    z = (54 / 60 - 62.5 / 70) / math.sqrt((116.5 / 130) * (13.5 / 130) * (1 / 60_000 + 1 / 70_000))
    rows = spark.createDataFrame([arms], "sa long, na long, sb long, nb long")
    got = rows.select(exact.barnard_column(*map(F.col, rows.columns), margins="arms").alias("one"), exact.barnard_column(*map(F.col, rows.columns), alternative="two-sided", margins="arms").alias("two")).first()
    assert got["two"] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=0.1)
    assert got["one"] >= math.erfc(z / math.sqrt(2)) / 2 * 0.999
    # rare successes: the peak is at rates that an even grid of 512 steps over, where one success of the small arm suffices
    assert exact.barnard(1, 20, 0, 20_000, margins="arms") == pytest.approx(max(20 * q * (1 - q) ** 20_019 for q in (1 / 20_020,)), rel=0.05)


def test_bootstrap_draws_are_those_of_one_generator(spark):
    rng = np.random.default_rng(1)
    a, b = (rng.random(41) < 0.85).astype(int), (rng.random(37) < 0.55).astype(int)
    g = np.random.default_rng(0)
    ia, ib = g.integers(0, 41, size=(10_000, 41)), g.integers(0, 37, size=(10_000, 37))
    d = a[ia].mean(1) - b[ib].mean(1)
    want = (float(np.quantile(d, 0.025)), float(np.quantile(d, 0.975)))
    assert exact.bootstrap_difference(a, b) == want == exact.bootstrap_difference(a, b, at_once=999)
    rows = [("p", s, i, int(y)) for s, ys in (("a", a), ("b", b)) for i, y in enumerate(ys)]
    r = exact.bootstrap_pairs(spark.createDataFrame(rows, "pair string, side string, n long, y int"), "pair", "side", "n", "y").first()
    assert (r["lo"], r["hi"], r["n_a"], r["n_b"]) == (*want, 41, 37)


def test_descriptions(spark):
    records = spark.createDataFrame([("a", "x|y", ""), ("b", "y", ""), ("c", "", ""), ("d", "xx", ""), ("e", "x", "RateLimited: no"), ("f", "", "ValueError: v")], "repo string, flags string, error string")
    p = describe.prevalence(describe.audited(records), "x").first()
    assert (p["successes"], p["n"], p["rate"]) == (1, 4, 0.25) and p["lo"] < 0.25 < p["hi"]
    none = describe.prevalence(records.limit(0), "x").first()
    assert none["rate"] is None and none["lo"] is None
    assert [(r["value"], r["n"]) for r in describe.value_counts(records, "flags").collect()] == [("(absent)", 2), ("x", 1), ("xx", 1), ("x|y", 1), ("y", 1)]
    assert {r["value"] for r in describe.error_kinds(records).collect()} == {"RateLimited", "ValueError"}
    assert tuple(describe.repeated(records, "flags").first()) == (5, 1)


@pytest.mark.parametrize("n", [1, 2, 9, 10, 25])
def test_order_statistics_take_the_upper_place(spark, n):
    xs = sorted((i * 7) % 13 for i in range(n))
    r = describe.order_statistics(spark.createDataFrame([(x,) for x in xs], "x long"), "x").first()
    assert (r["p50"], r["p90"], r["largest"], r["n"]) == (xs[min(n - 1, int(0.5 * n))], xs[min(n - 1, int(0.9 * n))], xs[-1], n)


def test_samples_are_nested_and_hashed_as_documented(spark):
    import hashlib

    ids = spark.createDataFrame([(f"org/d{i}",) for i in range(300)] + [("org/d1",), (None,)], "id string")
    rank = lambda x, seed: hashlib.blake2b(f"{seed}:{x}".encode(), digest_size=16).hexdigest()
    want = sorted((f"org/d{i}" for i in range(300)), key=lambda x: rank(x, 5))
    assert [r["id"] for r in hashing.sample(ids, "id", 40, 5).orderBy("rank").collect()] == want[:40]
    assert hashing.sample(ids, "id", 1_000, 5).count() == 300
    grown = ids.unionAll(spark.createDataFrame([(f"new/{i}",) for i in range(60)], "id string"))
    kept = {r["id"] for r in hashing.sample(ids, "id", 200, 5).collect()} & {r["id"] for r in hashing.sample(grown, "id", 200, 5).collect()}
    assert len(kept) >= 150


def test_fingerprint_knows_members_not_order(spark):
    import hashlib

    a = spark.createDataFrame([("b",), ("a",), ("é",), ("a",)], "id string")
    want = hashlib.sha256("\n".join(sorted({"a", "b", "é"})).encode()).hexdigest()
    assert tuple(hashing.fingerprint(a, "id").first()) == (3, want) == tuple(hashing.fingerprint(a.orderBy("id"), "id").first())
    assert hashing.fingerprint(a.where("id <> 'b'"), "id").first()["sha256"] != want


def test_clamp_norm_clip(spark):
    r = row(spark, c=vectors.clamp_step(F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(5.0), F.lit(0.95)), 0.1), n=vectors.norm(F.array(F.lit(3.0), F.lit(4.0), F.lit(0.0), F.lit(9.0))), u=vectors.clip_unit(F.lit(-2.0)))
    assert r["c"] == pytest.approx([0.1, 0.95]) and r["n"] == 5.0 and r["u"] == 0.0
