"""Exact and resampled comparisons of two arms, in NumPy inside Arrow functions: Spark has no built-in for them."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _log_choose(n: int) -> np.ndarray:
    logs = np.array([math.lgamma(k + 1) for k in range(n + 1)])
    return logs[n] - logs - logs[::-1]


def _wald(i: np.ndarray, j: np.ndarray, n: int, m: int) -> np.ndarray:
    pooled = (i + j) / (n + m)
    spread = np.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(spread > 0, (i / n - j / m) / spread, 0.0)


def _leading(n: int, m: int, bound: float, strict: bool = False) -> np.ndarray:
    """For each i of 0 to n, how many j of 0 to m have a statistic of at least (strict: above) the bound. The pooled Wald
    statistic falls as j grows, so these are the first ones, and halving finds their end."""
    i = np.arange(n + 1)
    lo, hi = np.zeros(n + 1, np.int64), np.full(n + 1, m + 1)
    for _ in range((m + 1).bit_length()):
        at = (lo + hi) // 2
        z = _wald(i, np.minimum(at, m), n, m)
        inside = (lo < hi) & ((z > bound) if strict else (z >= bound))
        lo, hi = np.where(inside, at + 1, lo), np.where(inside, hi, at)
    return lo


def _binomial(ways: np.ndarray, p: float) -> tuple[int, np.ndarray]:
    """The first count and the probabilities of it and those after it. By Hoeffding's bound what lies beyond sums to less
    than e^-749, below the smallest double."""
    n = len(ways) - 1
    half = math.sqrt(375 * n) + 1
    lo, hi = max(0, math.floor(n * p - half)), min(n, math.ceil(n * p + half))
    k = np.arange(lo, hi + 1)
    return lo, np.exp(ways[lo : hi + 1] + k * math.log(p) + (n - k) * math.log1p(-p))


def barnard(sa: int, na: int, sb: int, nb: int, alternative: str = "greater", margins: str = "outcomes", grid: int = 512) -> float:
    """Unconditional exact p-value with the pooled Wald statistic: the largest tail over the nuisance rate.

    margins="outcomes" takes the two binomials over the columns of the table [[successes, failures] of both arms],
    which is what a 2 x 2 table handed to the usual library routine means; "arms" takes them over the arms.

    A tail that holds the table without any success, or without any failure, has the limit 1 at a rate of 0 or 1.
    No table of all outcomes is made: each row's tail is a run of columns at either end, summed up by the other
    binomial's running totals. The rates tried are `grid` even ones, and as many or more that are even in the arcsine of
    their root, with steps of about 0.4 standard deviations of a rate so that large arms lose no peak.
    """
    if alternative not in ("greater", "less", "two-sided") or margins not in ("outcomes", "arms"):
        raise ValueError("unknown alternative or margins")
    if not (0 <= sa <= na and 0 <= sb <= nb):
        raise ValueError("successes must be between 0 and n")
    x, n, y, m = (sa, sa + sb, na - sa, na - sa + nb - sb) if margins == "outcomes" else (sa, na, sb, nb)
    if n == 0 or m == 0:
        return 1.0
    seen, slack = float(_wald(np.array(x), np.array(y), n, m)), 1e-12
    first, last = np.zeros(n + 1, np.int64), np.full(n + 1, m + 1)  # the tail of row i: j < first[i] and j >= last[i]
    if alternative == "greater":
        first = _leading(n, m, seen - slack)
    elif alternative == "less":
        last = _leading(n, m, seen + slack, strict=True)
    else:
        first = _leading(n, m, abs(seen) - slack)
        last = np.maximum(first, _leading(n, m, slack - abs(seen), strict=True))
    if first[0] > 0 or last[0] <= 0 or first[n] > m or last[n] <= m:
        return 1.0  # no successes or no failures at all: their chance nears 1 as the rate nears 0 or 1
    rows, columns = _log_choose(n), _log_choose(m)

    def probability(p: float) -> float:
        i, a = _binomial(rows, p)
        j, b = _binomial(columns, p)
        total = 0.0
        if alternative != "less":
            total += a @ np.append(0.0, np.cumsum(b))[np.clip(first[i : i + len(a)] - j, 0, len(b))]
        if alternative != "greater":
            total += a @ np.append(np.cumsum(b[::-1])[::-1], 0.0)[np.clip(last[i : i + len(a)] - j, 0, len(b))]
        return float(total)

    fine = max(grid, math.ceil(8 * math.sqrt(n + m)))
    points = np.union1d(np.linspace(0, 1, grid + 2)[1:-1], np.sin(np.linspace(0, math.pi / 2, fine + 2)[1:-1]) ** 2)
    values = [probability(p) for p in points.tolist()]
    k = int(np.argmax(values))
    lo, hi = float(points[max(0, k - 1)]), float(points[min(len(points) - 1, k + 1)])
    for _ in range(60):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (a, hi) if probability(a) < probability(b) else (lo, b)
    return min(1.0, max(max(values), probability((lo + hi) / 2)))


def barnard_column(sa: Column, na: Column, sb: Column, nb: Column, alternative: str = "greater", margins: str = "outcomes") -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([barnard(int(w), int(x), int(y), int(z), alternative, margins) for w, x, y, z in zip(a, b, c, d)])

    return run(sa, na, sb, nb)


def bootstrap_difference(a, b, alpha: float = 0.05, n_boot: int = 10_000, seed: int = 0, at_once: int = 1 << 22) -> tuple[float, float]:
    """Percentile interval of the difference of means; resamples of a are drawn before those of b, from one generator.
    Draws are made in slices, which give the same numbers as one large draw."""
    rng = np.random.default_rng(seed)

    def means(x):
        x = np.asarray(x, float)
        out, step = np.empty(n_boot), max(1, at_once // max(1, len(x)))
        for i in range(0, n_boot, step):
            out[i : i + step] = x[rng.integers(0, len(x), size=(min(step, n_boot - i), len(x)))].mean(axis=1)
        return out

    first = means(a)
    difference = first - means(b)
    return float(np.quantile(difference, alpha / 2)), float(np.quantile(difference, 1 - alpha / 2))


def bootstrap_pairs(trials: DataFrame, pair: str, side: str, order: str, outcome: str, alpha: float = 0.05, n_boot: int = 10_000, seed: int = 0) -> DataFrame:
    """trials with a pair key and a side ('a' or 'b') -> pair, n_a, n_b, lo, hi; null bounds where a side is empty.

    The draws depend on the order of the outcomes, so a pair's outcomes, one bit each, meet in one task. Meant for
    trials, of which there are thousands; where only the counts matter use the exact test.
    """
    schema = "pair string, n_a long, n_b long, lo double, hi double"

    def run(key: tuple[object, ...], df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("__order")
        a, b = (df.loc[df["__side"] == s, "__outcome"].to_numpy() for s in ("a", "b"))
        lo, hi = bootstrap_difference(a, b, alpha, n_boot, seed) if len(a) and len(b) else (None, None)
        return pd.DataFrame([(str(key[0]), len(a), len(b), lo, hi)], columns=["pair", "n_a", "n_b", "lo", "hi"])

    rows = trials.select(F.col(pair).cast("string").alias("__pair"), F.col(side).alias("__side"), F.col(order).alias("__order"), F.col(outcome).cast("double").alias("__outcome"))
    return rows.where("__outcome is not null").groupBy("__pair").applyInPandas(run, schema)
