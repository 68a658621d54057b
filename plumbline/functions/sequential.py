"""Anytime-valid statistics: a confidence sequence from successes s and trials t, which is all that it depends on.

So trials are aggregated first, and the grid is only laid over one row for each arm (or each prefix).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series, after moving the argument up by ten. Error below 1e-12 of the result."""
    moved = x + 10
    inverse = 1 / moved
    square = inverse * inverse
    series = inverse * (F.lit(1 / 12) - square * (F.lit(1 / 360) - square * (F.lit(1 / 1260) - square * F.lit(1 / 1680))))
    product = x
    for k in range(1, 10):
        product = product * (x + k)
    return (moved - 0.5) * F.ln(moved) - moved + F.lit(0.5 * math.log(2 * math.pi)) + series - F.ln(product)


def log_beta(a: Column, b: Column) -> Column:
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def confidence_sequence(s: Column, t: Column, alpha: float = 0.05, prior: tuple[float, float] = (1.0, 1.0), grid: int = 2001) -> Column:
    """struct(lo, hi): the first and last rate of a grid that the beta-binomial mixture does not rule out; (0, 1)
    without trials. s and t must be columns of the row.

    The mixture is convex in the rate with its lowest point at s / t, so the rates that stay are neighbours: both ends
    are found by halving from the grid points around s / t, in a few steps instead of one for each point.
    """
    a, b = prior
    low, high = 1e-6, 1 - 1e-6
    width, limit = (high - low) / (grid - 1), F.lit(math.log(1 / alpha))
    s, t = s.cast("double"), t.cast("double")
    start = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    mixture = log_beta(s + a, t - s + b) - F.lit(start)
    steps = F.sequence(F.lit(1), F.lit(max(1, (grid + 1).bit_length())))

    def rate(i: Column) -> Column:
        return F.lit(low) + i * F.lit(width)

    def search(m: Column) -> Column:
        def stays(i: Column) -> Column:
            p = rate(i)
            return m - (s * F.ln(p) + (t - s) * F.log1p(-p)) < limit

        def halve(begin: Column, left: bool) -> Column:
            def step(acc: Column, _: Column) -> Column:
                mid = F.shiftright(acc["l"] + acc["h"], 1)
                done = acc["h"] - acc["l"] <= 1
                inward = stays(F.greatest(mid, F.lit(0)))
                down, up = (inward, ~inward) if left else (~inward, inward)
                return F.struct(F.when(done | down, acc["l"]).otherwise(mid).alias("l"), F.when(done | up, acc["h"]).otherwise(mid).alias("h"))

            outer = F.struct(F.lit(-1).alias("l"), begin.alias("h")) if left else F.struct(begin.alias("l"), F.lit(grid).alias("h"))
            return F.aggregate(steps, outer, step)["h" if left else "l"]

        at = F.greatest(F.lit(0.0), F.least((s / t - F.lit(low)) / F.lit(width), F.lit(float(grid - 1))))
        under, over = F.floor(at).cast("int"), F.ceil(at).cast("int")
        first, last = F.when(stays(under), under).when(stays(over), over), F.when(stays(over), over).when(stays(under), under)
        ends = F.transform(F.array(F.struct(first.alias("a"), last.alias("b"))), lambda x: F.when(x["a"].isNotNull(), F.struct(rate(halve(x["a"], True)).alias("lo"), rate(halve(x["b"], False)).alias("hi"))))
        return ends[0]

    everything = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    # worked out once and handed to the search through a one-element array
    return F.when(t > 0, F.coalesce(F.transform(F.array(mixture), search)[0], everything)).otherwise(everything)


def arms(trials: DataFrame, arm: str, outcome: str) -> DataFrame:
    """One row an arm: s, t."""
    return trials.groupBy(arm).agg(F.sum(F.col(outcome).cast("long")).alias("s"), F.count(outcome).alias("t"))


def sequences(trials: DataFrame, arm: str, outcome: str, alpha: float = 0.05) -> DataFrame:
    got = arms(trials, arm, outcome).withColumn("cs", confidence_sequence(F.col("s"), F.col("t"), alpha))
    return got.select(arm, "s", "t", F.col("cs.lo").alias("lo"), F.col("cs.hi").alias("hi"))


def running(trials: DataFrame, arm: str, order: str, outcome: str, alpha: float = 0.05) -> DataFrame:
    """The sequence after every trial. Prefixes with equal counts share one evaluation."""
    w = Window.partitionBy(arm).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = trials.select(arm, order, F.sum(F.col(outcome).cast("long")).over(w).alias("s"), F.count(outcome).over(w).alias("t"))
    known = steps.select("s", "t").distinct().withColumn("cs", confidence_sequence(F.col("s"), F.col("t"), alpha))
    return steps.join(known, ["s", "t"]).select(arm, order, "s", "t", F.col("cs.lo").alias("lo"), F.col("cs.hi").alias("hi"))


def compare(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """pairs (sa, ta, sb, tb, any others) -> with rates, both sequences at half of alpha and the decision, which is
    only taken when they are strictly apart. The rate of an empty arm is null."""
    half = alpha / 2
    got = pairs.withColumn("cs_a", confidence_sequence(F.col("sa"), F.col("ta"), half)).withColumn("cs_b", confidence_sequence(F.col("sb"), F.col("tb"), half))
    apart = F.when(F.col("cs_a.lo") > F.col("cs_b.hi"), "A>B").when(F.col("cs_b.lo") > F.col("cs_a.hi"), "B>A").otherwise("continue")
    rate = lambda s, t: F.when(F.col(t) > 0, F.col(s) / F.col(t))
    return got.withColumn("rate_a", rate("sa", "ta")).withColumn("rate_b", rate("sb", "tb")).withColumn("decision", apart)
