"""Descriptive tables of survey records: counts, prevalence with intervals, order statistics, conditional shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import wilson
from .report import has_flag


def audited(records: DataFrame) -> DataFrame:
    """Records without an error: the denominator of every published share."""
    return records.where(F.coalesce(F.col("error"), F.lit("")) == "")


def share(df: DataFrame, condition: Column, by: list[str] = (), alpha: float = 0.05) -> DataFrame:
    """successes, n, rate, lo, hi by group. Rows for which the condition is null do not hold; without rows the rate and
    its bounds are null."""
    g = df.groupBy(*by).agg(F.count_if(F.coalesce(condition, F.lit(False))).alias("successes"), F.count(F.lit(1)).alias("n"))
    w = wilson(F.col("successes"), F.col("n"), alpha)
    return g.select(*by, "successes", "n", F.try_divide("successes", F.nullif("n", F.lit(0))).alias("rate"), w["lo"].alias("lo"), w["hi"].alias("hi"))


def prevalence(records: DataFrame, flag: str, alpha: float = 0.05) -> DataFrame:
    """Share of all records handed in that carry the flag."""
    return share(records, has_flag(F.col("flags"), flag), alpha=alpha)


def value_counts(df: DataFrame, column: str, absent: str = "(absent)", alpha: float = 0.05) -> DataFrame:
    """value, n, rate, lo, hi, most frequent first, ties by value. The total is a sum over the counted values."""
    text = F.col(column).cast("string")
    counted = df.groupBy(F.when(text.isNull() | (text == ""), F.lit(absent)).otherwise(text).alias("value")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    w = wilson(F.col("n"), F.col("total"), alpha)
    both = counted.crossJoin(F.broadcast(total))  # one row
    return both.select("value", "n", (F.col("n") / F.col("total")).alias("rate"), w["lo"].alias("lo"), w["hi"].alias("hi")).orderBy(F.desc("n"), "value")


def error_kinds(records: DataFrame) -> DataFrame:
    return value_counts(records.where("error <> ''").select(F.substring_index("error", ":", 1).alias("kind")), "kind")


def repeated(df: DataFrame, column: str) -> DataFrame:
    """One row: distinct values and how many of them occur more than once."""
    return df.groupBy(column).agg(F.count("*").alias("n")).agg(F.count("*").alias("kinds"), F.count_if(F.col("n") > 1).alias("repeated"))


def values_at(counted: DataFrame, by: list[str], places: dict[str, Column], parts: int = 32) -> DataFrame:
    """counted (by..., x, c), one row a distinct value -> by..., n, largest, and for each named place the value there in
    sorted order (0 is the smallest; a place is an expression of n).

    Groups are cut into parts by quantile sketches of their values, counts are summed by part, and a value is found by
    its count within its part. So no task sorts a whole group, and the sketch decides on the work alone, not on the result.
    """
    bounds = F.percentile_approx("x", [i / parts for i in range(1, parts)], parts * 10)
    cuts = counted.groupBy(*by).agg(bounds.alias("cuts"), F.sum("c").alias("n"), F.max("x").alias("largest"))
    key = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    cuts = cuts.select(*[F.col(c).alias(f"__{c}") for c in by], "cuts", "n", "largest")
    at = counted.join(F.broadcast(cuts), reduce(lambda a, x: a & x, key)) if by else counted.crossJoin(F.broadcast(cuts))  # one row
    at = at.withColumn("part", F.size(F.filter("cuts", lambda q: q < F.col("x")))).drop("cuts", *[f"__{c}" for c in by])
    sums = at.groupBy(*by, "part").agg(F.sum("c").alias("s"))
    before = F.sum("s").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("before", F.coalesce(before, F.lit(0))).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("part").alias("__part"), "before")
    both = at.join(F.broadcast(sums), reduce(lambda a, x: a & x, key, F.col("part") == F.col("__part")))  # at most `parts` rows a group
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(*by, "part").orderBy("x"))
    both = both.withColumn("upto", upto)
    picks = [F.min(F.when(F.col("upto") > place, F.col("x"))).alias(name) for name, place in places.items()]
    return both.groupBy(*by).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *picks, F.max("largest").alias("largest"))


def order_statistics(df: DataFrame, column: str, shares: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """One row: for each share p the value at place min(n - 1, int(p n)) of the sorted values, not interpolated, and
    the largest. Equal values are counted first."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count("*").alias("c"))
    places = {f"p{p * 100:g}".replace(".", "_"): F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n"))) for p in shares}
    return values_at(counted, [], places)


def conditional(left: DataFrame, right: DataFrame, on: str, given: Column, then: Column, alpha: float = 0.05) -> DataFrame:
    """Share of rows with `then` among the joined rows with `given`."""
    return share(left.join(right, on).where(given), then, alpha=alpha)
