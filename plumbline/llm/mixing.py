"""Mixing sources to target weights: water-filled targets, certain whole copies, then Pareto order sampling.

Each document has an expected number of copies, unequal within a source, with which the source meets its target. The
whole part of it is taken for certain. The rest is the probability with which the document is in a sample without
replacement of fixed size in words: documents rank by their random odds over their own inclusion odds, and those that
come first are taken while they fit. What is then missing, less than the next document, is filled by four documents at
most: the largest that fits, three times, and one whose size is nearest to what is missing after them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import Scratch

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: Columns of the documents that close a source's sample: all but the last must fit.
CLOSING = ["__close1", "__close2", "__close3", "__close4"]


def _targets(sources: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """sources (source, source_size), one row a source -> with target. The windows have no key: they see one row a
    source, never documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = sources.withColumn("place", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("total", F.sum("source_size").over(every).cast("double"))
    # the least cap for its weight is reached first; a source is capped if the level that is left would exceed its cap
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    s = s.withColumn("level", F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(every)["level"])
    return s.select("source", "source_size", F.when(F.col("capped") | F.col("level").isNull(), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def _words():
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _uid(seed: int):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))


def _tilt(size):
    """Relative number of copies of a document of that size: its fourth root is what it loses, so that a mix has more
    documents for its words and no long one stands for its source."""
    return 1 / F.sqrt(F.sqrt(size))


def _expected(most: float):
    """Copies that a document of __size words of a source with __rate is to have, as a mean over draws."""
    return F.when(F.col("__size") > 0, F.least(F.lit(float(most)), F.col("__rate") * _tilt(F.col("__size")))).otherwise(F.lit(0.0))


def _drawn(rows: DataFrame, most: float) -> DataFrame:
    """Adds __whole, the certain copies, __rank, the random odds over the inclusion odds (null where there is nothing to
    draw), and __at, the rank's place between 0 and 1."""
    rows = rows.withColumn("__e", _expected(most)).withColumn("__whole", F.floor("__e")).withColumn("__part", F.col("__e") - F.col("__whole"))
    u = (F.conv(F.substring("__uid", 1, 13), 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    rank = F.when(F.col("__part") > 0, u / (1 - u) / (F.col("__part") / (1 - F.col("__part"))))
    return rows.withColumn("__rank", rank).withColumn("__at", F.col("__rank") / (1 + F.col("__rank"))).drop("__e", "__part")


def _with_plan(rows: DataFrame, plan: DataFrame, few: int, salts: int = 64) -> DataFrame:
    """Joins rows to their source's row. Up to `few` sources are broadcast, after counting them; more are joined with
    salt, so that a source with a third of all rows is spread."""
    if plan.count() <= few:
        return rows.join(F.broadcast(plan), F.col("__source").eqNullSafe(F.col("__of")))
    salted = plan.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(salted, F.col("__source").eqNullSafe(F.col("__of")) & (F.pmod(F.xxhash64("__uid"), F.lit(salts)) == F.col("__salt"))).drop("__salt")


def _rates(by_size: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """by_size (__source, __size, n), targets (source, source_size, target) -> __of, source_size, target, __rate, __need.

    The rate is that at which the expected copies of all documents, none above `most`, have the target's words; __need
    is what of them is not certain. A window sees the different sizes of a source, of which there are no more than the
    root of twice its words.
    """
    rows = by_size.where("__size > 0").join(targets.withColumnRenamed("source", "__of"), F.col("__source").eqNullSafe(F.col("__of")))
    words, tilt = F.col("__size") * F.col("n"), _tilt(F.col("__size"))
    order = Window.partitionBy("__of").orderBy("__size")
    before = F.coalesce(F.sum(words).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * F.lit(float(most))
    rate = (F.col("target") - before) / F.sum(tilt * words).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # documents that the rate would give more than `most` copies have just that, from the smallest size on
    rows = rows.withColumn("__r", rate).withColumn("__free", F.col("__r") * tilt < F.lit(float(most)))
    found = rows.groupBy("__of").agg(F.coalesce(F.min(F.when(F.col("__free"), F.struct("__size", "__r")))["__r"], F.lit(float("inf"))).alias("__rate"))
    again = rows.drop("__r", "__free").join(found.withColumnRenamed("__of", "__o"), F.col("__of").eqNullSafe(F.col("__o"))).drop("__o")
    certain = again.groupBy("__of").agg(F.sum(F.floor(_expected(most)) * words).alias("c"), F.first("__rate").alias("__rate"))
    out = targets.withColumnRenamed("source", "__of").join(certain.withColumnRenamed("__of", "__o"), F.col("__of").eqNullSafe(F.col("__o")), "left").drop("__o")
    return out.select("__of", "source_size", "target", F.coalesce("__rate", F.lit(0.0)).alias("__rate"), (F.col("target") - F.coalesce("c", F.lit(0))).alias("__need"))


def _stops(sizes: DataFrame, s: DataFrame, most: float, scratch: Scratch, bins: int, small: int, few: int) -> DataFrame:
    """Adds to the sources where their sample ends: all with __at below __low are taken, and then ranks up to __cut;
    __need becomes what is then missing.

    Words are summed by bin of __at; the bin in which a source's sample ends is divided again until it has few documents,
    and only those are sorted.
    """
    s = s.withColumn("__low", F.lit(0.0)).withColumn("__high", F.lit(1.0)).withColumn("__got", F.lit(0).cast("long"))
    s = s.withColumn("__low", F.when(F.col("__need") < 0.5, F.lit(0.0)).otherwise(F.col("__low"))).withColumn("__high", F.when(F.col("__need") < 0.5, F.lit(0.0)).otherwise(F.col("__high")))
    inside = (F.col("__at") >= F.col("__low")) & (F.col("__at") < F.col("__high"))
    for _ in range(4):  # 4,096 bins four times over are as fine as the numbers
        step = (F.col("__high") - F.col("__low")) / bins
        rows = _drawn(_with_plan(sizes, s, few), most).where(inside)
        rows = rows.withColumn("__bin", F.least(F.floor((F.col("__at") - F.col("__low")) / step), F.lit(bins - 1)))
        sums = rows.groupBy("__of", "__bin").agg(F.sum("__size").alias("words"), F.count("*").alias("n"), F.min("__at").alias("first"), F.max("__at").alias("last"), F.first("__need").alias("__need"), F.first("__got").alias("__got"))
        sums = sums.withColumn("upto", F.col("__got") + F.sum("words").over(Window.partitionBy("__of").orderBy("__bin")))
        over = F.when(F.col("upto") > F.col("__need"), F.struct("__bin", (F.col("upto") - F.col("words")).alias("got"), "n", "first", "last"))
        ends = sums.groupBy(F.col("__of").alias("__ends")).agg(F.min(over).alias("x"), F.max("upto").alias("all"))
        s = s.join(ends, F.col("__of").eqNullSafe(F.col("__ends")), "left").drop("__ends")
        # where all that is left fits, nothing is above the end; the bin's own first and last places are its bounds
        done = F.col("x").isNull()
        s = s.select(
            *[c for c in s.columns if c not in ("__low", "__high", "__got", "x", "all")],
            F.when(done, F.col("__high")).otherwise(F.col("x.first")).alias("__low"),
            F.when(done, F.col("__high")).otherwise(F.col("x.last") * (1 + 1e-15) + 1e-300).alias("__high"),
            F.coalesce("x.got", "all", "__got").alias("__got"),
            F.when(done, 0).otherwise(F.col("x.n")).alias("__n"),
        )
        s = scratch.keep(s, "ends")
        if (s.agg(F.max("__n")).first()[0] or 0) <= small:
            break
        s = s.drop("__n")
    s = s.drop("__n")
    # equal ids with equal texts share a rank and so their fate
    edge = _drawn(_with_plan(sizes, s, few), most).where(inside).groupBy("__of", "__rank", "__need", "__got").agg(F.sum("__size").alias("words"))
    edge = edge.withColumn("sofar", F.col("__got") + F.sum("words").over(Window.partitionBy("__of").orderBy("__rank")))
    cut = edge.where("sofar <= __need").groupBy(F.col("__of").alias("__ends")).agg(F.max("__rank").alias("__cut"), F.max("sofar").alias("__more"))
    s = s.join(cut, F.col("__of").eqNullSafe(F.col("__ends")), "left").drop("__ends")
    s = s.withColumn("__cut", F.coalesce("__cut", F.lit(-1.0))).withColumn("__need", F.col("__need") - F.coalesce("__more", "__got"))
    return scratch.keep(s.drop("__high", "__got", "__more"), "stops")


def _sampled():
    return F.coalesce((F.col("__at") < F.col("__low")) | (F.col("__rank") <= F.col("__cut")), F.lit(False))


def _closing(sizes: DataFrame, s: DataFrame, most: float, scratch: Scratch, few: int, name: str, others: list[str], fits) -> DataFrame:
    """Adds to the sources the document that comes nearest to what is missing, of those that are not taken."""
    rest = _drawn(_with_plan(sizes, s, few), most).where(F.col("__rank").isNotNull() & ~_sampled())
    for o in others:
        rest = rest.where(~F.col("__uid").eqNullSafe(F.col(o)))
    off = F.abs(F.col("__need") - F.col("__size"))
    last = rest.where(fits & (off < F.col("__need"))).groupBy(F.col("__of").alias("__ends")).agg(F.min(F.struct(off.alias("off"), "__rank", "__uid", "__size")).alias("x"))
    s = s.join(last, F.col("__of").eqNullSafe(F.col("__ends")), "left").drop("__ends")
    s = s.withColumn("__need", F.col("__need") - F.coalesce("x.__size", F.lit(0))).withColumn(name, F.col("x.__uid"))
    return scratch.keep(s.drop("x"), "closing")


def mix_plan(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...], most: float, seed: int, bins: int, small: int, few: int) -> tuple[DataFrame, DataFrame]:
    """The sizes of all documents, and for each source the rate of copies and which ranks its sample has."""
    sizes = scratch.keep(docs.select("doc_id", F.col("source").alias("__source"), _words().alias("__size"), _uid(seed).alias("__uid")), "sizes")
    by_size = scratch.keep(sizes.groupBy("__source", "__size").agg(F.count("*").alias("n")), "by-size")
    targets = _targets(by_size.groupBy(F.col("__source").alias("source")).agg(F.sum(F.col("__size") * F.col("n")).alias("source_size")), weights, most)
    s = scratch.keep(_rates(by_size, scratch.keep(targets, "targets"), most), "rates")
    s = _stops(sizes, s, most, scratch, bins, small, few)
    for i, name in enumerate(CLOSING):
        s = _closing(sizes, s, most, scratch, few, name, CLOSING[:i], F.lit(True) if name == CLOSING[-1] else F.col("__size") <= F.col("__need"))
    return sizes, s


def _copies():
    extra = reduce(lambda a, c: a | F.coalesce(F.col("__uid") == F.col(c), F.lit(False)), CLOSING, _sampled())
    return (F.col("__whole") + (extra & F.col("__rank").isNotNull()).cast("int")).cast("long")


def mix(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0, seed: int = 17, bins: int = 4096, small: int = 1_000, few: int = 50_000) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, size, source_size, target, copies, taken.

    size counts the words of the whole text (null: 0). A document's expected copies fall with the fourth root of its
    size, none above `most`; the whole part is certain, the rest is its inclusion probability. Reruns agree: ranks come
    from a hash of seed, id and text. Rows that are equal in id and text share their fate; a closing document that
    occurs several times is counted once and taken each time. A null source is a source of its own, the last. Empty
    documents and sources of size 0 take nothing. An empty table gives no rows; other columns are ignored, whatever
    their names.

    No source meets in one task: words are summed by (source, bin of the rank), so that a prefix sum over bins finds
    the one bin in which the sample ends, which is divided again until only a few documents are to be sorted.
    """
    sizes, plan = mix_plan(docs, scratch, weights, most, seed, bins, small, few)
    out = _drawn(_with_plan(sizes, plan, few), most).withColumn("copies", _copies())
    return out.select("doc_id", F.col("__size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("__size")).alias("taken"))


def apply_mix(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0, seed: int = 17, bins: int = 4096, small: int = 1_000, few: int = 50_000) -> DataFrame:
    """The documents themselves, each as often as mix() says, without a shuffle of texts; all columns stay as they are,
    whatever their names. Odd rows count as there; documents that take nothing go."""
    _, plan = mix_plan(docs, scratch, weights, most, seed, bins, small, few)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("source").alias("__source"), _uid(seed).alias("__uid"), _words().alias("__size"))
    rows = _drawn(_with_plan(rows, plan.drop("source_size", "target", "__need"), few), most).withColumn("__copies", _copies()).where("__copies > 0")
    return rows.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select("__row.*")
