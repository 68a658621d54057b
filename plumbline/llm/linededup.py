"""Line dedup: levelled sorted runs of line hashes; each batch is merge-anti-joined with the runs and adds its own.

Documents are read in batches of descending doc_id. The runs hold every line hash met so far once, with the document
that keeps it. A batch's hashes that no run holds are new: the batch holds their largest doc_id, which becomes their
keeper, and they are added as a run of their own. When a level holds `fanout` runs they are merged into one run of the
next level, so a hash is rewritten at most once a level. How many documents hold a hash is tallied batch by batch.

Runs and tallies are bucketed by hash and sorted inside buckets, so that joins among them neither shuffle nor sort.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Scratch, maybe_in, unused

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: U+0020 and U+0009 to U+000D
_BLANK = " \t\n\x0b\x0c\r"
_RUN = ("h1", "h2")


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(_BLANK)), _UPPER, _UPPER.lower())


def key_hash(key: Column) -> list[Column]:
    """128 bits in two longs: the second hash has another seed."""
    return [F.xxhash64(key), F.xxhash64(F.lit(0x5EED), key)]


@contextmanager
def _sorted_buckets(spark: SparkSession):
    """While a plan is made and run, scans of buckets of one file each count as sorted."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """The store. Batches must come in descending order of doc_id, and no document may be in two of them."""

    def __init__(self, scratch: Scratch, fanout: int = 4):
        self.scratch, self.fanout = scratch, fanout
        self.buckets = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]
        self.tallies: list[DataFrame] = []

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        """A written table in sorted buckets. Its name is taken out of the catalogue at once; the files stay."""
        spark, table = self.scratch.spark, f"plumbline_{uuid.uuid4().hex}"
        path = self.scratch.path(f"{name}-{table[-8:]}")
        with _sorted_buckets(spark):
            dealt = df.repartition(self.buckets, *_RUN)
            dealt.write.format("parquet").bucketBy(self.buckets, *_RUN).sortBy(*_RUN).option("path", path).saveAsTable(table)
            out = spark.table(table)
        spark.sql(f"drop table {table}")
        out._scratch_path = path
        return out

    def _add(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._add(self._keep(reduce(DataFrame.unionAll, old), f"run-{level + 1}"), level + 1)
            self.scratch.drop(*old)

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def fresh(self, hashes: DataFrame) -> DataFrame:
        """Merge-anti-join: the rows whose hash no run holds."""
        return reduce(lambda left, run: left.join(run.select(*_RUN).hint("merge"), list(_RUN), "left_anti"), self.runs(), hashes)

    def admit(self, lines: DataFrame) -> None:
        """lines (doc_id, h1, h2), distinct, of one batch. The hashes that no run holds become a run."""
        own = self._keep(lines.groupBy(*_RUN).agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper")), "tally")
        self.tallies.append(own)
        self._add(self._keep(self.fresh(own).select(*_RUN, "keeper"), "run-0"), 0)

    def repeated(self, min_docs: int) -> DataFrame:
        """(h1, h2, keeper) of the hashes in at least min_docs documents, a written table."""
        with _sorted_buckets(self.scratch.spark):
            docs = reduce(DataFrame.unionAll, self.tallies).groupBy(*_RUN).agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
            return self.scratch.keep(docs.select(*_RUN).join(reduce(DataFrame.unionAll, self.runs()), list(_RUN)), "repeated")


def first_seen(batches, scratch: Scratch, min_chars: int = 40, fanout: int = 4):
    """Incremental form: yields for each batch of documents its lines (doc_id, h1, h2) that no earlier batch held."""
    store = LineRuns(scratch, fanout)
    for docs in batches:
        lines = scratch.keep(long_lines(docs, min_chars).select("doc_id", *_RUN).distinct(), "batch")
        yield scratch.keep(store.fresh(lines).select("doc_id", *_RUN), "new")
        store.admit(lines)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2) of every line whose key has at least min_chars code points."""
    # hashed and split before lines are rows, else each line would carry its text along
    parts = docs.select("doc_id", _text_hash().alias("text_hash"), F.split(F.coalesce("text", F.lit("")), "\n").alias("__lines"))
    keys = parts.select("doc_id", "text_hash", F.posexplode("__lines").alias("pos", "__line")).where(F.char_length("__line") >= min_chars)
    keys = keys.select("doc_id", "text_hash", "pos", line_key(F.col("__line")).alias("__key")).where(F.char_length("__key") >= min_chars)
    return keys.select("doc_id", "text_hash", "pos", *[c.alias(n) for c, n in zip(key_hash(F.col("__key")), _RUN)])


def drop_repeated_lines(docs: DataFrame, scratch: Scratch, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 4) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_lines, n_dropped, kept (the text that stays).

    A key of at least min_chars code points in at least min_docs documents loses its lines everywhere but in the
    largest doc_id that holds it. Null and empty texts are one empty line. Rows of equal doc_id are one document.
    Rows without a doc_id count for no key and lose every repeated line. An empty table gives no rows; other columns
    are ignored, whatever their names. A line that a third of all documents share meets itself only in partial
    aggregates and in a join that adaptive execution can split. Texts of documents that lose no line are not shuffled,
    and work on a text grows with its lines alone.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = scratch.keep(long_lines(docs, min_chars), "lines")
    store = LineRuns(scratch, fanout)
    # ranges of doc_id of about as many lines each, the largest first
    cuts = lines.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1_000)).first()[0] or []
    high = None
    for low in [*sorted(set(cuts), reverse=True), None]:
        inside = F.col("doc_id").isNotNull()
        inside = inside if low is None else inside & (F.col("doc_id") > low)
        store.admit(lines.where(inside if high is None else inside & (F.col("doc_id") <= high)).select("doc_id", *_RUN).distinct())
        high = low
    repeated = store.repeated(min_docs).hint("rebalance")  # a line of many can then be split
    drops = lines.join(repeated, list(_RUN)).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = drops.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.collect_list("pos").alias("drops"))
    drops = scratch.keep(drops, "drops")

    (maybe,) = unused(docs, "maybe")
    marked = maybe_in(docs, "doc_id", drops.where("id is not null"), "id", maybe)
    some = F.col(maybe) | F.col("doc_id").isNull()
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    untouched = marked.where(~some).select("doc_id", F.size(split).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.coalesce("text", F.lit("")).alias("kept"))
    joined = marked.where(some).withColumn("n", F.size(split))
    joined = joined.join(drops, F.col("doc_id").eqNullSafe(F.col("id")) & (_text_hash() == F.col("hash")), "left")
    # positions that stay are found by hash, and the lines are split once and then picked
    stay = F.array_except(F.sequence(F.lit(0), F.col("n") - 1), F.col("drops"))
    picked = F.transform(F.array(F.struct(split.alias("lines"), stay.alias("stay"))), lambda x: F.array_join(F.transform(x["stay"], lambda i: F.get(x["lines"], i)), "\n"))[0]
    touched = joined.select(
        "doc_id",
        F.col("n").cast("long").alias("n_lines"),
        F.when(F.col("drops").isNull(), F.lit(0)).otherwise(F.size(F.array_distinct("drops"))).cast("long").alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.coalesce("text", F.lit(""))).otherwise(picked).alias("kept"),
    )
    return untouched.unionAll(touched)
