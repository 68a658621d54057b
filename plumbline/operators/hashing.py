"""Content hashes of episodes, fingerprints of populations, and seeded samples by hash rank."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import rounded
from .frames import KEY
from .sequence import episode_window, ordered, stackable


def _text(v: Column) -> Column:
    return F.array_join(F.transform(rounded(v), lambda x: x.cast("string")), ",")


def episode_hashes(frames: DataFrame, head: int | None = None) -> DataFrame:
    """One row for each episode with a usable action: hash of its length and all action frames rounded to four places,
    or of its first `head` frames alone. Frames are hashed before they are gathered, so that an episode is gathered as
    one short string a frame."""
    w = episode_window()
    df = frames.where("episode is not null").withColumn("ok", F.col("has_action") & stackable("action", w)).where("ok")
    if head is not None:
        df = df.withColumn("nth", F.row_number().over(ordered())).where(F.col("nth") <= head)
    rows = df.select(*KEY, F.struct("pos", F.md5(_text(F.col("action"))).alias("h")).alias("x"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"]), "")
    length = F.lit("") if head is not None else F.count("*").cast("string")
    return rows.groupBy(*KEY).agg(F.md5(F.concat_ws(":", length, whole)).alias("hash"))


def duplicate_share(hashes: DataFrame, by: list[str], value: str = "hash") -> DataFrame:
    """1 - distinct / all; groups without a hash do not appear."""
    g = hashes.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(value).alias("kinds"))
    return g.select(*by, "n", "kinds", (1 - F.col("kinds") / F.col("n")).alias("dup_frac"))


@F.pandas_udf(T.StringType())
def _blake(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=16).hexdigest())


def hash_rank(ids: Column, seed: int, method: str = "blake2b") -> Column:
    text = F.concat(F.lit(f"{seed}:"), ids.cast("string"))
    return _blake(text) if method == "blake2b" else F.md5(text)


def sample(ids: DataFrame, column: str, size: int, seed: int, method: str = "blake2b") -> DataFrame:
    """The `size` distinct ids that come first by the hash of seed and id, with rank. It does not depend on the order
    of the population, larger samples contain smaller ones, and growth of the population displaces few."""
    ranked = ids.select(column).where(F.col(column).isNotNull()).distinct().withColumn("rank", hash_rank(F.col(column), seed, method))
    return ranked.orderBy("rank", column).limit(size)


#: Bytes of the one string that a fingerprint hashes: a population is a list of names, and a string ends at 2 GB.
LARGEST_POPULATION = 1 << 30


def fingerprint(ids: DataFrame, column: str) -> DataFrame:
    """One row: n, sha256 of the sorted distinct ids joined by line ends. The one string that is hashed grows with the
    ids, so a population of more than LARGEST_POPULATION bytes is an error, raised before anything is gathered."""
    text = F.col(column).cast("string")
    listed = ids.select(text.alias("id")).where("id is not null").distinct()
    size = listed.agg(F.sum(F.octet_length("id") + 1)).first()[0] or 0
    if size > LARGEST_POPULATION:
        raise ValueError(f"a population of {size} bytes of ids; a fingerprint takes {LARGEST_POPULATION}")
    return listed.selectExpr("count(*) as n", "sha2(coalesce(listagg(id, '\\n') within group (order by id), ''), 256) as sha256")


def first_rows(frames: DataFrame, n: int) -> DataFrame:
    return frames.withColumn("nth", F.row_number().over(Window.partitionBy(*KEY).orderBy("pos"))).where(F.col("nth") <= n)
