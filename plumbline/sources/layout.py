"""Where a dataset's files are, from its metadata alone: expressions over rows of info (data_path, chunks_size,
total_episodes, num_shards), so a million datasets are enumerated as one table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def layout_family(template: Column) -> Column:
    """per_episode, packed, sharded, or null for a template of no known kind."""
    has = lambda *names: F.coalesce(_all(template, names), F.lit(False))
    return F.when(has("episode_index", "episode_chunk"), "per_episode").when(has("file_index", "chunk_index"), "packed").when(has("shard_id", "num_shards"), "sharded")


def _all(template: Column, names) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & template.contains(n)
    return out


def file_count(family: Column, total_episodes: Column, num_shards: Column) -> Column:
    """Null where the metadata cannot tell."""
    return F.when(family == "per_episode", F.coalesce(total_episodes, F.lit(0)).cast("long")).when(family == "sharded", num_shards.cast("long"))


def _filled(template: Column, values: dict[str, Column], widest: int = 12) -> Column:
    """The template with {name} and {name:0Nd} replaced."""
    out = template
    for name, value in values.items():
        digits = F.regexp_extract(template, r"\{" + name + r":0(\d+)d\}", 1)
        text = F.coalesce(value.cast("string"), F.lit("0"))  # a name without a value is in no template that is filled
        padded = F.when((digits != "") & (F.length(text) < digits.try_cast("int")), F.lpad(text, F.coalesce(digits.try_cast("int"), F.lit(widest)), "0")).otherwise(text)
        out = F.regexp_replace(out, F.lit(r"\{" + name + r"(?::0?\d*d)?\}"), padded)
    return out


def derive_paths(infos: DataFrame, limit: int | None = None, listing: DataFrame | None = None, keep: list[str] = ("dataset",)) -> DataFrame:
    """infos (dataset, data_path, chunks_size, total_episodes, num_shards) -> dataset, place, path.

    per_episode and sharded counts come from the metadata. A packed dataset gives its first `limit` files; without a
    limit the one file that is known to be there, or, with a listing (dataset, path) of what exists, all files up to
    the first gap. Unknown layouts and sharded ones without num_shards give no path.
    """
    family = layout_family(F.col("data_path"))
    df = infos.withColumn("family", family).withColumn("chunk", F.coalesce(F.nullif("chunks_size", F.lit(0)), F.lit(1000)).cast("long"))
    known = file_count(F.col("family"), F.col("total_episodes"), F.col("num_shards"))
    probe = limit is None and listing is not None
    n = F.when(F.col("family") == "packed", F.lit(1 if limit is None else limit).cast("long")).otherwise(known if limit is None else F.least(known, F.lit(limit).cast("long")))
    counted = df.withColumn("n", n)
    if probe:
        counted = counted.where("family is null or family <> 'packed'")
    rows = counted.where("n > 0").withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    names = {
        "episode_chunk": F.floor(F.col("place") / F.col("chunk")), "episode_index": F.col("place"), "chunk_index": F.lit(0),
        "file_index": F.col("place"), "shard_id": F.col("place"), "num_shards": F.col("num_shards"),
    }
    out = rows.select(*keep, "place", _filled(F.col("data_path"), names).alias("path"))
    if not probe:
        return out
    # the run of files from 0 on: a file's place is its number, found by reading the number out of the listed path
    packed = df.where("family = 'packed'").join(listing.withColumnRenamed("path", "listed"), "dataset")
    pattern = F.regexp_replace(F.regexp_replace(F.concat(F.lit("^"), F.regexp_replace("data_path", r"\.", r"\\."), F.lit("$")), r"\{chunk_index[^}]*\}", "0+"), r"\{file_index[^}]*\}", "(\\\\d+)")
    found = packed.withColumn("pattern", pattern)
    found = found.selectExpr(*keep, "data_path", "chunk", "num_shards", "listed", "try_cast(regexp_extract(listed, pattern, 1) as bigint) as place").where("place is not null")
    found = found.where(_filled(F.col("data_path"), {"chunk_index": F.lit(0), "file_index": F.col("place")}) == F.col("listed"))
    nth = F.row_number().over(Window.partitionBy("dataset").orderBy("place")) - 1
    run = found.dropDuplicates(["dataset", "place"]).withColumn("nth", nth).where("nth = place").select(*keep, "place", F.col("listed").alias("path"))
    return out.unionByName(run)


def partial_sample(family: Column, limit: int | None, has_listing: bool) -> Column:
    """Every file was asked for, but only one of a packed dataset can be named."""
    return F.coalesce(family == "packed", F.lit(False)) & F.lit(limit is None and not has_listing)


def printf(template: str) -> str:
    """A {name:03d} template as a printf format, for one known template."""
    return re.sub(r"\{\w+(?::(0?\d*)d)?\}", lambda m: f"%{m[1] or ''}d", template)
