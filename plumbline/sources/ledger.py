"""The result ledger and the other record files: JSON lines in, JSON lines and CSV out."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.report import RECORD, as_records

SCHEMA = ", ".join(f"`{name}` {kind}" for name, kind, _ in RECORD)
#: Our own wording for the first line of a published table.
DISCLOSURE = "# Automated audit. A flag is a provisional measurement, not a finding, until a person has opened the dataset and filled in the confirmed column."
RETRY = "RateLimited:"


def read(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """Records of a ledger (a file or a folder of files). Bare NaN is read as NaN. A line that is no JSON stops a strict
    read; a tolerant one leaves it out, as a crash may cut the last line."""
    df = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").option("allowNonNumericNumbers", True).json(path)
    return df.where(F.col("repo").isNotNull())


def done(spark: SparkSession, path: str) -> DataFrame:
    """(repo, revision) that need no further work: everything recorded but exhausted rate limits. A ledger that does
    not exist yet has none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "repo string, revision string")
    r = read(spark, path, tolerant=True).where(~F.coalesce(F.col("error"), F.lit("")).startswith(RETRY))
    return r.select("repo", F.coalesce("revision", F.lit("")).alias("revision")).distinct()


def still_to_do(work: DataFrame, finished: DataFrame) -> DataFrame:
    """work (repo, revision, …) without what is finished at the same revision; known only once metadata has been read."""
    return work.join(finished.select("repo", "revision"), ["repo", "revision"], "left_anti")


def append(records: DataFrame, path: str) -> None:
    """One append of a batch of records; a crash costs the batch, not the ledger."""
    as_records(records).write.mode("append").option("ignoreNullFields", "false").json(path)


def latest(records: DataFrame) -> DataFrame:
    """One record for each (repo, revision), a success before an error: what a doubled ledger means."""
    from pyspark.sql import Window

    w = Window.partitionBy("repo", "revision").orderBy(F.col("error") != "", "error", F.xxhash64(*[c for c, _, _ in RECORD]))
    return records.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def _cell(x) -> str:
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "nan"
    text = str(x)
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n') else text


def write_csv(records: DataFrame, path: str | Path) -> None:
    """The published table, a line a dataset, fetched one after another: the disclosure, a header, rows; without records
    the disclosure alone."""
    rows = as_records(records).orderBy("repo").toLocalIterator()
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(DISCLOSURE + "\n")
        first = True
        for row in rows:
            if first:
                f.write(",".join(name for name, _, _ in RECORD) + "\n")
                first = False
            f.write(",".join(_cell(x) for x in row) + "\n")


def write_sample_record(path: str | Path, seed: int, size: int, population: int, fingerprint: str, drawn_at: str, sample: list[str]) -> None:
    record = {"seed": seed, "size": size, "frame_size": population, "frame_sha256": fingerprint, "drawn_at": drawn_at, "sample": sample}
    Path(path).write_text(json.dumps(record, indent=2), encoding="utf-8")
