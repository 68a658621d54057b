"""Shared plumbing: the scratch folder all executors see, Arrow run detection, hashing of ids."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. A session on one machine gets a temporary one where the setting is
    absent; on a cluster that would be a folder that executors do not share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master or ""
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Rows of an Arrow batch where the session sets none: texts are wide, and the engine's own default of 10,000 rows would
#: hold tens of MB several times over.
BATCH_ROWS = 2_048


def ship(spark: SparkSession) -> None:
    """Hands the package to the executors, once for each context, so that it need not be installed there."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, "_plumbline_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="plumbline-ship-")) / "plumbline_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(target))
    context._plumbline_shipped = True


class Scratch:
    """Tables written once in the shared folder and read again, so that lost executors cost no lineage."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.count += 1
        path = self.path(f"{name}-{self.count}")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def clear(self) -> None:
        """Removes all tables; no result that reads them may be in use."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *kept: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in kept:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores before them so that no column of df has one, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def release() -> None:
    """Hands freed memory of a Python worker back, which arrays of middle size would else keep in the allocators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def maybe_in(rows: DataFrame, key: str, ids: DataFrame, id_column: str, name: str = "__maybe", most_buckets: int = 4_096) -> DataFrame:
    """rows with a boolean column: false only where the key is none of the ids (a written table).

    The ids go into a bitmap by hash, about 16 bits for each and at most most_buckets * 4 KB in all, whatever their
    number; that bitmap alone is broadcast. More ids than fit make it let more rows through, never fewer. A null key is
    none of the ids. `name` must be no column of rows; other names may clash.
    """
    bits = 32_768  # of a bucket, as bitmap_construct_agg has it
    buckets = max(1, min(most_buckets, ids.count() * 16 // bits + 1))
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(buckets * bits))
    held = ids.select(place(id_column).alias("p")).groupBy(F.floor(F.col("p") / bits).alias("__bucket")).agg(F.bitmap_construct_agg(F.col("p") % bits).alias("__bits"))
    at_, of, bucket, held_bits = unused(rows, "at", "of", "bucket", "bits")
    held = held.toDF(bucket, held_bits)
    at = rows.withColumn(at_, place(key)).withColumn(of, F.floor(F.col(at_) / bits))
    byte = F.conv(F.hex(F.substring(held_bits, F.floor(F.col(at_) % bits / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col(at_) % 8).cast("int")) == 1, F.lit(False))
    return at.join(F.broadcast(held), F.col(of) == F.col(bucket), "left").withColumn(name, hit).drop(at_, of, bucket, held_bits)


def remainder(column: str, by: int):
    """crc32 of the id's decimal text modulo `by`; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % by


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without making Python strings; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    n = len(column)
    if n == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def pieces(offsets: np.ndarray, most: int = 4 << 20):
    """Row ranges of about `most` bytes; a longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


def runs(batches, keys: list[str]):
    """Whole runs of rows with equal keys from a partition that is sorted by them."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        cols = [t[k].combine_chunks().to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(t.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is None or any(c[0] != v for c, v in zip(cols, last))
        cuts = np.flatnonzero(change)
        begin = 0
        for cut in cuts:
            if cut > begin:
                held.append(t.slice(begin, cut - begin))
            if held:
                yield pa.concat_tables(held) if len(held) > 1 else held[0]
            held, begin = [], cut
        held.append(t.slice(begin))
        last = [c[-1] for c in cols]
    if held:
        yield pa.concat_tables(held)
