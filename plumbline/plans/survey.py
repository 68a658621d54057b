"""The two-tier, seeded, resumable survey: metadata first, then the files of the sampled datasets."""

from __future__ import annotations

import contextlib
import os
import time
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hashing import fingerprint, sample
from ..operators.report import as_records, report
from ..sources import ledger

TIERS = ("metadata", "deep", "both")
PARTIAL = "partial: packed layout, first file only"


class SurveyLocked(RuntimeError):
    """Another run owns the output folder."""


@contextlib.contextmanager
def lock(folder: str | Path, force: bool = False):
    """One writer for each folder. The lock of a run that died stays until someone forces it away."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / ".survey.lock"
    if force:
        path.unlink(missing_ok=True)
    try:
        with open(path, "x", encoding="utf-8") as f:
            f.write(f"pid {os.getpid()}, since {time.time():.0f}")
    except FileExistsError:
        holder = path.read_text(encoding="utf-8") or "an unknown process"
        raise SurveyLocked(f"{folder} is in use by {holder}; if that run is dead, remove {path} or force it") from None
    try:
        yield path
    finally:
        path.unlink(missing_ok=True)


def draw(spark: SparkSession, population: list[str], size: int, seed: int, folder: str | Path) -> list[str]:
    """Draws the sample and writes its record, with the fingerprint of the population it came from."""
    ids = spark.createDataFrame([(i,) for i in population], "id string")
    got = [r["id"] for r in sample(ids, "id", size, seed).collect()]  # a sample's size is a parameter
    mark = fingerprint(ids, "id").first()
    ledger.write_sample_record(Path(folder) / "sample.json", seed, size, mark["n"], mark["sha256"], datetime.now(timezone.utc).isoformat(), got)
    return got


def metadata_records(spark: SparkSession, fetched: list[tuple]) -> DataFrame:
    """fetched (repo, revision, source, error, info as JSON) -> records. Keys that the metadata lack stay at their
    defaults; an unknown layout is named so and is no error."""
    from ..sources.layout import layout_family

    schema = "codebase_version string, fps double, chunks_size int, total_episodes int, total_frames long, data_path string, num_shards int, features map<string, string>"
    df = spark.createDataFrame(fetched, "repo string, revision string, source string, error string, info string").withColumn("i", F.from_json("info", schema))
    names = F.array_sort(F.map_keys("i.features"))
    df = df.select(
        "repo", "revision", "source", "error", F.coalesce("i.codebase_version", F.lit("")).alias("codebase"), F.col("i.fps").alias("fps"), F.coalesce("i.total_episodes", F.lit(0)).alias("total_episodes"),
        F.coalesce("i.total_frames", F.lit(0)).alias("total_frames"), F.coalesce("i.chunks_size", F.lit(0)).alias("chunk_size"),
        F.when(F.col("i").isNotNull(), F.coalesce(layout_family(F.coalesce("i.data_path", F.lit(""))), F.lit("unknown"))).otherwise("").alias("layout_family"),
        F.coalesce(F.array_join(names, ";"), F.lit("")).alias("feature_names"), F.greatest(F.coalesce(F.size(names), F.lit(0)), F.lit(0)).alias("n_features"),
    )
    return as_records(df)


def _fetch(source, repo: str) -> tuple[dict | None, str, str]:
    """Metadata, revision and error of one dataset; whatever goes wrong is its error."""
    try:
        info = source.info(repo)
        error = "" if info is not None else "no info.json"
    except Exception as e:
        info, error = None, f"{type(e).__name__}: {e}"
    revision = source.revision(repo) if hasattr(source, "revision") else ""
    return info, revision, error


def run(
    spark: SparkSession,
    source,
    population: list[str],
    folder: str | Path,
    sample_size: int = 800,
    seed: int = 20260905,
    files_per_dataset: int | None = 1,
    tier: str = "both",
    resume: bool = False,
    force: bool = False,
    batch: int = 20,
    thresholds: dict | None = None,
) -> dict[str, int]:
    """Numbers of records appended by tier. The lock is taken before anything is written. Work that the ledger holds at
    the revision that the metadata show is skipped on resume, and refused otherwise: a ledger is never doubled."""
    import json

    if tier not in TIERS:
        raise ValueError(f"tier must be one of {TIERS}")
    with lock(folder, force):
        chosen = draw(spark, population, sample_size, seed, folder)
        fetched = {repo: _fetch(source, repo) for repo in chosen}
        name = type(source).__name__
        rows = [(repo, rev, name, err, json.dumps(info) if info is not None else None) for repo, (info, rev, err) in fetched.items()]
        out: dict[str, int] = {}
        for kind in ("metadata", "deep"):
            if tier not in (kind, "both"):
                continue
            path = f"{folder}/{kind}.jsonl"
            finished = ledger.done(spark, path)
            if not resume and not finished.isEmpty():
                raise FileExistsError(f"{path} has records; resume, or use another folder")
            work = ledger.still_to_do(spark.createDataFrame([(r, v) for r, v, *_ in rows], "repo string, revision string"), finished)
            todo = {r["repo"] for r in work.collect()}
            out[kind] = len(todo)
            mine = [r for r in rows if r[0] in todo]
            for i in range(0, len(mine), batch):
                part = mine[i : i + batch]
                records = metadata_records(spark, part) if kind == "metadata" else deep_records(spark, source, part, fetched, files_per_dataset, thresholds)
                ledger.append(records, path)
        return out


def deep_records(spark: SparkSession, source, rows: list[tuple], fetched: dict, files: int | None, thresholds: dict | None = None) -> DataFrame:
    """Reports of a batch of datasets from their files, in one job; datasets without metadata or with unreadable files
    are records of their error."""
    from functools import reduce

    from ..sources.episodes import readable
    from ..sources.layout import layout_family, partial_sample

    parts, meta, opened = [], [], []
    for repo, revision, name, error, _ in rows:
        info = fetched[repo][0]
        note = ""
        if not error:
            try:
                paths = source.paths(repo, info, files)
                if not paths:
                    note = "no data sampled"
                elif not paths[0].startswith("synthetic:"):
                    open_uri = getattr(source, "open_uri", lambda _, p: p)
                    uris = [open_uri(repo, p) for p in paths]
                    opened += uris
                    listed = spark.createDataFrame([(u,) for u in uris], "path string")
                    broken = readable(spark, listed).where("error <> ''").first()
                    error = broken["error"] if broken else ""
                if paths and not error:
                    parts.append(source.frames(spark, repo, info, paths))
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
        meta.append((repo, revision, name, error, note, str((info or {}).get("codebase_version", "")), str((info or {}).get("data_path", ""))))
    known = spark.createDataFrame(meta, "repo string, revision string, source string, error string, note string, codebase string, data_path string")
    # a source that can list files names all files of a packed dataset, any other just the first
    listing = hasattr(source, "root") or hasattr(getattr(source, "client", None), "list_parquet")
    partial = partial_sample(layout_family(F.col("data_path")), files, listing) & (F.col("error") == "") & (F.col("note") == "")
    known = known.withColumn("note", F.when(partial, PARTIAL).otherwise(F.col("note"))).drop("data_path")
    if not parts:
        return as_records(known)
    got = report(reduce(DataFrame.unionByName, parts), thresholds).withColumnRenamed("dataset", "repo")
    out = as_records(known.join(got, "repo", "left"))
    if not hasattr(source, "close"):
        return out
    rows = out.collect()  # one a dataset of the batch, before its copies go
    source.close(opened)
    return spark.createDataFrame(rows, out.schema)
