"""Command line: demo, quick audit of local datasets, survey, and a look at flagged datasets."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.report import as_records, evidence, has_flag, report
from ..sources import ledger, synth, thresholds
from ..sources.episodes import LocalSource, RemoteSource, SyntheticSource, downloading
from ..sources.hub import HubClient
from . import survey

#: Files of a dataset that a quick audit reads where it is not told how many.
FILE_CAP = 25

SHOWN = ("repo", "codebase", "fps", "episodes_sampled", "frames_sampled", "frac_bad_dt", "stuck_state_frac", "identity_frac", "lag_frames", "r_best", "dup_episode_frac", "flags")


def files(text: str) -> int | None:
    """'all' or a positive number."""
    if text == "all":
        return None
    n = int(text) if text.isdigit() else 0
    if n < 1:
        raise argparse.ArgumentTypeError("a positive number, or all")
    return n


def show(records: DataFrame) -> None:
    doubles = [c for c, k in records.dtypes if k == "double" and c in SHOWN]
    text = lambda c: F.when(F.col(c).isNull() | F.isnan(c), "nan").otherwise(F.format_string("%.3f", c))
    records.withColumns({c: text(c) for c in doubles}).select(*SHOWN).orderBy("repo").show(1_000, truncate=False)


def demo(spark: SparkSession) -> DataFrame:
    specs = [{"dataset": f"synthetic/{d or 'clean'}", "defect": d} for d in synth.DEFECTS]
    got = report(synth.synthetic_frames(spark, specs)).withColumnRenamed("dataset", "repo")
    return as_records(got.withColumn("codebase", F.lit("demo")))


def quick(spark: SparkSession, source, repos: list[str], limit: int | None, limits: dict) -> DataFrame:
    fetched = {r: survey._fetch(source, r) for r in repos}
    rows = [(r, v, type(source).__name__, e, None) for r, (_, v, e) in fetched.items()]
    return survey.deep_records(spark, source, rows, fetched, limit, limits)


def chosen_source(spark: SparkSession, args, client: HubClient | None = None):
    """The source that the options of an audit name, and the datasets."""
    if args.source == "local":
        if args.top:
            raise SystemExit("--top asks a hub; choose --source stream or download")
        return LocalSource(spark, args.root), args.repos
    client = client or HubClient(args.root.rstrip("/"))
    below = (args.max_mb, 0 if args.no_file_cap else FILE_CAP)
    if args.source == "download":
        source = downloading(client, args.copies, files_below=below)
    else:
        source = RemoteSource(client, lambda repo, path: args.open.format(hub=args.root.rstrip("/"), repo=repo, path=path), files_below=below)
    return source, args.repos + (client.list_top(args.tag, args.top) if args.top else [])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline")
    p.add_argument("--thresholds", help="TOML file with [thresholds]")
    sub = p.add_subparsers(dest="what", required=True)
    d = sub.add_parser("demo", help="report on six synthetic datasets")
    d.add_argument("--out", help="CSV file")
    a = sub.add_parser("audit", help="report on datasets in a folder or on a hub")
    a.add_argument("root", help="folder of the datasets; with --source stream or download, address of the hub")
    a.add_argument("repos", nargs="*")
    a.add_argument("--top", type=int, metavar="N", help="the N datasets of --tag that are fetched most often, from a hub")
    a.add_argument("--tag", default="", help="tag of the datasets for --top")
    a.add_argument("--files", type=files, default=1)
    a.add_argument("--max-mb", type=float, default=100.0, help="leave out larger files of a hub")
    a.add_argument("--no-file-cap", action="store_true", help=f"with --files all, more than {FILE_CAP} files of a dataset")
    a.add_argument("--source", choices=("local", "stream", "download"), default="local")
    a.add_argument("--open", default="{hub}/datasets/{repo}/resolve/main/{path}", help="address that Spark opens for --source stream, with {hub}, {repo} and {path}")
    a.add_argument("--copies", default="/tmp/plumbline-copies", help="folder shared by all machines for --source download")
    a.add_argument("--out", help="CSV file")
    s = sub.add_parser("survey", help="two-tier survey of a population")
    s.add_argument("root", help="folder of the datasets, or 'synthetic'")
    s.add_argument("out")
    s.add_argument("--population", required=True, help="text file of ids")
    s.add_argument("--sample-size", type=int, default=800)
    s.add_argument("--seed", type=int, default=20260905)
    s.add_argument("--files", type=files, default=1)
    s.add_argument("--tier", choices=survey.TIERS, default="both")
    s.add_argument("--resume", action="store_true")
    s.add_argument("--force-unlock", action="store_true")
    i = sub.add_parser("inspect", help="evidence for datasets with a flag in a ledger")
    i.add_argument("root")
    i.add_argument("ledger")
    i.add_argument("--flag")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, client: HubClient | None = None) -> int:
    args = parser().parse_args(argv)
    limits = thresholds.load(args.thresholds)
    spark = spark or SparkSession.builder.appName("plumbline").getOrCreate()
    if args.what == "survey":
        source = SyntheticSource(spark) if args.root == "synthetic" else LocalSource(spark, args.root)
        with open(args.population, encoding="utf-8") as f:
            people = [line.strip() for line in f if line.strip()]
        done = survey.run(spark, source, people, args.out, args.sample_size, args.seed, args.files, args.tier, args.resume, args.force_unlock, thresholds=limits)
        print(", ".join(f"{k}: {n} records" for k, n in done.items()))
        return 0
    if args.what == "inspect":
        flagged = ledger.latest(ledger.read(spark, args.ledger, tolerant=True)).where("error = '' and flags <> ''")
        if args.flag:
            flagged = flagged.where(has_flag(F.col("flags"), args.flag))
        source = LocalSource(spark, args.root)
        for r in flagged.orderBy("repo").toLocalIterator():
            info = source.info(r["repo"]) or {}
            print(r["repo"], r["flags"])
            evidence(source.frames(spark, r["repo"], info, source.paths(r["repo"], info, 1))).show(truncate=False, vertical=True)
        return 0
    if args.what == "demo":
        records = demo(spark)
    else:
        source, repos = chosen_source(spark, args, client)
        if not repos:
            raise SystemExit("name datasets, or ask for the --top of a hub")
        records = quick(spark, source, repos, args.files, limits)
    records = records.persist()
    show(records)
    if args.out:
        ledger.write_csv(records, args.out)
    records.unpersist()
    return 0


if __name__ == "__main__":
    sys.exit(main())
