"""The driver contract, the command line, the stream, and every query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from plumbline.plans import catalogue, cli
from plumbline.streaming.trials import watch

DATA = contract.SMOKE
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


def cells(rows, names):
    def plain(x):
        return None if x is None or x != x else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    return sorted(repr([plain(r[n]) for n in names]) for r in rows)


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_agrees_with_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    want = con.execute(catalogue.ORACLE[name]).fetch_arrow_table().to_pylist() if hasattr(con, "fetch_arrow_table") else con.execute(catalogue.ORACLE[name]).fetchdf().to_dict("records")
    got = catalogue.QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    assert not want or sorted(want[0]) == names
    assert cells(got.collect(), names) == cells(want, names)


@needs_data
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


@needs_data
def test_entry(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_cli_demo_and_audit(spark, tmp_path, capsys):
    from plumbline.sources import synth

    assert cli.main(["demo", "--out", str(tmp_path / "d.csv")], spark) == 0
    assert len((tmp_path / "d.csv").read_text().splitlines()) == 8
    synth.write(synth.episodes(n_eps=2, T=60, defect="identity"), tmp_path, "org/x", "packed")
    assert cli.main(["audit", str(tmp_path), "org/x", "org/none", "--files", "all"], spark) == 0
    out = capsys.readouterr().out
    assert "action_equals_state" in out and "org/none" in out
    (tmp_path / "people").write_text("org/x\n")
    assert cli.main(["survey", str(tmp_path), str(tmp_path / "s"), "--population", str(tmp_path / "people")], spark) == 0
    assert cli.main(["inspect", str(tmp_path), str(tmp_path / "s/deep.jsonl")], spark) == 0
    with pytest.raises(SystemExit):
        cli.main(["audit", str(tmp_path), "x", "--files", "0"], spark)


def test_stream_of_trials(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "arm string, outcome int"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    put([("a", 1)] * 9 + [("b", 0)] * 4)
    q = watch(spark.readStream.schema(schema).parquet(src)).writeStream.outputMode("complete").format("memory").queryName("trials").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        put([("a", 0)] * 3)
        q.processAllAvailable()
        got = {r["arm"]: r for r in spark.table("trials").collect()}
    finally:
        q.stop()
    assert (got["a"]["s"], got["a"]["t"], got["b"]["t"]) == (9, 12, 4)
    plain = watch(spark.read.parquet(src)).where(F.col("arm") == "a").first()
    assert (plain["lo"], plain["hi"]) == (got["a"]["lo"], got["a"]["hi"])
