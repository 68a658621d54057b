"""Layouts, readers, ledger, hub client, survey and the command line, all without a network."""

from __future__ import annotations

import io
import json
import urllib.error
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators.report import report
from plumbline.plans import cli, survey
from plumbline.sources import episodes, hub, layout, ledger, synth, thresholds

#: Fixed values, the published six-row demo: frames, frac_bad_dt, stuck, identity, lag, r_lag0, r_best, dup, flags.
DEMO = {
    "clean": (1800, 0.0, 0.0, 0.0, 2.0, 0.9672949283038665, 0.9913175890895616, 0.0, ""),
    "identity": (1800, 0.0, 0.0, 1.0, 0.0, 0.9999999830752864, 0.9999999830752864, 0.0, "action_equals_state"),
    "drops": (1689, 0.05525846702317291, 0.0, 0.0, 2.0, 0.9672115920519581, 0.9890299713041618, 0.0, "bad_dt"),
    "stuck": (1800, 0.0, 0.2491638795986622, 0.0, 2.0, 0.8402618734434338, 0.8588718532125501, 0.0, "stuck_state"),
    "swapped": (1800, 0.0, 0.0, 0.0, -2.0, 0.9672949283038665, 0.9913175890895616, 0.0, "negative_lag"),
    "duplicate": (1800, 0.0, 0.0, 0.0, 6.0, 0.04758178246549403, 0.07918300927015062, 0.8333333333333334, "duplicate_episodes"),
}
FIELDS = ("frames_sampled", "frac_bad_dt", "stuck_state_frac", "identity_frac", "lag_frames", "r_lag0", "r_best", "dup_episode_frac", "flags")


def test_demo_has_the_published_numbers(spark):
    got = {r["dataset"]: r for r in report(synth.synthetic_frames(spark, [{"dataset": d, "defect": "" if d == "clean" else d} for d in DEMO])).collect()}
    for d, want in DEMO.items():
        assert tuple(got[d][f] for f in FIELDS[:-1]) == pytest.approx(want[:-1], abs=1e-9), d
        assert got[d]["flags"] == want[-1] and got[d]["episodes_sampled"] == 6


def test_unequal_parts_pool_over_episodes(spark):
    parts = [(2, 150, 1, 101), (2, 200, 1, 102), (1, 100, 1, 103), (3, 130, 6, 104)]
    specs = [{"dataset": "d", "file": str(i), "n_eps": n, "T": t, "lag": k, "seed": s, "n_joints": 8} for i, (n, t, k, s) in enumerate(parts)]
    assert report(synth.synthetic_frames(spark, specs)).first()["lag_frames"] == 1.0


def infos(spark, *rows):
    return spark.createDataFrame(rows, "dataset string, data_path string, chunks_size long, total_episodes long, num_shards long")


PER_EPISODE = "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet"
PACKED = "data/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet"
SHARDED = "data/shard-{shard_id:05d}-of-{num_shards:05d}.parquet"


def paths(df):
    return [r["path"] for r in df.orderBy("dataset", "place").collect()]


def test_paths_of_each_layout(spark):
    got = paths(layout.derive_paths(infos(spark, ("a", PER_EPISODE, 1000, 2500, None))))
    assert len(got) == 2500 and got[1000] == "data/chunk-001/episode_001000.parquet" and got[2499] == "data/chunk-002/episode_002499.parquet"
    assert paths(layout.derive_paths(infos(spark, ("a", PER_EPISODE, 0, 3, None)), 2)) == ["data/chunk-000/episode_000000.parquet", "data/chunk-000/episode_000001.parquet"]
    assert paths(layout.derive_paths(infos(spark, ("a", SHARDED, None, None, 64)), 1)) == ["data/shard-00000-of-00064.parquet"]
    assert paths(layout.derive_paths(infos(spark, ("a", PACKED, 1000, 9, None)))) == ["data/chunk-000/file-000.parquet"]
    assert len(paths(layout.derive_paths(infos(spark, ("a", PACKED, 1000, 9, None)), 4))) == 4
    none = infos(spark, ("a", "data/x.tsfile", 1, 9, None), ("b", SHARDED, 1, 1, None), ("c", PER_EPISODE, 1000, 0, None), ("d", PER_EPISODE, 1000, None, None))
    assert paths(layout.derive_paths(none)) == []


def test_packed_stops_at_the_first_gap(spark):
    listing = spark.createDataFrame([("a", f"data/chunk-000/file-{i:03d}.parquet") for i in (0, 2, 3)] + [("b", "data/chunk-000/file-001.parquet"), ("a", "other.parquet")], "dataset string, path string")
    df = infos(spark, ("a", PACKED, 1000, 9, None), ("b", PACKED, 1000, 9, None), ("c", PER_EPISODE, 1000, 1, None))
    assert paths(layout.derive_paths(df, listing=listing)) == ["data/chunk-000/file-000.parquet", "data/chunk-000/episode_000000.parquet"]
    assert layout.printf(PACKED) == "data/chunk-%03d/file-%03d.parquet"
    row = spark.range(1).select(layout.partial_sample(layout.layout_family(F.lit(PACKED)), None, False).alias("p"), layout.partial_sample(layout.layout_family(F.lit("?")), None, False).alias("q")).first()
    assert (row["p"], row["q"]) == (True, False)


def test_files_give_what_memory_gives(spark, tmp_path):
    t = synth.episodes(n_eps=3, T=60, seed=4)
    synth.write(t, tmp_path, "org/v2", "per_episode")
    synth.write(t, tmp_path, "org/v3", "packed")
    src = episodes.LocalSource(spark, str(tmp_path))
    got = []
    for repo in ("org/v2", "org/v3"):
        info = src.info(repo)
        found = src.paths(repo, info, None)
        got.append(report(src.frames(spark, repo, info, found)).first())
    assert [r["episodes_sampled"] for r in got] == [3, 3]
    assert [got[0][f] for f in FIELDS] == [got[1][f] for f in FIELDS]
    assert src.info("org/none") is None and src.paths("org/none", {}, None) == [] and len(src.paths("org/v2", {}, 2)) == 2


def test_reader_asks_for_the_audit_columns_alone(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    t = synth.episodes(n_eps=1, T=40).drop_columns(["episode_index"]).append_column("image", pa.array([b"x" * 1000] * 40))
    pq.write_table(t, tmp_path / "f.parquet")
    f = episodes.read_frames(spark, [str(tmp_path / "f.parquet")], F.lit("d"), F.lit(30.0))
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "image" not in plan and f.select("episode").distinct().count() == 1
    assert f.first()["has_action"] and [r["pos"] for r in f.orderBy("pos").collect()] == list(range(40))


def test_broken_files_are_named(spark, tmp_path):
    (tmp_path / "bad.parquet").write_bytes(b"nothing")
    df = spark.createDataFrame([(str(tmp_path / "bad.parquet"),)], "path string")
    assert episodes.readable(spark, df).first()["error"] != ""


def test_tree_sample(spark):
    rows = [("d", f"data/chunk-{c:03d}/file-{i:03d}.parquet", 10**6 * (i + 1)) for c in (1, 0) for i in range(40)] + [("d", "data/chunk-000/readme.md", 1), ("d", "meta/a.parquet", 1)]
    df = spark.createDataFrame(rows, "dataset string, path string, size long")
    assert episodes.tree_sample(df, None, None).count() == 25 and episodes.tree_sample(df, None, None, cap=0).count() == 40
    assert [r["path"] for r in episodes.tree_sample(df, 3, 2.0).orderBy("path").collect()] == ["data/chunk-000/file-000.parquet", "data/chunk-000/file-001.parquet"]


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "l.jsonl")
    lines = [
        {"repo": "acme/ok", "revision": "r1", "fps": float("nan"), "error": ""}, {"repo": "acme/missing", "revision": "", "error": "no info.json"},
        {"repo": "acme/limited", "revision": "r2", "error": "RateLimited: gave up"},
    ]
    Path(path).write_text("\n".join(json.dumps(x) for x in lines) + "\n\n" + '{"repo": "acme/cut", "rev')
    assert {tuple(r) for r in ledger.done(spark, path).collect()} == {("acme/ok", "r1"), ("acme/missing", "")}
    work = spark.createDataFrame([("acme/ok", "r1"), ("acme/ok", "r9"), ("acme/limited", "r2")], "repo string, revision string")
    assert {tuple(r) for r in ledger.still_to_do(work, ledger.done(spark, path)).collect()} == {("acme/ok", "r9"), ("acme/limited", "r2")}
    assert ledger.done(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception):
        ledger.read(spark, path).collect()
    out = str(tmp_path / "out")
    ledger.append(ledger.read(spark, path, tolerant=True), out)
    ledger.append(spark.createDataFrame([("acme/ok", "r1", "ValueError: x")], "repo string, revision string, error string"), out)
    assert ledger.read(spark, out).count() == 4 and ledger.latest(ledger.read(spark, out)).where("repo = 'acme/ok'").first()["error"] == ""
    ledger.write_csv(ledger.read(spark, out).where("repo = 'acme/limited'"), tmp_path / "t.csv")
    text = (tmp_path / "t.csv").read_text().splitlines()
    assert text[0] == ledger.DISCLOSURE and text[1].startswith("repo,codebase,fps,") and text[2].startswith("acme/limited,,nan,0,0,0,nan") and len(text) == 3
    ledger.write_csv(ledger.read(spark, out).limit(0), tmp_path / "e.csv")
    assert (tmp_path / "e.csv").read_text().splitlines() == [ledger.DISCLOSURE]


class FakeHub:
    def __init__(self, answers):
        self.answers, self.calls, self.slept, self.now = answers, [], [], 0.0

    def open(self, request, timeout):
        self.calls.append(request.full_url)
        a = self.answers[request.full_url]
        a = a.pop(0) if isinstance(a, list) else a
        if isinstance(a, Exception):
            raise a
        if isinstance(a, int):
            raise urllib.error.HTTPError(request.full_url, a, "no", {"Retry-After": "7"} if a == 429 else {}, io.BytesIO())
        return a

    def sleep(self, s):
        self.slept.append(s)
        self.now += s

    def client(self, **kw):
        return hub.HubClient("https://hub.test", opener=self.open, sleep=self.sleep, clock=lambda: self.now, **kw)


def test_hub_client():
    info = "https://hub.test/datasets/{}/resolve/main/meta/info.json"
    f = FakeHub({info.format("a"): [429, 503, (b'{"fps": 30}', {"X-Repo-Commit": "sha"})], info.format("b"): 404, info.format("c"): (b"{broken", {}), info.format("d"): [500] * 5, info.format("e"): 418})
    c = f.client(token="secret")
    assert c.get_info("a") == {"fps": 30} and c.get_revision("a") == "sha" and 7.0 in f.slept
    assert c.get_info("b") is None and c.get_revision("b") == "" and c.get_info("c") is None
    with pytest.raises(hub.RateLimited):
        c.get_info("d")
    with pytest.raises(urllib.error.HTTPError):
        c.get_info("e")
    assert "secret" not in repr(c)


def test_pages_follow_the_cursor():
    first, second = "https://hub.test/api/datasets?filter=t&limit=2", "https://hub.test/api/datasets?cursor=x"
    f = FakeHub({first: (b'[{"id": "b"}, {"id": "a"}]', {"Link": f'<{second}>; rel="next"'}), second: (b'[{"id": "c"}]', {})})
    assert list(f.client().iter_datasets("t", 2)) == ["b", "a", "c"] and list(f.client().iter_datasets("t", 2, max_pages=1)) == ["b", "a"]
    assert hub.next_link('<https://evil.test/x>; rel="next"', first) is None and hub.next_link('<x>; rel="prev", <y>; rel="next"', first) == "https://hub.test/api/y"


def test_hub_waits_out_a_timeout_and_lists():
    top = "https://hub.test/api/datasets?filter=t&sort=downloads&direction=-1&limit=2"
    tree = "https://hub.test/api/datasets/{}/tree/main/{}"
    data = [{"path": "data/b", "type": "directory"}, {"path": "data/a", "type": "directory"}, {"path": "data/z.parquet", "type": "file", "size": 5}]
    more = tree.format("r", "data/a") + "?cursor=1"
    f = FakeHub({
        top: [TimeoutError("slow"), (b'[{"id": "x"}, {"id": "y"}]', {})], tree.format("r", "data"): (json.dumps(data).encode(), {}),
        tree.format("r", "data/a"): (b'[{"path": "data/a/2.parquet", "type": "file", "size": 3}]', {"Link": f'<{more}>; rel="next"'}),
        more: (b'[{"path": "data/a/1.parquet", "type": "file"}, {"path": "data/a/x.txt", "type": "file"}]', {}), tree.format("gone", "data"): 404,
        "https://hub.test/datasets/r/resolve/main/data/a/1.parquet": (b"", {}), "https://hub.test/datasets/r/resolve/main/no": 404,
    })
    c = f.client()
    assert c.list_top("t", 2) == ["x", "y"] and f.slept and c.list_parquet("r") == [("data/a/1.parquet", 0), ("data/a/2.parquet", 3), ("data/z.parquet", 5)]
    with pytest.raises(hub.TreeListingError):
        c.list_parquet("gone")
    assert c.exists("r", "data/a/1.parquet") and not c.exists("r", "no")


def _hub_of(folder, repo):
    """A hub that serves a dataset written below folder."""
    site, answers = "https://hub.test", {}
    for f in (Path(folder) / repo).rglob("*.*"):
        answers[f"{site}/datasets/{repo}/resolve/main/{f.relative_to(Path(folder) / repo)}"] = (f.read_bytes(), {"X-Repo-Commit": "sha9"})
    files = sorted((Path(folder) / repo / "data").rglob("*.parquet"))
    answers[f"{site}/api/datasets/{repo}/tree/main/data"] = (b'[{"path": "data/chunk-000", "type": "directory"}]', {})
    answers[f"{site}/api/datasets/{repo}/tree/main/data/chunk-000"] = (json.dumps([{"path": f"data/chunk-000/{f.name}", "type": "file", "size": f.stat().st_size} for f in files]).encode(), {})
    answers[f"{site}/api/datasets?filter=t&sort=downloads&direction=-1&limit=1"] = (json.dumps([{"id": repo}]).encode(), {})
    return FakeHub(answers)


def test_remote_source_fetches_reads_and_forgets(spark, tmp_path, capsys):
    synth.write(synth.episodes(n_eps=3, defect="identity"), tmp_path / "site", "acme/arm", "per_episode")
    f, copies = _hub_of(tmp_path / "site", "acme/arm"), tmp_path / "copies"
    source = episodes.downloading(f.client(), str(copies))
    info = source.info("acme/arm")
    assert source.revision("acme/arm") == "sha9" and len(source.paths("acme/arm", info, None)) == 3 and len(source.paths("acme/arm", info, 2)) == 2
    got = survey.deep_records(spark, source, [("acme/arm", "sha9", "RemoteSource", "", None)], {"acme/arm": (info, "sha9", "")}, None).first()
    assert got["episodes_sampled"] == 3 and got["error"] == "" and got["identity_frac"] == 1.0 and not list(copies.rglob("*.parquet"))
    assert cli.main(["audit", "https://hub.test/", "--source", "download", "--top", "1", "--tag", "t", "--files", "all", "--copies", str(copies)], spark, f.client()) == 0
    assert "acme/arm" in capsys.readouterr().out
    assert cli.main(["audit", "https://hub.test", "acme/arm", "--source", "stream", "--open", "file://" + str(tmp_path / "site/{repo}/{path}"), "--max-mb", "0.000001"], spark, f.client()) == 0
    assert "acme/arm" in capsys.readouterr().out


def test_packed_sample_without_a_listing_is_noted(spark, tmp_path):
    synth.write(synth.episodes(n_eps=2), tmp_path, "acme/packed", "packed")

    class Plain:
        def __init__(self, f):
            self.get_info, self.get_revision = f.get_info, f.get_revision

    client = _hub_of(tmp_path, "acme/packed").client()
    source = episodes.RemoteSource(Plain(client), lambda repo, path: f"file://{tmp_path}/{repo}/{path}")
    info = source.info("acme/packed")
    notes = [survey.deep_records(spark, source, [("acme/packed", "", "RemoteSource", "", None)], {"acme/packed": (info, "", "")}, n).first()["note"] for n in (None, 1)]
    assert notes == [survey.PARTIAL, ""]


def test_lock_is_exclusive(tmp_path):
    with survey.lock(tmp_path):
        with pytest.raises(survey.SurveyLocked, match="pid"), survey.lock(tmp_path):
            pass
        with survey.lock(tmp_path, force=True):
            pass
    with pytest.raises(KeyError), survey.lock(tmp_path):
        raise KeyError
    with survey.lock(tmp_path):
        pass


def test_survey_end_to_end(spark, tmp_path):
    root, out = tmp_path / "data", tmp_path / "out"
    for i, d in enumerate(("", "identity")):
        synth.write(synth.episodes(n_eps=2, T=60, defect=d, seed=i), root, f"org/{i}", "packed")
    synth.write(synth.episodes(n_eps=1, T=40), root, "org/broken", "packed")
    (root / "org/broken/data/chunk-000/file-000.parquet").write_bytes(b"junk")
    src = episodes.LocalSource(spark, str(root))
    people = ["org/0", "org/1", "org/broken", "org/none"]
    assert survey.run(spark, src, people, out, sample_size=10) == {"metadata": 4, "deep": 4}
    deep = {r["repo"]: r for r in ledger.read(spark, f"{out}/deep.jsonl").collect()}
    assert deep["org/0"]["flags"] == "" and deep["org/1"]["flags"] == "action_equals_state" and deep["org/none"]["error"] == "no info.json" and deep["org/broken"]["error"] != ""
    meta = {r["repo"]: r for r in ledger.read(spark, f"{out}/metadata.jsonl").collect()}
    assert (meta["org/0"]["layout_family"], meta["org/0"]["total_episodes"], meta["org/none"]["layout_family"]) == ("packed", 2, "")
    record = json.loads((out / "sample.json").read_text())
    assert record["frame_size"] == 4 and len(record["sample"]) == 4 and len(record["frame_sha256"]) == 64
    assert survey.run(spark, src, people, out, sample_size=10, resume=True) == {"metadata": 0, "deep": 0}
    with pytest.raises(FileExistsError):
        survey.run(spark, src, people, out, sample_size=10)
    with pytest.raises(ValueError):
        survey.run(spark, src, people, out, tier="third")


def test_synthetic_source_surveys_itself(spark, tmp_path):
    src = episodes.SyntheticSource(spark, {"n_eps": 2, "T": 60})
    survey.run(spark, src, ["synthetic/clean", "synthetic/swapped"], tmp_path, tier="deep")
    got = {r["repo"]: r["flags"] for r in ledger.read(spark, f"{tmp_path}/deep.jsonl").collect()}
    assert got["synthetic/swapped"] == "negative_lag"


def test_thresholds(tmp_path):
    assert thresholds.load() == thresholds.DEFAULTS
    p = tmp_path / "t.toml"
    p.write_text("[thresholds]\n" + "\n".join(f"{k} = {v}" for k, v in thresholds.DEFAULTS.items()))
    assert thresholds.load(p) == thresholds.DEFAULTS
    for bad in ("frac_bad_dt = 2", "frac_bad_dt = -1", 'frac_bad_dt = "x"', ""):
        p.write_text("[thresholds]\n" + bad)
        with pytest.raises(ValueError):
            thresholds.load(p)


def test_synthetic_defects_are_checked():
    with pytest.raises(ValueError):
        synth.episodes(defect="other")
    t = synth.episodes(n_eps=2, T=80, defect="drops")
    assert t.num_rows == 150 and np.unique(t["frame_index"].to_numpy()[:70]).tolist() == list(range(70))
