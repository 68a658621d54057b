"""The pipeline's stages, each on what the one before kept, against plain versions."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import plain_groups, plain_report, plain_targets, prose, split_words

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(21)
    item = "one two three four five six seven eight nine ten eleven"
    texts = [prose(rng, rng.randint(30, 90)).capitalize() + "." for _ in range(160)]
    texts += [" ".join(w.upper() + "!!" for w in prose(rng, 40).split()) for _ in range(60)]
    texts += [texts[3], texts[3] + " ba", texts[5], f"{texts[7]} And {item}. {prose(rng, 30)}."]
    docs = [(i, t, "en", rng.choice(["a", "b", None]), len(t)) for i, t in enumerate(texts)]
    labels = [(i, int(i < 160), 0) for i in range(220)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out, docs = [spark.read.parquet(f"{folder}/documents.parquet")], folder
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, out[-1], folder).write.parquet(f"{folder}/stage-{k}")
        out.append(spark.read.parquet(f"{folder}/stage-{k}"))
    return folder, out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_and_order(made):
    _, out = made
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "token_output"]
    assert all(df.columns == out[0].columns for df in out[1:-1])


def test_quality_drops_shouting(made):
    _, out = made
    kept = set(rows(out[1]))
    assert len(kept & set(range(160))) >= 155 and not kept & set(range(160, 220))


def test_one_of_each_group_stays(made):
    _, out = made
    before, after = rows(out[1]), rows(out[2])
    ids = sorted(before)
    groups, _ = plain_groups([before[i]["text"] for i in ids], 5)
    assert set(after) == {ids[g] for g in groups}


def test_passages_are_cut(made):
    _, out = made
    before, after = rows(out[2]), rows(out[3])
    item = "one two three four five six seven eight nine ten eleven"
    for i, r in after.items():
        assert plain_report(r["text"], [(1, item)])[1] == 0 and r["n_chars"] == len(r["text"])
        if plain_report(before[i]["text"], [(1, item)])[1] == 0:
            assert r["text"] == before[i]["text"]
    assert set(before) == set(after)


def test_mix_meets_its_targets(made):
    _, out = made
    before, taken, sizes = rows(out[3]), {}, {}
    for r in out[4].collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(split_words(r["text"]))
        assert r["text"] == before[r["doc_id"]]["text"]
    for r in before.values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(split_words(r["text"]))
    for s, want in plain_targets(sizes).items():
        assert abs(taken.get(s, 0) - want) <= 130


def test_tokens_are_those_of_the_mix(spark, made):
    folder, out = made
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, got = 0, sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out[5].collect())
    for (at, i, n, crc), r in zip(got, sorted(out[4].collect(), key=lambda r: r["doc_id"]), strict=True):
        ids = plain.encode(r["text"], add_special_tokens=False).ids + [2]
        assert (at, i, n, crc) == (start, r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sorted(map(tuple, pipeline.run(spark, folder).collect())) == sorted(map(tuple, out[5].collect()))


def test_odd_rows_and_clashing_names(spark, made, tmp_path):
    """Null and empty texts, no id, repeated rows, a very long text, and columns named as the stages' own."""
    folder, _ = made
    rng = random.Random(22)
    good = [prose(rng, 40).capitalize() + "." for _ in range(8)]
    long = " ".join(prose(rng, 30).capitalize() + "." for _ in range(3_000))
    texts = [(1, None), (2, ""), (3, good[0]), (3, good[0]), (None, good[1]), (5, good[2]), (6, good[2]), (7, long), (8, good[3])]
    names = {c: F.lit(-7) for c in ("__score", "__maybe", "__size", "__of", "__bits", "__uid", "node", "component")}
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in texts], SCHEMA).withColumns(names)
    now = docs
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, now, folder).write.parquet(str(tmp_path / f"odd-{k}"))
        now = spark.read.parquet(str(tmp_path / f"odd-{k}"))
        if name != "token_output":
            assert now.columns == docs.columns and {tuple(r) for r in now.select(*names).collect()} == {(-7,) * len(names)}
        if name == "quality":
            assert {(r["doc_id"], r["text"]) for r in now.collect()} >= {(3, good[0]), (None, good[1]), (7, long)}
        if name == "near_dedup":
            kept = [(r["doc_id"], r["text"]) for r in now.collect()]
            assert (6, good[2]) not in kept and (5, good[2]) in kept and kept.count((3, good[0])) == 2 and (None, good[1]) in kept and (7, long) in kept
    assert now.count() > 0
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
