"""The training-data pipeline over `documents`, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of documents. run()
writes each stage's table to the shared folder and hands the written table on, so a lost executor costs no more than
its part of one stage. No stage can be said in SQL as a whole, so there is no ORACLE_SQL: tests/llm/test_pipeline.py
holds the stages against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.base import Scratch, maybe_in, remainder, table, unused
from plumbline.llm.decontaminate import clean
from plumbline.llm.mixing import apply_mix
from plumbline.llm.neardup import near_duplicates
from plumbline.llm.quality import keep_good
from plumbline.llm.tokens import read_tokens, write_tokens

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are judged as texts without words; rows without an
    id and repeated rows by their text; other columns stay, whatever their names; an empty table gives no rows."""
    labelled = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2).select("doc_id", F.col("quality").alias("label"))
    return keep_good(docs, labelled)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays.

    That is the smallest doc_id; rows that share it go or stay together. Documents without an id, without a text or
    without words are in no group and stay. Other columns stay, whatever their names; an empty table gives no rows.
    """
    scratch = Scratch(spark, "pipeline-near")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    gone = scratch.keep(near_duplicates(docs, scratch, k=5, percent=80).where("not kept").select("doc_id"), "gone")
    # only documents that a bitmap of the ids that go lets through are shuffled to be told from them
    (maybe,) = unused(docs, "maybe")
    marked = maybe_in(docs, "doc_id", gone, "doc_id", maybe)
    rest = marked.where(maybe).join(gone.withColumnRenamed("doc_id", "__gone"), F.col("doc_id") == F.col("__gone"), "left_anti")
    out = marked.where(~F.col(maybe)).select(*columns).unionAll(rest.select(*columns))
    out._scratch = scratch
    return out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stretches shared with benchmark items are cut out; documents that are mostly such go. Null and empty texts stay as
    they are; repeated rows are treated alike; other columns stay but n_chars, which follows the text; empty tables give
    no rows or cut nothing."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it. Null and empty texts have no words and go; a null source is
    a source; equal rows share their fate; other columns stay, whatever their names; an empty table gives no rows."""
    scratch = Scratch(spark, "pipeline-mix")
    out = apply_mix(docs, scratch)
    out._scratch = scratch
    return out


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all that is left, and one row a document read back from them: copies a row each, null and empty
    texts the end id alone, rows without an id first; an empty table gives no rows."""
    return read_tokens(write_tokens(docs, Scratch(spark, "pipeline-tokens"), TOKENIZER))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        docs = scratch.keep(made, name)
        if hasattr(made, "_scratch"):
            made._scratch.clear()  # what the stage wrote for itself
    out = STAGES[-1][1](spark, docs, sf_dir)
    scratch.clear()  # the token files are written
    return out
