"""The stages of corpus_pipeline.py: each takes (spark, docs, sf_dir) and works on all rows of docs.

Rows whose doc_id is null are kept by the deduplication stage and carried through; empty and null texts are clean.
An empty table gives empty results of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, jaccard, secrets, toxicity
from .common import row_key, small_side, table, tuned, written
from .queries import BYTE_BPE


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier calls toxic. It is fitted on a bounded sample of the labelled documents of the learning fold."""
    tuned(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out("doc_id", 0, 5))
    return toxicity.score(docs, model, docs.columns, out="_wayloom_score").filter("_wayloom_score < 0.5").drop("_wayloom_score")


def near_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of similar texts the document with the smallest id, and of rows with one id one."""
    member, _ = jaccard.jaccard_join(docs)
    gone, _ = written(member.filter("doc_id is not null and doc_id != component_id").select("doc_id").distinct(), "gone")
    kept = docs.join(small_side(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)
    again, _ = written(member.filter("doc_id is not null and doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    n = again.count()
    if not n:
        return kept
    twice = small_side(again, n)
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(kept.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a ten-word window of a benchmark item."""
    items, _ = written(decontam.items_of(table(spark, sf_dir, "benchmark"), "item_id", "text"), "items")
    named = docs.withColumn(secrets.ROW, row_key("doc_id", "text"))
    hit, _ = written(decontam.hit_windows(named.select(F.col(secrets.ROW).alias("key"), "text"), items, decontam.item_windows(items, 10)[0]).select(F.col("key").alias(secrets.ROW)).distinct(), "leaks")
    return named.join(small_side(hit, hit.count()), secrets.ROW, "left_anti").select(*docs.columns)


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets and linked credentials in the texts; n_chars follows where the text changed."""
    out = secrets.redacted(docs.withColumn("_wayloom_was", F.length("text")))
    if "n_chars" in docs.columns:
        moved = (F.col("n_chars") + F.length("text") - F.col("_wayloom_was")).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.coalesce(moved, F.col("n_chars")))
    return out.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: token counts and digests of each kept document."""
    return bpe.round_trip(docs, BYTE_BPE)


STAGES = [("toxicity", toxic_out), ("near duplicates", near_out), ("benchmark leaks", leaks_out), ("secrets", secrets_out), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str, stages: list) -> DataFrame:
    """Applies the stages to documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in stages:
        docs, _ = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
