"""Corpus pipeline: documents to packed training sequences, one Spark job per stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as
the next stage's ``docs``. All but the last return the columns of ``documents``.

Cases, for every stage: a null text is empty; the rules drop it, as any text of fewer than 50 words. Rows that repeat a doc_id are
judged one by one up to the near stage, which keeps one row of each group of like texts; rows of one doc_id that are left are one
document to the spans stage and are packed each. Rows without a doc_id are judged by their text and never count as copies. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomescope.config import DEFAULT
from tomescope.llm import classifier, near_dups, packing, quality_rules, span_dups
from tomescope.llm.common import prepare, table
from tomescope.operators.joins import bounded_broadcast
from tomescope.session import cut_lineage

NEAR_WORDS, NEAR_PERCENT = 5, 80


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at its cut or above."""
    prepare(spark)
    return classifier.keep_good(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    prepare(spark)
    counts = quality_rules.count_ngrams(docs, table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, quality_rules.log_ratios(counts))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id.

    Where doc_ids repeat, every row is a document of its own: the operator runs on row numbers (of a written table), and of
    each group the first row by (doc_id, row number) stays. Rows without a doc_id stay."""
    prepare(spark)
    ids = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    if not ids.isEmpty():
        return near_by_row(docs)
    found = near_dups.near_duplicates(docs, NEAR_WORDS, NEAR_PERCENT, "pipeline-near")
    gone = cut_lineage(found.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct(), "pipeline-near")
    gone = bounded_broadcast(gone, gone.count(), 32, DEFAULT)  # the ids while they are few, else both sides are shuffled
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def near_by_row(docs: DataFrame) -> DataFrame:
    keyed = cut_lineage(docs.withColumn("near_row", F.monotonically_increasing_id()), "pipeline-near-rows")
    named = keyed.where(F.col("doc_id").isNotNull()).select(F.col("near_row").alias("doc_id"), "text")
    found = near_dups.near_duplicates(named, NEAR_WORDS, NEAR_PERCENT, "pipeline-near").select(F.col("doc_id").alias("near_row"), F.col("component_id").alias("near_group"))
    place = F.struct("doc_id", "near_row")
    grouped = cut_lineage(found.join(keyed.select("doc_id", "near_row"), "near_row"), "pipeline-near")
    first = grouped.groupBy("near_group").agg(F.min(place).alias("first")).select("near_group", F.col("first.near_row").alias("first_row"))
    gone = grouped.join(first, "near_group").where(F.col("near_row") != F.col("first_row")).select("near_row")
    gone = cut_lineage(gone, "pipeline-near")
    return keyed.join(bounded_broadcast(gone, gone.count(), 32, DEFAULT), "near_row", "left_anti").select(*docs.columns)


def spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without sentences of repeated spans; n_chars follows the text."""
    prepare(spark)
    out = span_dups.span_dedup(docs).drop("span_sentences", "span_removed")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length with their ids."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [("classify", classify), ("rules", rules), ("near", near), ("spans", spans), ("pack", pack)]

# The stages use a trained model, hashes and a tokenizer: no SQL; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
