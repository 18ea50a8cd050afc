"""A corpus pipeline: quality rules, near-duplicates, personal data, mixing by source, token ids.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs, with the columns of documents (the last one
adds token ids and the text they decode to). Null texts go in the first stage, as texts with fewer than 20 words do; a null doc_id, a null
source, repeated rows and further columns, whatever their names, are kept through all stages but where one of several equal texts goes.
Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argloom.llm import mixing, near_dedup, pii, quality_rules, sentencepiece_codec
from argloom.llm.shared import small_batches, table, written

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Up to so many ids of removed documents (8 bytes each) are sent to all tasks; more are joined by a shuffle.
BROADCAST_REMOVED = 400_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest, which is fitted on these documents."""
    small_batches(spark)
    stats = written(quality_rules.statistics(docs), "quality-statistics")
    return quality_rules.keep(docs, quality_rules.fit(stats, table(spark, sf_dir, "labels")))


def _few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(BROADCAST_REMOVED + 1).count() <= BROADCAST_REMOVED else table


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id; of rows without one, or with one that an earlier
    row has, each counts as a document behind all others. docs must be a stored table: rows are told by their place in it."""
    small_batches(spark)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.monotonically_increasing_id().alias("row"))
    again = rows.where("own.doc_id is not null").groupBy(F.col("own.doc_id").alias("d")).agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").select("d", "first")
    rows = rows.join(_few(written(again, "repeated-ids")), F.col("own.doc_id") == F.col("d"), "left")
    alone = F.col("own.doc_id").isNotNull() & (F.col("first").isNull() | (F.col("first") == F.col("row")))
    rows = rows.select("own", F.when(alone, F.col("own.doc_id")).otherwise(F.col("row") + (1 << 62)).alias("key"))
    removed = written(near_dedup.run(rows.select(F.col("key").alias("doc_id"), "own.text")).where("not kept").select(F.col("doc_id").alias("key")), "near-duplicates")
    return rows.join(_few(removed), "key", "left_anti").select("own.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind of personal data in its place."""
    small_batches(spark)
    return pii.redact(docs, pii.train(docs)).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    small_batches(spark)
    return mixing.resampled(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text they decode to."""
    small_batches(spark)
    return sentencepiece_codec.encode(docs, MODEL, decoded="decoded")


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixed), ("sentencepiece", tokens)]
#: Forests, registers and segmentation are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
