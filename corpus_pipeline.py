"""Corpus pipeline: quality, near-duplicates, decontamination, personal data, tokens.

Every stage takes (spark, docs, sf_dir), works on all rows of docs, and
returns the columns of docs for the rows that it keeps; the last one adds the
tokens. docs has the columns of the documents table and may have more.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseline.llm import op3_bpe, op4_quality, op5_pii, op7_decontaminate, op10_near_dups
from proseline.llm.common import remove, shared_path, stored, table

#: Words of a shingle, and hundredths of similarity, that make near-duplicates.
WIDTH, PERCENT = 5, 80
#: Name of the rows' own numbers; no column of the documents has it.
ROW = "_pipeline_row"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels, doesn't reject.

    The classifier learns from the documents at hand. A document is rejected
    if its score is under the threshold; one without text scores the bias.
    Without labelled documents of both kinds there is nothing to learn and
    nothing to reject: all documents stay, with a warning.
    """
    weights = op4_quality.fit(docs, table(spark, sf_dir, "labels"))
    if not weights.any():
        warnings.warn("no documents labelled good and bad to learn from: the quality stage keeps everything", stacklevel=2)
    return op4_quality.keep_documents(docs, weights)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest doc_id.

    Rows get numbers of their own first, so that repeated rows, rows without a
    doc_id and different texts under one doc_id are told apart. Documents
    without words have no near-duplicate: all of their rows stay.
    """
    rows = stored(docs.select(F.monotonically_increasing_id().alias(ROW), *(F.col(f"`{c}`") for c in docs.columns)), "pipeline-rows")
    found = op10_near_dups.near_duplicates(rows, key=ROW, width=WIDTH, percent=PERCENT).select(ROW, F.col("component_id").alias("_component"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW))
    kept = rows.select(ROW, "doc_id").join(found, ROW).groupBy("_component").agg(first.alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    return rows.join(kept, ROW, "left_semi").select([F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no copy, edited or not, of a test item."""
    return op7_decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked and n_chars counted anew."""
    masked = op5_pii.mask_documents(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else masked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids and their number."""
    return op3_bpe.with_tokens(docs)


STAGES = [("quality", keep_good), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("pii", mask_personal_data), ("encoding", encode)]

#: Learned models and alignments are beyond SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again; a stage's table goes when the next one is there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
