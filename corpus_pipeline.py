"""The corpus pipeline: documents to training sequences, one written stage after the other."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from srcgraph.llm import decontaminate, minhash, packing, phrases, quality
from srcgraph.llm.tables import shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line model reject go."""
    kept = quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return kept.select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    gone = minhash.near_duplicates(docs).where("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; a document of which nothing is left goes."""
    cleaned = phrases.removed(docs.select(*COLUMNS)).where("n_removed < n_words OR n_words = 0")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    length = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    return cleaned.select("row.doc_id", text.alias("text"), "row.lang", "row.source", length.alias("n_chars"))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    bad = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id")
    return docs.join(bad, "doc_id", "left_anti").select(*COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place in a training sequence."""
    return packing.best_fit(docs)


STAGES = [
    ("quality rules", quality_rules), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages),
    ("benchmark decontamination", benchmark_free), ("packing", packed_sequences),
]
ORACLE_SQL = None  # the line model of the first stage has no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = os.path.join(shared_folder(spark), f"stage-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
