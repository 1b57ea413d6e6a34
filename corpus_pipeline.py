"""A corpus pipeline: quality, exact dedup, near-duplicate dedup, substring dedup, packing.

Each stage is written as Parquet and read again as the next one's documents. All but the last return the columns of
documents; a stage works on all rows that the one before kept.

Defined cases: null text counts as empty and passes until a stage finds copies of it (exact dedup keeps one empty text); a null
doc_id is a document like others; of repeated rows one stays; texts of any length are taken whole; columns of other names are
kept by all stages but the last, whatever they are called; an empty table gives no piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kmerscape.llm import op4_exact_dedup, op5_substring_dedup, op7_quality, op8_ngram_join, op9_packing
from kmerscape.llm.shared import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return op7_quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return op4_exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links of similarity 0.8 or more connect the one with the smallest doc_id stays."""
    return op8_ngram_join.dedup(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows of 35 words go; a document that loses words has the rest joined by spaces."""
    from pyspark.sql import functions as F

    kept = op5_substring_dedup.dedup(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else kept


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, with their ids."""
    return op9_packing.pack(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("substring dedup", substrings), ("packing", packing)]
#: SQL can't express the classifier, the tokenizer or the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, "stage")
    return docs
