"""Exact dedup by a two-pass Bloom filter.

Pass 1 hashes every text and counts, in a Bloom filter of two-bit cells, which cells more than one row sets; a hash is sent
twice at most by a task. Pass 2 asks the filter for every row: a hash with a cell that only one row set occurs once, so its
row passes straight through. Only possibly repeated rows shuffle, as sha256 keys; groups are pre-aggregated, and a text that
a third of all rows share is one aggregate row per task. A join on the key brings the decision back, which adaptive execution
splits where it is skewed. The filter grows with the rows; it is broadcast up to ``max_bits``, beyond that rows meet its
pages in a shuffle by page.

Defined cases: null text counts as empty; null doc_id is the smallest; of rows with equal doc_id and text one stays (the
last in reading order); an empty table gives an empty result; a text of any length is hashed by the JVM as one value;
columns of any other name are kept and never read (names of the operator's own are chosen free of theirs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .shared import drop, free, written


def text_of(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def _repeated_cells(hashes: DataFrame) -> tuple[DataFrame, int]:
    """(pages of the cells that two rows or more set, number of pages of the filter)."""
    n = bloom.pages_for(hashes.count())
    return written(bloom.pages(hashes, n, least=2), "op4"), n


def _groups(keys: DataFrame) -> DataFrame:
    """(sha, best_id, best_row, size) of rows (sha, id, row). Written, so that a join with it deals both sides anew and
    adaptive execution can split a hot key's rows."""
    best = F.max(F.struct("id", "row"))
    return written(keys.groupBy("sha").agg(best.alias("best"), F.count("*").alias("size")).select("sha", F.col("best.id").alias("best_id"), F.col("best.row").alias("best_row"), "size"), "op4")


def mark(df: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """One row per row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = written(df.select(F.col(doc_id).alias("id"), F.sha2(text_of(text), 256).alias("sha"), F.xxhash64(text_of(text)).alias("h"), F.monotonically_increasing_id().alias("row")), "op4")
    cells, n = _repeated_cells(rows.select("h"))
    repeated, single = bloom.split(rows, F.col("h"), cells, n, ("page", "words"), max_bits)
    decided = repeated.join(_groups(repeated.select("sha", "id", "row")), "sha")
    return single.select(F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")).unionAll(
        decided.select(F.col("id").alias("doc_id"), F.col("best_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("best_row") == F.col("row")).alias("kept"), F.col("sha").alias("text_sha256"))
    )


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """The rows that stay, with all their columns. Rows that surely occur once don't shuffle."""
    hashes = written(df.select(F.xxhash64(text_of(text)).alias("h")), "op4")
    cells, n = _repeated_cells(hashes)
    drop(hashes)
    page, words, key, ident, row = free(df, "page", "words", "sha", "id", "row")
    repeated, single = bloom.split(df, F.xxhash64(text_of(text)), cells, n, (page, words), max_bits)
    held = written(repeated.select("*", F.sha2(text_of(text), 256).alias(key), F.col(doc_id).alias(ident), F.monotonically_increasing_id().alias(row)), "op4")
    best = _groups(held.select(F.col(key).alias("sha"), F.col(ident).alias("id"), F.col(row).alias("row"))).select(F.col("best_row").alias(row))
    return single.unionAll(held.join(best, row, "left_semi").drop(key, ident, row))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
