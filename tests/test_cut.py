"""Cutting of tables into chunks."""

from kmerscape.sources import stored
from kmerscape.sources.corpus import Corpus


def test_a_table_is_cut_in_one_pass(spark):
    """Texts, as costly as they may be to make, are made once for directory and chunks."""
    from pyspark.sql import functions as F

    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        made.add(1)
        return "acgu-ä😀" * (i + 1)

    rows = spark.range(50).select("id", (F.col("id") % 3).alias("src"), text("id").alias("body"))
    corpus = Corpus.from_table(rows, "src", "body", "id", span=16, overlap=8)
    assert corpus.directory.count() == 50 and corpus.chunks.selectExpr("sum(least(16, length(bases)))").first()[0] == 7 * sum(range(1, 51))
    assert made.value == 50
    assert corpus.chunks.filter("chunk_start = 0 and seq_id = 3").first().bases == ("ACGTNNN" * 4)[:24]


def test_plain_cut_of_wide_characters(spark):
    rows = spark.createDataFrame([(0, "aä😀b" * 10), (1, "")], "id int, seq string")
    got = [tuple(r) for r in stored.cut(rows, ["id"], "seq", 8, 4).orderBy("chunk_start").collect()]
    assert got == [(0, 40, i, ("aä😀b" * 10)[i : i + 12]) for i in range(0, 40, 8)]
