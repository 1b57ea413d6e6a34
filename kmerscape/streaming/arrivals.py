"""Sequences that arrive over time, asked against a fixed corpus (an extension; the batch operators need none of this)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.alphabet import canonical, revcomp
from ..operators.packed import FREQ, Plan, against, exploded, parts_of, spans, stored_counts
from ..operators.windows import check_k, from_chunks, total, windows
from ..sources.stored import SPAN


def canonical_counts(corpus, k: int) -> DataFrame:
    """(key, freq): both-strand frequency of each k-mer of the corpus under its canonical form. Write it once."""
    wins = windows(corpus, k).filter(~F.contains("kmer", F.lit("N")))
    counted = wins.groupBy(canonical(F.col("kmer")).alias("key")).agg(F.count("*").alias("n"))
    return counted.select("key", F.when(F.col("key") == revcomp(F.col("key")), 2 * F.col("n")).otherwise(F.col("n")).alias("freq"))


def arriving_frequency(arrivals: DataFrame, counts: DataFrame, k: int, span: int = SPAN) -> DataFrame:
    """(file_id, seq_id, pos, freq) of the windows of a stream of chunks: how often the corpus has them. A stateless
    stream-static join, so it needs no watermark; windows that the corpus lacks have freq 0."""
    wins = from_chunks(arrivals, k, span).withColumn("key", canonical(F.col("kmer")))
    return wins.join(counts, "key", "left").select("file_id", "seq_id", "pos", F.coalesce("freq", F.lit(0).cast("long")).alias("freq"))


@dataclass(frozen=True)
class _Arrived:
    """The chunks of a micro-batch, in the place of a corpus."""

    chunks: DataFrame
    span: int

    def reaching(self, k: int) -> DataFrame:
        return self.chunks


@dataclass(frozen=True)
class Against:
    """The counts of a fixed corpus at a path, and what streams of chunks ask of them. Each micro-batch is asked in groups of
    chunks and written under its number, so one that is run again overwrites itself."""

    path: str
    plan: Plan

    @classmethod
    def counted(cls, corpus, k: int, path: str) -> Against:
        check_k(k)
        if k - 1 > corpus.overlap:
            raise ValueError(f"k is at most {corpus.overlap + 1}: a chunk that arrives has no next one")
        plan = Plan(k, corpus.span, parts_of(total(corpus.directory, k), len(spans(k, 2))), both=True)
        stored_counts(corpus, plan).write.parquet(path)
        return cls(path, plan)

    def write(self, arrivals: DataFrame, out: str, marks: str) -> StreamingQuery:
        """Starts a query that answers what has arrived; read() has its rows."""
        def answer(batch: DataFrame, number: int) -> None:
            counts = batch.sparkSession.read.parquet(self.path)
            against(_Arrived(batch, self.plan.span), counts, self.plan).write.mode("overwrite").parquet(f"{out}/batch={number}")

        return arrivals.writeStream.foreachBatch(answer).option("checkpointLocation", marks).trigger(availableNow=True).start()

    def read(self, spark: SparkSession, out: str) -> DataFrame:
        """(file_id, seq_id, pos, freq) of the windows that have arrived; 0 for those that the corpus lacks."""
        return exploded(spark.read.schema(FREQ).parquet(f"{out}/batch=*"), zeros=True)
