"""A corpus of sequences and what can be asked of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import frequency, locate, packed, sinks, windows
from . import fasta
from .place import kept
from .stored import CHUNKS, DIRECTORY, OVERLAP, SPAN, cut, reach

#: Files whose numbers are broadcast.
MANY_FILES = 50_000
FORMATS = ("raw", "txt", "wig", "bedgraph", "bed", "csv")


@dataclass(frozen=True)
class Corpus:
    """Sequences in files: a directory (stored.DIRECTORY) and chunks of bases (stored.CHUNKS). Build it once, save it as
    Parquet, ask often."""

    directory: DataFrame
    chunks: DataFrame
    span: int = SPAN
    overlap: int = OVERLAP
    is_directory: bool = True

    @classmethod
    def from_fasta(cls, spark: SparkSession, path: str, span: int = SPAN, overlap: int = OVERLAP) -> Corpus:
        return cls(*fasta.read(spark, path, False, span, overlap), span, overlap, False)

    @classmethod
    def from_directory(cls, spark: SparkSession, path: str, span: int = SPAN, overlap: int = OVERLAP) -> Corpus:
        return cls(*fasta.read(spark, path, True, span, overlap), span, overlap)

    @classmethod
    def from_table(cls, rows: DataFrame, file_name: str, seq: str, seq_id: str, seq_name: str | None = None, span: int = SPAN, overlap: int = OVERLAP) -> Corpus:
        """Any table with a text column; files are numbered by name, a null name counts as empty. seq_id is a number that is
        unique within its file."""
        named = rows.select(F.coalesce(F.col(file_name).cast("string"), F.lit("")).alias("file_name"), F.col(seq_id).cast("long").alias("seq_id"), F.col(seq_name or seq_id).cast("string").alias("seq_name"), F.coalesce(F.col(seq), F.lit("")).alias("given"))
        made = kept(cut(named, ["file_name", "seq_id", "seq_name"], "given", span, overlap, clean=True), "cut")
        # one row per file
        numbered = made.select("file_name").distinct().select("file_name", (F.dense_rank().over(Window.orderBy("file_name")) - 1).alias("file_id"))
        # not broadcast if each sequence is a file of its own
        numbered = F.broadcast(numbered) if made.agg(F.approx_count_distinct("file_name")).first()[0] <= MANY_FILES else numbered
        listed = made.filter("chunk_start = 0").select("file_name", "seq_id", "seq_name", "seq_len").join(numbered, "file_name")
        chunks = made.join(numbered, "file_name").select("file_id", "seq_id", "seq_len", "chunk_start", "bases")
        chunks._kept_path = made._kept_path
        return cls(listed.select("file_id", "file_name", "seq_id", "seq_name", "seq_len"), chunks, span, overlap)

    def save(self, path: str) -> Corpus:
        """Writes directory, chunks (by file) and meta; fails where they exist. Returns the saved corpus."""
        self.directory.write.mode("errorifexists").parquet(f"{path}/directory")
        self.chunks.write.partitionBy("file_id").mode("errorifexists").parquet(f"{path}/chunks")
        spark = self.directory.sparkSession
        saved = Corpus(*self._tables(spark, path), self.span, self.overlap, self.is_directory)
        saved.meta().coalesce(1).write.mode("errorifexists").parquet(f"{path}/meta")
        return saved

    @staticmethod
    def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
        return spark.read.schema(DIRECTORY).parquet(f"{path}/directory"), spark.read.schema(CHUNKS).parquet(f"{path}/chunks")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Corpus:
        """A saved corpus. Keys of its meta row that an older one lacks have their defaults."""
        meta = spark.read.parquet(f"{path}/meta")
        row = {**{"span": SPAN, "overlap": OVERLAP, "is_directory": True}, **{k: v for k, v in meta.first().asDict().items() if v is not None}}
        return cls(*cls._tables(spark, path), row["span"], row["overlap"], row["is_directory"])

    def meta(self) -> DataFrame:
        """One row: alphabet, is_directory, n_seq, max_len, total_len, span, overlap."""
        return self.statistics().select(F.when(F.col("has_n"), "ACGTN").otherwise("ACGT").alias("alphabet"), F.lit(self.is_directory).alias("is_directory"), "n_seq", "max_len", "total_len", F.lit(self.span).alias("span"), F.lit(self.overlap).alias("overlap"))

    def reaching(self, k: int) -> DataFrame:
        """Chunks with enough bases for windows of k."""
        return reach(self.chunks, k, self.span, self.overlap)

    def statistics(self) -> DataFrame:
        return windows.statistics(self)

    def cumulative(self) -> DataFrame:
        return windows.cumulative(self.directory)

    def per_file(self) -> DataFrame:
        return windows.per_file(self.directory)

    def frequency(self, k: int, errors: int = 0, reverse_complement: bool = True, exclude_pseudo: bool = False, selection: DataFrame | None = None) -> DataFrame:
        windows.validate(self.directory, selection)
        return frequency.frequency(self, k, errors, reverse_complement, exclude_pseudo, selection)

    def in_chunks(self, k: int, reverse_complement: bool = True, exclude_pseudo: bool = False) -> DataFrame:
        """Frequencies without errors, a row for each chunk: the sinks take them as they take frequency()."""
        return frequency.in_chunks(self, k, reverse_complement, exclude_pseudo)

    def mappability(self, k: int, errors: int = 0, value: str = "mappability", **options) -> DataFrame:
        """Dense: one row per base, with freq and value."""
        if errors == 0 and options.get("selection") is None:
            freq = self.in_chunks(k, options.get("reverse_complement", True), options.get("exclude_pseudo", False))
            return frequency.with_value(packed.dense_rows(freq, self.span), value)
        freq = self.frequency(k, errors, **options)
        chosen = frequency.selected(self.directory, options.get("selection"))
        return frequency.with_value(frequency.dense(freq, chosen), value)

    def locate(self, k: int, errors: int = 0, reverse_complement: bool = True, selection: DataFrame | None = None) -> DataFrame:
        windows.validate(self.directory, selection)
        return locate.locate(self, k, errors, reverse_complement, selection)

    def write(self, path: str, k: int, errors: int = 0, value: str = "mappability", formats: tuple[str, ...] = ("bedgraph",), reverse_complement: bool = True, exclude_pseudo: bool = False, selection: DataFrame | None = None, prefix: str | None = None) -> None:
        """Writes the outputs (raw, txt, wig, bedgraph, bed, csv) of each file; with a selection, of files that have one. A
        corpus of one file may be given a ``prefix`` instead of its file's name."""
        if not formats:
            raise ValueError("at least one output format is needed")
        unknown = set(formats) - set(FORMATS)
        if unknown:
            raise ValueError(f"unknown format {', '.join(sorted(unknown))}")
        if prefix is not None and self.is_directory:
            raise ValueError("a prefix is for a corpus of one file")
        if errors == 0 and selection is None:
            freq = self.in_chunks(k, reverse_complement, exclude_pseudo).persist()
        else:
            freq = self.frequency(k, errors, reverse_complement, exclude_pseudo, selection).persist()
        chosen = frequency.selected(self.directory, selection)
        for name in formats:
            if name == "raw":
                sinks.write_raw(sinks.raw(freq, chosen, value, span=self.span), path, value, prefix)
            elif name == "csv":
                found = self.locate(k, errors, reverse_complement, selection)
                lines = locate.csv_rows(found, self.directory, reverse_complement).join(chosen.select("file_id", "file_name").distinct(), "file_id").withColumn("start", F.col("pos"))
                names = [r.file_name for r in self.directory.select("file_name").distinct().orderBy("file_name").collect()]
                sinks.write_lines(lines, path, "csv", locate.csv_header(names, reverse_complement), prefix)
            else:
                sinks.write_lines(getattr(sinks, name)(freq, chosen, value, self.span), path, name, None, prefix)
                if name == "wig":
                    sinks.write_lines(sinks.chrom_sizes(chosen), path, "chrom.sizes", None, prefix)
        freq.unpersist()
