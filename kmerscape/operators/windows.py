"""Windows of sequences: k-mers with multiplicities, postings, statistics.

Operators take a corpus: its ``directory`` (names and lengths), its ``chunks`` (bases with an overlap), and ``reaching(k)``,
the chunks that have enough bases for windows of k. A window belongs to the chunk whose span it starts in, so each is made
once, and none spans two sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabet import n_count, revcomp
from ..sources.stored import once
from .packed import different_per_sequence, kmer_counts


def check_k(k: int) -> None:
    if k < 1:
        raise ValueError("k must be at least 1")


def from_chunks(chunks: DataFrame, k: int, span: int, other_strand: bool = False) -> DataFrame:
    """(file_id, seq_id, pos, kmer): one row per window. ``other_strand`` adds rc, the reverse complement, which is cut from
    the chunk's. Bases are bytes, so a window costs its length wherever in the chunk it lies."""
    own = chunks.filter(F.length("bases") >= k)
    if other_strand:
        own = once(own, "other", revcomp(F.col("bases")).cast("binary"))
    last = F.least(F.lit(span - 1), F.length("bases") - k)
    each = own.select("*", F.col("bases").cast("binary").alias("raw"), F.explode(F.sequence(F.lit(0), last)).alias("o"))
    kmer = F.substring("raw", F.col("o") + 1, F.lit(k)).cast("string").alias("kmer")
    rc = [F.substring("other", F.length("other") - F.col("o") - k + 1, F.lit(k)).cast("string").alias("rc")] if other_strand else []
    return each.select("file_id", "seq_id", (F.col("chunk_start") + F.col("o")).alias("pos"), kmer, *rc)


def windows(corpus, k: int, other_strand: bool = False) -> DataFrame:
    check_k(k)
    return from_chunks(corpus.reaching(k), k, corpus.span, other_strand)


def wanted_chunks(corpus, selection: DataFrame) -> DataFrame:
    """(file_id, seq_id, chunk_start) of the chunks in which an interval has positions."""
    named = corpus.directory.select("file_id", "seq_id", "seq_name").join(selection.filter("end > begin"), "seq_name")
    first, last = F.floor(F.col("begin") / corpus.span), F.floor((F.col("end") - 1) / corpus.span)
    return named.select("file_id", "seq_id", F.explode(F.sequence(first, last)).alias("c")).select("file_id", "seq_id", (F.col("c") * corpus.span).alias("chunk_start")).distinct()


def asking(corpus, k: int, selection: DataFrame | None, other_strand: bool = False) -> DataFrame:
    """The windows that ask: all, or those that start in an interval. Chunks without an interval are left out before any
    window is made."""
    check_k(k)
    if selection is None:
        return windows(corpus, k, other_strand)
    chunks = corpus.reaching(k).join(wanted_chunks(corpus, selection), ["file_id", "seq_id", "chunk_start"], "left_semi")
    return in_intervals(from_chunks(chunks, k, corpus.span, other_strand), corpus.directory, selection)


def total(directory: DataFrame, k: int) -> int:
    """The number of windows."""
    return directory.agg(F.coalesce(F.sum(F.greatest(F.col("seq_len") - k + 1, F.lit(0))), F.lit(0))).first()[0]


def positions(directory: DataFrame, stretch: int = 1 << 16) -> DataFrame:
    """(file_id, seq_id, pos) of every base; a sequence is dealt in stretches."""
    parts = directory.filter("seq_len > 0").select("file_id", "seq_id", "seq_len", F.explode(F.sequence(F.lit(0).cast("long"), F.col("seq_len") - 1, F.lit(stretch).cast("long"))).alias("first"))
    dealt = parts.repartition("file_id", "seq_id", "first")
    return dealt.select("file_id", "seq_id", F.explode(F.sequence("first", F.least(F.col("first") + stretch, "seq_len") - 1)).alias("pos"))


def kmers(wins: DataFrame, errors: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct k-mers with at most ``errors`` Ns and how often each occurs (by file, if asked)."""
    few = n_count(F.col("kmer")) <= errors if errors else ~F.contains("kmer", F.lit("N"))
    return wins.filter(few).groupBy("kmer", *by).agg(F.count("*").alias("cnt"))


def counted(corpus, k: int, errors: int = 0, by_file: bool = False) -> DataFrame:
    """As kmers() of all windows of a corpus, counted in groups of chunks before any k-mer is a row."""
    check_k(k)
    found = kmer_counts(corpus, k, total(corpus.directory, k), errors, by_file)
    return found.select("kmer", *(["file_id"] if by_file else []), "cnt")


def shared(corpus, k: int, files: int) -> DataFrame:
    """(marker, n): canonical k-mers without an N that at least ``files`` files have, and their number of windows."""
    check_k(k)
    return kmer_counts(corpus, k, total(corpus.directory, k), both=True, least_files=files).select(F.col("kmer").alias("marker"), F.col("cnt").alias("n"))


def per_sequence(corpus, k: int) -> DataFrame:
    """(file_id, seq_id, n, different): windows and different k-mers of each sequence, those with Ns included."""
    check_k(k)
    return different_per_sequence(corpus, k)


def postings(wins: DataFrame) -> DataFrame:
    return wins.select("kmer", F.col("file_id").alias("hit_file_id"), F.col("seq_id").alias("hit_seq_id"), F.col("pos").alias("hit_pos"))


def statistics(corpus) -> DataFrame:
    """Number of sequences, longest, total length with one sentinel each, and whether an N occurs."""
    own = corpus.directory.agg(F.count("*").alias("n_seq"), F.max("seq_len").alias("max_len"), (F.sum("seq_len") + F.count("*")).alias("total_len"))
    return own.join(F.broadcast(corpus.chunks.agg(F.max(F.contains("bases", F.lit("N"))).alias("has_n"))))  # two single rows


def cumulative(directory: DataFrame) -> DataFrame:
    """The directory with cumulative lengths within the file."""
    before = Window.partitionBy("file_id").orderBy("seq_id").rowsBetween(Window.unboundedPreceding, -1)
    return directory.select("file_id", "file_name", "seq_id", "seq_name", "seq_len", F.coalesce(F.sum("seq_len").over(before), F.lit(0).cast("long")).alias("before"))


def per_file(directory: DataFrame) -> DataFrame:
    """(file_id, file_name, n_seq, total_len)."""
    return directory.groupBy("file_id", "file_name").agg(F.count("*").alias("n_seq"), F.sum("seq_len").alias("total_len"))


def selected_fraction(directory: DataFrame, intervals: DataFrame) -> DataFrame:
    """(file_id, file_name, fraction): selected bases of each file that has any, to all its bases; overlaps count twice."""
    chosen = directory.join(intervals, "seq_name").groupBy("file_id").agg(F.sum(F.col("end") - F.col("begin")).alias("chosen"))
    return per_file(directory).join(chosen, "file_id").select("file_id", "file_name", (F.col("chosen") / F.col("total_len")).alias("fraction"))


def out_of_range(directory: DataFrame, selection: DataFrame) -> DataFrame:
    """The intervals that lie outside a sequence of their name, or end before they begin, with its length."""
    outside = (F.col("begin") < 0) | (F.col("end") < F.col("begin")) | (F.col("begin") >= F.col("seq_len")) | (F.col("end") > F.col("seq_len"))
    return directory.select("seq_name", "seq_len").join(selection, "seq_name").filter(outside)


def validate(directory: DataFrame, selection: DataFrame | None) -> None:
    """Raises ValueError for an interval that is out of range. Unknown names are ignored."""
    bad = out_of_range(directory, selection).limit(1).collect() if selection is not None else []
    if bad:
        raise ValueError(f"interval {bad[0].begin}-{bad[0].end} is out of range for {bad[0].seq_name} of length {bad[0].seq_len}")


def in_intervals(rows: DataFrame, directory: DataFrame, intervals: DataFrame, pos: str = "pos", bin_bits: int = 12) -> DataFrame:
    """The rows whose position lies in an interval of their sequence's name (half-open). Intervals meet positions in bins,
    so long lists of intervals join by equality instead of by comparison with all."""
    named = directory.select("file_id", "seq_id", "seq_name").join(intervals.filter("end > begin"), "seq_name")
    low, high = F.shiftright(F.col("begin"), bin_bits), F.shiftright(F.col("end") - 1, bin_bits)
    binned = named.select("file_id", "seq_id", "begin", "end", F.explode(F.sequence(low, high)).alias("bin"))
    a, b = rows.alias("a"), binned.alias("b")
    at: Column = F.col(f"a.{pos}")
    same = (F.col("a.file_id") == F.col("b.file_id")) & (F.col("a.seq_id") == F.col("b.seq_id")) & (F.shiftright(at, bin_bits) == F.col("b.bin"))
    return a.join(b, same & (at >= F.col("b.begin")) & (at < F.col("b.end")), "left_semi")
