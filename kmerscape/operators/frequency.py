"""(K,E)-frequency and mappability of every position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import n_count, revcomp
from . import near
from .match import check, pairs, queries_of
from .packed import exploded, frequencies
from .windows import asking, check_k, counted, in_intervals, kmers, positions, total, wanted_chunks, windows

#: Largest frequency of the two output widths. Mappability is the reciprocal of the wider one.
MAX = {"freq8": 255, "freq16": 65535, "mappability": 65535}
#: A k-mer is hot if one of so many windows has it, and this many windows at least: there are HOT_SHARE hot k-mers at most.
HOT_SHARE, HOT_LEAST = 10_000, 100_000
#: Windows up to which a corpus is counted by a join of k-mers in the JVM; a larger one is counted in groups of chunks.
JOIN_WINDOWS = 1_000_000
#: Parts into which the windows of a hot k-mer are dealt.
PARTS = 256
#: Files whose bits fit into one number, and files up to which bits are used.
WORD, BIT_FILES = 63, 63 * 16


def fan_out(rows: DataFrame, counted: DataFrame, key: str, occurs: str, wins: int, share: int = HOT_SHARE, least: int = HOT_LEAST, parts: int = PARTS) -> DataFrame:
    """rows joined with counted by key, with the windows of hot keys dealt to parts. ``occurs``: the column of counted that
    says how many of ``wins`` rows have the key. Only hot keys are broadcast, ``share`` at most; counted is not, however
    small it seems to be."""
    if wins < least:
        return rows.join(counted.drop(occurs).hint("merge"), key)
    hot = F.col(occurs) >= max(least, -(-wins // share))
    named = counted.filter(hot).select(key, F.lit(True).alias("_hot"))
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64("file_id", "seq_id", "pos"), F.lit(parts)).cast("int")).otherwise(0)
    dealt = rows.join(F.broadcast(named), key, "left").withColumn("_part", part).drop("_hot")
    every = F.when(hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(counted.select("*", F.explode(every).alias("_part")).drop(occurs).hint("merge"), [key, "_part"]).drop("_part")


def _files(files: int) -> Column:
    """The number of different file_ids of a group: bits where they are few, as a count of distinct values deals twice."""
    if files > BIT_FILES:
        return F.count_distinct("file_id")
    bits = [F.bit_count(F.coalesce(F.bit_or(F.when(F.floor(F.col("file_id") / WORD) == w, F.expr(f"shiftleft(1L, file_id % {WORD})"))), F.lit(0).cast("long"))) for w in range(-(-files // WORD))]
    return sum(bits[1:], bits[0]).cast("long")


def _exact(corpus, k: int, both: bool, by_file: bool, selection: DataFrame | None, **hot) -> DataFrame:
    """(file_id, seq_id, pos, freq) without errors. Both strands meet under the canonical k-mer, in one aggregate."""
    known = ~F.contains("kmer", F.lit("N"))
    key = (F.least("kmer", "rc") if both else F.col("kmer")).alias("key")
    wins = windows(corpus, k, other_strand=both).filter(known)
    occurs = F.count("*").alias("occurs")
    if by_file:
        counted = wins.select(key, "file_id").groupBy("key").agg(_files((corpus.directory.agg(F.max("file_id")).first()[0] or 0) + 1).alias("freq"), occurs)
    elif both:
        # a palindrome is its own reverse complement and counts on both strands
        counted = wins.select(key, F.when(F.col("kmer") == F.col("rc"), 2).otherwise(1).cast("long").alias("n")).groupBy("key").agg(F.sum("n").alias("freq"), occurs)
    else:
        counted = wins.select(key).groupBy("key").agg(F.count("*").alias("freq"), occurs)
    asked = asking(corpus, k, selection, both).filter(known).select("file_id", "seq_id", "pos", key)
    return fan_out(asked, counted, "key", "occurs", total(corpus.directory, k), **hot).select("file_id", "seq_id", "pos", "freq")


def in_chunks(corpus, k: int, both: bool = True, by_file: bool = False, errors: int = 0) -> DataFrame:
    """(file_id, seq_id, seq_len, chunk_start, freq): a row for each chunk, with the frequencies of the windows that start in
    it as 64-bit numbers; 0 for a window without a hit."""
    check(k, errors)
    check_k(k)
    if errors:
        if by_file or not near.fits(k, errors):
            raise ValueError("blocks are too short, or files are to be counted; use frequency")
        return near.near_frequencies(corpus, k, errors, both, total(corpus.directory, k))
    return frequencies(corpus, k, both, by_file, total(corpus.directory, k))


def _grouped(corpus, k: int, both: bool, by_file: bool, selection: DataFrame | None, errors: int = 0) -> DataFrame:
    """As _exact, or with errors as _approximate."""
    freq = in_chunks(corpus, k, both, by_file, errors)
    if selection is None:
        return exploded(freq)
    chosen = freq.join(wanted_chunks(corpus, selection), ["file_id", "seq_id", "chunk_start"], "left_semi")
    return in_intervals(exploded(chosen), corpus.directory, selection)


def _approximate(corpus, k: int, errors: int, both: bool, by_file: bool, selection: DataFrame | None) -> DataFrame:
    wins, wanted, n = windows(corpus, k), asking(corpus, k, selection), total(corpus.directory, k)
    targets = kmers(wins, errors)
    few = n_count(F.col("kmer")) <= errors
    asked = targets.select("kmer") if selection is None else wanted.filter(few).select("kmer").distinct()
    found = pairs(queries_of(asked, both), targets, k, errors, n)
    if by_file:
        files = wins.filter(few).select(F.col("kmer").alias("hit"), "file_id").distinct()
        freq = found.select("kmer", "hit").distinct().join(files, "hit").groupBy("kmer").agg(F.count_distinct("file_id").alias("freq"))
    else:
        freq = found.groupBy("kmer").agg(F.sum("cnt").alias("freq"))
    counted = freq.join(targets.withColumnRenamed("cnt", "occurs"), "kmer", "left").withColumn("occurs", F.coalesce("occurs", F.lit(0).cast("long")))
    return fan_out(wanted, counted, "kmer", "occurs", n)


def frequency(corpus, k: int, errors: int = 0, reverse_complement: bool = True, exclude_pseudo: bool = False, selection: DataFrame | None = None) -> DataFrame:
    """(file_id, seq_id, pos, freq) of windows that have a hit. With ``exclude_pseudo`` freq is the number of files with
    one. ``selection`` (seq_name, begin, end) restricts the windows that ask, not those that answer."""
    check(k, errors)
    if errors == 0:
        exact = _exact if total(corpus.directory, k) <= JOIN_WINDOWS else _grouped
        return exact(corpus, k, reverse_complement, exclude_pseudo, selection)
    if k <= errors:  # every window matches every other one
        every = corpus.directory.filter(F.col("seq_len") >= k)
        hits = every.agg((F.count_distinct("file_id") if exclude_pseudo else F.sum(F.col("seq_len") - k + 1) * (2 if reverse_complement else 1)).alias("freq"))
        return asking(corpus, k, selection).select("file_id", "seq_id", "pos").join(F.broadcast(hits))  # one row
    if near.fits(k, errors) and not exclude_pseudo and total(corpus.directory, k) > JOIN_WINDOWS:
        return _grouped(corpus, k, reverse_complement, False, selection, errors)
    return _approximate(corpus, k, errors, reverse_complement, exclude_pseudo, selection).select("file_id", "seq_id", "pos", "freq")


def of_kmers(corpus, k: int, both: bool = True) -> DataFrame:
    """(kmer, freq) of the different k-mers of a corpus, without errors."""
    found = counted(corpus, k)
    if not both:
        return found.withColumnRenamed("cnt", "freq")
    ways = found.select("kmer", "cnt", F.lit(True).alias("own")).unionAll(found.select(revcomp(F.col("kmer")), "cnt", F.lit(False)))
    return ways.groupBy("kmer").agg(F.sum("cnt").alias("freq"), F.max("own").alias("own")).filter("own").drop("own")


def dense(freq: DataFrame, directory: DataFrame) -> DataFrame:
    """One row per base; 0 where no window starts, or none has a hit."""
    return positions(directory).join(freq.hint("merge"), ["file_id", "seq_id", "pos"], "left").withColumn("freq", F.coalesce("freq", F.lit(0).cast("long")))


def saturated(freq: Column, value: str) -> Column:
    return F.least(freq, F.lit(MAX[value]).cast("long"))


def mappability_of(freq: Column) -> Column:
    """1 / freq as a 32-bit float, 0 for 0."""
    wide = saturated(freq, "mappability")
    return F.when(wide > 0, (F.lit(1.0) / F.nullif(wide, F.lit(0))).cast("float")).otherwise(F.lit(0.0).cast("float"))


def with_value(freq: DataFrame, value: str = "mappability") -> DataFrame:
    """Adds the column value: mappability, or the frequency at 8 or 16 bits."""
    if value not in MAX:
        raise ValueError(f"value must be one of {', '.join(MAX)}")
    return freq.withColumn("value", mappability_of(F.col("freq")) if value == "mappability" else saturated(F.col("freq"), value))


def selected(directory: DataFrame, selection: DataFrame | None) -> DataFrame:
    """The directory of the files that have output: all, or those with a selected interval."""
    if selection is None:
        return directory
    return directory.join(directory.join(selection, "seq_name", "left_semi").select("file_id").distinct(), "file_id", "left_semi")
