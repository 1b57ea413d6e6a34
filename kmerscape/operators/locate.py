"""Coordinates of all hits of every window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import n_count
from .match import check, pairs, queries_of
from .windows import asking, kmers, postings, total, windows

#: Parts to which the windows are dealt where each meets all others.
PARTS = 64


def locate(corpus, k: int, errors: int = 0, reverse_complement: bool = True, selection: DataFrame | None = None) -> DataFrame:
    """Long form: (file_id, seq_id, pos, strand, hit_file_id, hit_seq_id, hit_pos); windows without a hit have no row."""
    check(k, errors)
    wins, wanted = windows(corpus, k), asking(corpus, k, selection)
    if k <= errors:  # every window hits every other one: all pairs are the answer
        strands = F.array(F.lit("+"), F.lit("-")) if reverse_complement else F.array(F.lit("+"))
        left = wanted.select("file_id", "seq_id", "pos", F.explode(strands).alias("strand"), F.pmod(F.xxhash64("file_id", "seq_id", "pos"), F.lit(PARTS)).alias("x"))
        right = postings(wins).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
        return left.join(right.hint("merge"), "x").select("file_id", "seq_id", "pos", "strand", "hit_file_id", "hit_seq_id", "hit_pos")
    asked = wanted.filter(n_count(F.col("kmer")) <= errors).select("kmer").distinct()
    found = pairs(queries_of(asked, reverse_complement), kmers(wins, errors), k, errors, total(corpus.directory, k))
    hits = found.select("kmer", "strand", "hit").join(postings(wins).withColumnRenamed("kmer", "hit").hint("merge"), "hit").drop("hit")
    return wanted.join(hits.hint("merge"), "kmer").select("file_id", "seq_id", "pos", "strand", "hit_file_id", "hit_seq_id", "hit_pos")


def nested(found: DataFrame) -> DataFrame:
    """One row per window: plus and minus, arrays of (hit_file_id, hit_seq_id, hit_pos) in ascending order."""
    hit = F.struct("hit_file_id", "hit_seq_id", "hit_pos")

    def of(strand: str):
        return F.sort_array(F.collect_list(F.when(F.col("strand") == strand, hit)))

    return found.groupBy("file_id", "seq_id", "pos").agg(of("+").alias("plus"), of("-").alias("minus"))


def csv_rows(found: DataFrame, directory: DataFrame, reverse_complement: bool = True) -> DataFrame:
    """(file_id, seq_id, pos, line): the window, then a cell of hits for each file, + before -; `seq,pos` joined by |."""
    # the output has one column per file, so the list of files is as long as a line of its header
    files = [r.file_id for r in directory.select("file_id").distinct().orderBy("file_id").collect()]
    columns = [f"{s}{f}" for s in ("+-" if reverse_complement else "+") for f in files]
    entry = F.struct("hit_seq_id", "hit_pos")
    cells = found.withColumn("cell", F.concat("strand", F.col("hit_file_id").cast("string"))).groupBy("file_id", "seq_id", "pos").pivot("cell", columns).agg(F.sort_array(F.collect_list(entry)))

    def text(name: str):
        hits = F.transform(F.col(f"`{name}`"), lambda h: F.concat_ws(",", h["hit_seq_id"].cast("string"), h["hit_pos"].cast("string")))
        return F.coalesce(F.array_join(hits, "|"), F.lit(""))

    return cells.select("file_id", "seq_id", "pos", F.concat_ws(";", F.concat_ws(",", F.col("seq_id").cast("string"), F.col("pos").cast("string")), *[text(c) for c in columns]).alias("line"))


def csv_header(names: list[str], reverse_complement: bool = True) -> str:
    return ";".join(['"k-mer"', *[f'"{s} strand {n}"' for s in ("+-" if reverse_complement else "+") for n in names]])
