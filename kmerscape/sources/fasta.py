"""Sequence files as tables, read by Spark's own readers and so from any store.

A FASTA file is read as records that end before "\\n>", so a large file is split between tasks at records (a record has 2 GB
at most). A FASTQ file is read by lines, which are numbered by split, and four lines make a record; a file whose lines don't
fit raises an error. Empty sequences are left out before numbering; a name is cut at white space if the short names stay
unique in their file. Numbers come from a table of names and lengths, so no task gathers the bases of a file.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .place import kept
from .stored import OVERLAP, SPAN, cut

EXTENSIONS = ("fsa", "fna", "fastq", "fasta", "fas", "faa", "fa")
#: Records of a FASTQ file that are numbered together.
STRETCH_BITS = 18


def basename(path):
    return F.element_at(F.split(path, "/"), -1)


def _lines(spark: SparkSession, path: str, pattern: str, **options) -> DataFrame:
    """(path, split, row, value): a row's place in its file is where its split starts, and its number in the split."""
    rows = spark.read.options(**options).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), "value")


def _numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """Adds the place of each row within ``by``, from 0, in the order of (split, row): counts of splits are summed, rows are
    numbered within their split."""
    inside = F.row_number().over(Window.partitionBy(by, "split").orderBy("row"))
    sizes = rows.groupBy(by, "split").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn(name, inside).join(sizes.select(by, "split", before.alias("before")), [by, "split"]).withColumn(name, F.col(name) - 1 + F.col("before")).drop("before")


def _fasta(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    named = _lines(spark, path, pattern, lineSep="\n>").select("path", "split", "row", F.regexp_replace("value", "^>", "").alias("record"))
    head = F.regexp_replace(F.substring_index("record", "\n", 1), "\r$", "")
    body = F.when(F.instr("record", "\n") > 0, F.expr("substring(record, instr(record, '\n') + 1)")).otherwise(F.lit(""))
    return named.select("path", "split", "row", head.alias("name"), F.regexp_replace(body, r"\s", "").alias("seq"))


def _fastq(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Records of four lines. Blank lines belong to none, unless the file fits with them (empty reads have two)."""
    lines = _lines(spark, path, pattern).withColumn("value", F.regexp_replace("value", "\r$", ""))
    every = _numbered(lines, "path", "at")
    inked = _numbered(lines.filter("value != ''"), "path", "ink")
    both = every.join(inked.select("path", "split", "row", "ink"), ["path", "split", "row"], "left")

    def wrong(at: str):
        turn = F.pmod(F.col(at), F.lit(4))
        return F.count(F.when(((turn == 0) & ~F.startswith("value", F.lit("@"))) | ((turn == 2) & ~F.startswith("value", F.lit("+"))), 1))

    last = F.max(F.when(F.col("value") != "", F.col("at")))
    inner = every.join(every.groupBy("path").agg(last.alias("last")), "path").filter(F.col("at") <= F.col("last"))
    plain = inner.groupBy("path").agg(wrong("at").alias("odd"))
    placed = both.join(plain, "path").withColumn("line", F.when(F.col("odd") == 0, F.col("at")).otherwise(F.col("ink"))).filter("line is not null")
    turn = F.pmod(F.col("line"), F.lit(4)).cast("int")
    records = placed.withColumn("record", F.floor(F.col("line") / 4)).groupBy("path", "record").agg(*[F.max(F.when(turn == i, F.col("value"))).alias(n) for i, n in enumerate(("name", "seq", "plus", "marks"))])
    # a file may end in blank lines, which are no record
    records = records.filter(~((F.coalesce("name", F.lit("")) == "") & (F.coalesce("seq", F.lit("")) == "") & (F.coalesce("plus", F.lit("")) == "")))
    fits = F.startswith("name", F.lit("@")) & F.startswith("plus", F.lit("+")) & (F.length("seq") == F.length(F.coalesce("marks", F.lit(""))))
    message = F.concat(F.lit("not a FASTQ record: number "), F.col("record").cast("string"), F.lit(" of "), F.col("path"))
    name = F.when(F.coalesce(fits, F.lit(False)), F.expr("substring(name, 2)")).otherwise(F.raise_error(message))
    return records.select("path", F.shiftright("record", STRETCH_BITS).alias("split"), F.col("record").alias("row"), name.alias("name"), F.coalesce("seq", F.lit("")).alias("seq"))


def read(spark: SparkSession, path: str, directory: bool = False, span: int = SPAN, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """(directory, chunks) of a file, or of a directory and those below it. Raises ValueError where two files have one name
    or no sequence is found; warns of files without any."""
    if directory:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
        # a list of files, which the driver plans with anyway
        names = [r.path for r in listed.filter(basename("path").rlike(r"\.(" + "|".join(EXTENSIONS) + ")$")).collect()]
        bases = [n.rpartition("/")[2] for n in names]
        if len(set(bases)) < len(bases):
            raise ValueError("two files have the same name")
        plain, quality = "*.{" + ",".join(x for x in EXTENSIONS if x != "fastq") + "}", "*.fastq"
    else:
        bases = [path.rpartition("/")[2]]
        plain = quality = bases[0]
    parts = []
    if any(not b.endswith(".fastq") for b in bases):
        parts.append(_fasta(spark, path, plain))
    if any(b.endswith(".fastq") for b in bases):
        parts.append(_fastq(spark, path, quality))
    if not parts:
        raise ValueError("no (non-empty) sequence file was found")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = rows.withColumn("file_name", F.url_decode(F.regexp_replace(basename("path"), r"\+", "%2B"))).drop("path")
    made = kept(cut(rows, ["file_name", "split", "row", "name"], "seq", span, overlap, clean=True), "cut")
    slim = made.filter("chunk_start = 0").select("file_name", "split", "row", "name", F.regexp_extract("name", r"^(\S*)", 1).alias("short"), "seq_len")
    found = sorted(r.file_name for r in slim.select("file_name").distinct().collect())  # as long as the listing
    if not found:
        raise ValueError("no (non-empty) sequence file was found")
    for name in sorted(set(bases) - set(found)):
        warnings.warn(f"{name} has no sequence and is left out", stacklevel=2)
    files = F.broadcast(spark.createDataFrame(list(enumerate(found)), "file_id int, file_name string"))
    twice = slim.groupBy("file_name", "short").count().filter("count > 1").select("file_name", F.lit(True).alias("twice")).distinct()
    numbered = _numbered(slim, "file_name", "seq_id").join(F.broadcast(twice), "file_name", "left").join(files, "file_name")
    names = numbered.select("file_id", "file_name", F.col("seq_id").cast("long").alias("seq_id"), F.when(F.col("twice"), F.col("name")).otherwise(F.col("short")).alias("seq_name"), "seq_len", "split", "row")
    chunks = made.drop("name", "seq_len").join(names.select("file_name", "split", "row", "file_id", "seq_id", "seq_len"), ["file_name", "split", "row"])
    return names.drop("split", "row"), chunks.select("file_id", "seq_id", "seq_len", "chunk_start", "bases")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(seq_name, begin, end) of the first three columns."""
    rows = spark.read.text(path).filter(~F.col("value").rlike(r"^(\s*$|#|track|browser)"))
    cells = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    return rows.select(cells[0].alias("seq_name"), cells[1].cast("long").alias("begin"), cells[2].cast("long").alias("end"))
