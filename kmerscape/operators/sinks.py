"""Output encodings: txt, wig with chrom.sizes, bedgraph, bed, csv and raw.

Every encoding is first a table of lines (or of payloads) with its file's name and order, made by distributed plans; one
write then gives each output its rows. A line is as long as the format asks, so txt has one line per sequence; it is joined
from the texts of stretches, never from single positions. Frequencies come as a row for each position, or for each chunk
(frequency.in_chunks, with the corpus's span), which needs neither a join with all positions nor a sort of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.place import bounded, file_system
from ..sources.stored import SPAN, flat, texts_of
from .frequency import MAX, dense, saturated
from .packed import binaries, dense_values, exploded, turns, whole
from .runs import STRETCH_BITS, runs, runs_of_chunks, value_before

RAW = {"mappability": ("map", "<f4"), "freq8": ("freq8", "u1"), "freq16": ("freq16", "<u2")}


def numbers(spark: SparkSession, value: str) -> DataFrame:
    """(number, text): how each frequency is printed. A reciprocal has six significant digits of its 32-bit value, as C
    prints it; the table has one row per possible frequency, 65,536 at most."""
    return spark.createDataFrame(list(enumerate(_texts(value))), "number long, text string")


def _texts(value: str) -> list[str]:
    return ["%g" % float(np.float32(1) / np.float32(v)) if value == "mappability" and v else str(v) for v in range(MAX[value] + 1)]


def by_chunk(freq: DataFrame) -> bool:
    return "chunk_start" in freq.columns


def printed(rows: DataFrame, value: str, column: str = "freq") -> DataFrame:
    """Adds text: the printed value of a frequency."""
    table = F.broadcast(numbers(rows.sparkSession, value))
    return rows.withColumn("number", saturated(F.col(column), value)).join(table, "number").drop("number")


def value_runs(freq: DataFrame, directory: DataFrame, value: str, span: int = SPAN) -> DataFrame:
    """Runs of equal printed values with file_name, seq_name and text."""
    names = directory.select("file_id", "seq_id", "file_name", "seq_name")
    if by_chunk(freq):
        found = runs_of_chunks(freq, span, MAX[value])
    else:
        found = runs(freq.select("file_id", "seq_id", "pos", saturated(F.col("freq"), value).alias("value")))
    return printed(found.withColumnRenamed("value", "freq"), value).join(names, ["file_id", "seq_id"])


def bedgraph(freq: DataFrame, directory: DataFrame, value: str = "mappability", span: int = SPAN) -> DataFrame:
    """(file_id, file_name, seq_id, start, line): name, start, end, value; 0-based and half-open, without zeros."""
    rows = value_runs(freq, directory, value, span)
    return rows.select("file_id", "file_name", "seq_id", "start", F.concat_ws("\t", "seq_name", F.col("start").cast("string"), F.col("end").cast("string"), "text").alias("line"))


def bed(freq: DataFrame, directory: DataFrame, value: str = "mappability", span: int = SPAN) -> DataFrame:
    """As bedgraph, with - in the name's column."""
    rows = value_runs(freq, directory, value, span)
    return rows.select("file_id", "file_name", "seq_id", "start", F.concat_ws("\t", "seq_name", F.col("start").cast("string"), F.col("end").cast("string"), F.lit("-"), "text").alias("line"))


def wig(freq: DataFrame, directory: DataFrame, value: str = "mappability", span: int = SPAN) -> DataFrame:
    """A line of start (from 1) and value for each run; before it a header where the span differs from the run before."""
    rows = value_before(value_runs(freq, directory, value, span).withColumn("span", F.col("end") - F.col("start")), "span", "before")
    head = F.when(F.col("before").isNull() | (F.col("before") != F.col("span")), F.concat(F.lit("variableStep chrom="), "seq_name", F.lit(" span="), F.col("span").cast("string"), F.lit("\n"))).otherwise(F.lit(""))
    return rows.select("file_id", "file_name", "seq_id", "start", F.concat(head, (F.col("start") + 1).cast("string"), F.lit(" "), "text").alias("line"))


def chrom_sizes(directory: DataFrame) -> DataFrame:
    return directory.select("file_id", "file_name", "seq_id", F.lit(0).cast("long").alias("start"), F.concat_ws("\t", "seq_name", F.col("seq_len").cast("string")).alias("line"))


def txt(freq: DataFrame, directory: DataFrame, value: str = "mappability", span: int = SPAN) -> DataFrame:
    """`>name` and a line of all values of the sequence, zeros included."""

    def joined(place: str, text: str):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, text))), lambda x: x[text]), " ")

    if by_chunk(freq):
        parts = _chunk_texts(freq, value, span)
    else:
        rows = printed(dense(freq, directory), value).withColumn("stretch", F.shiftright("pos", STRETCH_BITS))
        parts = rows.groupBy("file_id", "seq_id", "stretch").agg(joined("pos", "text").alias("values"))
    lines = parts.groupBy("file_id", "seq_id").agg(joined("stretch", "values").alias("values"))
    names = directory.select("file_id", "seq_id", "file_name", "seq_name")
    return lines.join(names, ["file_id", "seq_id"]).select("file_id", "file_name", "seq_id", F.lit(0).cast("long").alias("start"), F.concat(F.lit(">"), "seq_name", F.lit("\n"), "values").alias("line"))


def _chunk_texts(freq: DataFrame, value: str, span: int) -> DataFrame:
    """(file_id, seq_id, stretch, values): the printed values of each chunk."""
    bounded(freq.sparkSession)

    def joined(batches):
        texts = pa.array(_texts(value))
        for batch in batches:
            values, own = dense_values(batch, span)
            each = texts.take(pa.array(np.minimum(values, MAX[value])))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(own))).astype(np.int32)), each)
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("seq_id"), batch.column("chunk_start"), pc.binary_join(lists, " ")], ["file_id", "seq_id", "stretch", "values"])

    return freq.mapInArrow(joined, "file_id int, seq_id long, stretch long, values string")


def _raw_of_chunks(freq: DataFrame, directory: DataFrame, value: str, stretch: int, span: int) -> DataFrame:
    """As raw(), of frequencies by chunk: a stretch is the bytes of its chunks, one after the other."""
    bounded(freq.sparkSession)
    names = ["file_id", "seq_id", "start"]

    def bytes_of(batches):
        for batch in batches:
            values, own = dense_values(batch, span)
            payload = binaries(_encoded(values, value), np.concatenate(([0], np.cumsum(own))))
            at = batch.column("chunk_start").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("seq_id"), pa.array(at - at % stretch), batch.column("chunk_start"), payload], [*names, "chunk_start", "payload"])

    def joined(batches):
        for table in whole(batches, names):
            first = turns(table, names)
            data, offsets = flat(table.column("payload"))
            heads = table.select(names).take(pa.array(first))
            yield from heads.append_column("payload", texts_of(data, np.append(offsets[first], offsets[-1]), pa.binary())).combine_chunks().to_batches()

    parts = freq.mapInArrow(bytes_of, "file_id int, seq_id long, start long, chunk_start long, payload binary")
    made = parts.repartition(*names).sortWithinPartitions(*names, "chunk_start").mapInArrow(joined, "file_id int, seq_id long, start long, payload binary")
    return made.join(directory.select("file_id", "seq_id", "file_name"), ["file_id", "seq_id"]).select("file_id", "file_name", "seq_id", "start", "payload")


def _encoded(values: np.ndarray, value: str) -> np.ndarray:
    got = np.minimum(values, MAX[value])
    out = np.where(got > 0, np.float32(1) / np.maximum(got, 1).astype(np.float32), np.float32(0)) if value == "mappability" else got
    return out.astype(RAW[value][1])


def raw(freq: DataFrame, directory: DataFrame, value: str = "mappability", stretch: int = 1 << 20, span: int = SPAN) -> DataFrame:
    """(file_id, file_name, seq_id, start, payload): little-endian values of stretches of positions."""
    if by_chunk(freq):
        if stretch % span == 0:
            return _raw_of_chunks(freq, directory, value, stretch, span)
        freq = exploded(freq)
    rows = dense(freq, directory).select("file_id", "seq_id", (F.col("pos") - F.col("pos") % stretch).alias("start"), "pos", saturated(F.col("freq"), value).alias("freq"))

    def payload(batches):
        for table in whole(batches, ["file_id", "seq_id", "start"]):
            out = _encoded(table.column("freq").to_numpy(), value)
            starts = np.append(turns(table, ["file_id", "seq_id", "start"]), table.num_rows)
            heads = table.select(["file_id", "seq_id", "start"]).take(pa.array(starts[:-1]))
            yield from heads.append_column("payload", pa.array([out[a:b].tobytes() for a, b in zip(starts, starts[1:])], pa.binary())).combine_chunks().to_batches()

    dealt = rows.repartition("file_id", "seq_id", "start").sortWithinPartitions("file_id", "seq_id", "start", "pos")
    file_kind, seq_kind = (rows.schema[c].dataType.simpleString() for c in ("file_id", "seq_id"))
    made = dealt.mapInArrow(payload, f"file_id {file_kind}, seq_id {seq_kind}, start long, payload binary")
    return made.join(directory.select("file_id", "seq_id", "file_name"), ["file_id", "seq_id"]).select("file_id", "file_name", "seq_id", "start", "payload")


def output_name(file_name: str, extension: str, prefix: str | None = None) -> str:
    stem, dot, _ = file_name.rpartition(".")
    return f"{(stem if dot else file_name) if prefix is None else prefix}.kmers.{extension}"


def _outputs(rows: DataFrame, path: str, extension: str, prefix: str | None, kind: str, columns: list[str]) -> None:
    """One write for all files: rows are dealt by (file, sequence, start), so that an output's part files in name order hold
    them in order; the folders, one per file, then get their names."""
    spark = rows.sparkSession
    names = rows.select("file_id", "file_name").distinct().collect()  # as many outputs as input files
    held = f"{path}/.{extension}"
    order = ["file_id", "seq_id", "start"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns, "file_id").write.partitionBy("file_id").format(kind).save(held)
    system, top = file_system(spark, held)
    for row in names:
        to = f"{path}/{output_name(row.file_name, extension, prefix)}"
        if system.exists(spark._jvm.org.apache.hadoop.fs.Path(to)):
            raise FileExistsError(to)
        system.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{held}/file_id={row.file_id}"), spark._jvm.org.apache.hadoop.fs.Path(to))
    system.delete(top, True)


def write_lines(lines: DataFrame, path: str, extension: str, header: str | None = None, prefix: str | None = None) -> None:
    """One folder of text per input file, named after it; its part files in name order hold the lines in order."""
    if header is not None:
        first = lines.select("file_id", "file_name").distinct().select("file_id", "file_name", F.lit(-1).cast("long").alias("seq_id"), F.lit(-1).cast("long").alias("start"), F.lit(header).alias("line"))
        lines = lines.select("file_id", "file_name", "seq_id", "start", "line").unionAll(first)
    _outputs(lines, path, extension, prefix, "text", ["line"])


def write_raw(payloads: DataFrame, path: str, value: str, prefix: str | None = None) -> None:
    """Parquet of payloads in order, one folder per input file; raw_bytes() joins them."""
    _outputs(payloads, path, RAW[value][0], prefix, "parquet", ["seq_id", "start", "payload"])


def raw_bytes(spark: SparkSession, path: str):
    """The payloads of one output of write_raw, one after the other, streamed to the caller."""
    for row in spark.read.parquet(path).orderBy("seq_id", "start").toLocalIterator():
        yield bytes(row.payload)
