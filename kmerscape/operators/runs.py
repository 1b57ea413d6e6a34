"""Maximal runs of equal values along sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.place import kept
from .packed import runs_in_chunks

#: Positions of a sequence whose runs are found in one partition, as a power of two; runs that touch a border are then joined
#: across it, two rows for each border.
STRETCH_BITS = 16


def _islands(rows: DataFrame, by: list[str]) -> DataFrame:
    """Joins rows (start, end, value) that touch and have equal values; partitions are ``by``."""
    along = Window.partitionBy(*by).orderBy("start")
    turn = F.when((F.lag("value").over(along) == F.col("value")) & (F.lag("end").over(along) == F.col("start")), 0).otherwise(1)
    numbered = rows.withColumn("turn", turn).withColumn("run", F.sum("turn").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("value").alias("value")).drop("run")


def runs(values: DataFrame, value: str = "value") -> DataFrame:
    """(file_id, seq_id, start, end, value) from rows with pos: half-open maximal runs of equal non-zero values. Positions
    without a row, and zeros, end a run."""
    one = values.filter(F.col(value) != 0).select("file_id", "seq_id", F.shiftright("pos", STRETCH_BITS).alias("stretch"), F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), F.col(value).alias("value"))
    short = _islands(one, ["file_id", "seq_id", "stretch"]).drop("stretch")
    last = F.lit((1 << STRETCH_BITS) - 1)
    touches = ((F.col("start").bitwiseAND(last) == 0) & (F.col("start") > 0)) | (F.col("end").bitwiseAND(last) == 0)
    return short.filter(~touches).unionByName(_islands(short.filter(touches), ["file_id", "seq_id"]))


def runs_of_chunks(freq: DataFrame, span: int, most: int | None = None) -> DataFrame:
    """As runs(), of rows of frequency.in_chunks(): found in each chunk, and joined where they meet its borders. Both read the
    frequencies, so these are kept."""
    short = runs_in_chunks(kept(freq, "freq"), span, most)
    return short.filter("not touches").drop("touches").unionByName(_islands(short.filter("touches").drop("touches"), ["file_id", "seq_id"]))


def value_before(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the column's value in the row before (by start) of the same sequence; null for the first one. Found by stretch, and
    from the last row of the last stretch before that has any."""
    placed = rows.withColumn("_stretch", F.shiftright("start", STRETCH_BITS))
    inside = F.lag(column).over(Window.partitionBy("file_id", "seq_id", "_stretch").orderBy("start"))
    ends = placed.groupBy("file_id", "seq_id", "_stretch").agg(F.max_by(column, "start").alias("_end"))
    carried = ends.select("file_id", "seq_id", "_stretch", F.lag("_end").over(Window.partitionBy("file_id", "seq_id").orderBy("_stretch")).alias("_carried"))
    return placed.withColumn(name, inside).join(carried, ["file_id", "seq_id", "_stretch"]).withColumn(name, F.coalesce(name, "_carried")).drop("_stretch", "_carried")
