"""The layout of sequences in tables: a directory of names and lengths, and chunks of bases.

A chunk holds the bases of its own span and the first ``overlap`` bases after it, so that windows of up to overlap + 1 bases
are made from one row each, and no row or task holds a chromosome. Cutting is one pass over a sequence's bytes, on Arrow
batches; texts become bases by a table of bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .place import bounded

#: Window starts of a chunk, and the bases it has beyond them.
SPAN, OVERLAP = 4096, 256
DIRECTORY = "file_id int, file_name string, seq_id long, seq_name string, seq_len long"
CHUNKS = "file_id int, seq_id long, seq_len long, chunk_start long, bases string"


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once per row, however often later steps name it."""
    return rows.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of texts; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] :], offsets - offsets[0]


def texts_of(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """The column of bytes (or texts) that flat() takes apart; offsets are in bytes."""
    kind = kind or pa.string()
    if offsets[-1] > np.iinfo(np.int32).max:
        raise ValueError("a batch has 2 GB at most")
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def picked(offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of bytes where those in ``at`` (a mask) stay: their numbers, and the offsets among them."""
    return np.flatnonzero(at), np.concatenate(([0], np.cumsum(at)))[offsets]


#: What each byte of a text is as a base: upper case, U as T, and N for all else.
BASES = np.full(256, ord("N"), np.uint8)
for _from, _to in zip("acgtuUACGT", "ACGTTTACGT"):
    BASES[ord(_from)] = ord(_to)


def cut(rows: DataFrame, keys: list[str], seq: str = "seq", span: int = SPAN, overlap: int = OVERLAP, clean: bool = False) -> DataFrame:
    """The keys with seq_len, chunk_start and bases. With ``clean`` the texts are made bases first, as by normalise()."""
    if overlap > span:
        raise ValueError("the overlap must not exceed the span")
    bounded(rows.sparkSession)

    def chunks(batches):
        for batch in batches:
            data, offsets = flat(batch.column(len(keys)))
            wide = (data & 0xC0) == 0x80  # bytes that begin no character
            starts = None
            if wide.any():
                first, offsets = picked(offsets, ~wide)
                if clean:
                    data = data[first]
                else:
                    starts = np.append(first, len(data))
            if clean:
                data = BASES[data]
            lengths = np.diff(offsets)
            counts = -(-lengths // span)
            row = np.repeat(np.arange(len(lengths)), counts)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) * span
            begin = offsets[:-1][row] + start
            end = np.minimum(begin + span + overlap, offsets[1:][row])
            if starts is not None:
                begin, end = starts[begin], starts[end]
            size = end - begin
            to = np.concatenate(([0], np.cumsum(size)))
            bases = data[np.repeat(begin - to[:-1], size) + np.arange(to[-1])]
            made = [batch.column(i).take(pa.array(row)) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*made, pa.array(lengths[row]), pa.array(start), texts_of(bases, to)], [*keys, "seq_len", "chunk_start", "bases"])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, seq).mapInArrow(chunks, f"{kinds}, seq_len long, chunk_start long, bases string")


def reach(chunks: DataFrame, k: int, span: int = SPAN, overlap: int = OVERLAP) -> DataFrame:
    """Chunks that have enough bases for windows of k: the next chunk's span is added where the overlap is too short."""
    if k - 1 <= overlap:
        return chunks
    if k - 1 > span:
        raise ValueError(f"k is at most {span + 1} in this corpus; load it with a longer span")
    following = chunks.select("file_id", "seq_id", (F.col("chunk_start") - span).alias("chunk_start"), F.col("bases").alias("more"))
    longer = F.concat(F.substring("bases", 1, span), F.substring(F.coalesce("more", F.lit("")), 1, k - 1))
    return chunks.join(following, ["file_id", "seq_id", "chunk_start"], "left").withColumn("bases", longer).drop("more")
