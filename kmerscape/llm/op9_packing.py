"""Packing by power-of-two decomposition.

Each document's ids are cut into pieces whose lengths are powers of two (as many of ``max_length`` as fit, then the binary
digits of the rest, longest first). Pieces of equal length form a bucket; a piece is a sequence of its own, so no sequence
crosses documents and none needs padding. pack() is one map over the texts, without a shuffle; write() brings each bucket's
pieces together in a folder of its own, from which batch() reads sequences of one length.

Defined cases: null text is empty and has the end id alone; a null doc_id stays null; long texts have many pieces of
max_length; equal rows are packed apart; other columns are never read; an empty table gives no piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import load
from .flat import array_of, binary_array, crc32_each, slices, spread, starts_of, tidied
from .shared import bounded, hash_partitions

MAX_LENGTH = 2048
END_ID = 1


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(lengths: np.ndarray, max_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of each piece, in order. max_length is a power of two."""
    full, rest = lengths // max_length, lengths % max_length
    powers = max_length >> np.arange(1, max_length.bit_length())
    bits = (rest[:, None] & powers) > 0
    counts = full + bits.sum(axis=1)
    doc = np.repeat(np.arange(len(lengths)), counts)
    size = np.full(len(doc), max_length, np.int64)
    tail = bits.sum(axis=1)
    first = starts_of(counts)[:-1]
    size[spread(first + full, tail)] = np.broadcast_to(powers, bits.shape)[bits]
    ends = np.cumsum(size)
    begin = ends - size
    return doc, begin - np.repeat(starts_of(lengths)[:-1], counts), size


def pack(df: DataFrame, path: str | None = None, end_id: int = END_ID, max_length: int = MAX_LENGTH, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, bucket (log2 of the length), sequence_id, offset, ids_crc32
    and, ``with_ids``, ids (little-endian uint32)."""
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    path = path or tokenizer_path()
    bounded(df.sparkSession)

    def pieces(batches):
        tokenizer = load(path)
        for part in slices(batches):
            ids, bounds = tokenizer.encode(array_of(part, "text"), end_id)
            lengths = np.diff(bounds)
            doc, start, size = cut(lengths, max_length)
            at = starts_of(size)
            out = [array_of(part, "doc_id").take(pa.array(doc)), start, size, lengths[doc], np.log2(size).astype(np.int32), crc32_each(ids, at)]
            if with_ids:
                out.append(binary_array(ids.astype("<u4").view(np.uint8), at * 4).cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names)

    names = ["doc_id", "start", "length", "doc_tokens", "bucket", "ids_crc32", *["ids"] * with_ids]
    schema = "doc_id long, start long, length long, doc_tokens long, bucket int, ids_crc32 long" + ", ids binary" * with_ids
    made = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidied(pieces), schema)
    return made.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write(pieces: DataFrame, path: str) -> None:
    """Pieces of pack() by bucket: one folder for each length. A bucket, however many pieces it has, is dealt to all tasks."""
    salt = F.pmod(F.xxhash64("sequence_id"), F.lit(hash_partitions(pieces.sparkSession)))
    pieces.repartition("bucket", salt).sortWithinPartitions("bucket", "doc_id", "start").write.partitionBy("bucket").parquet(path)


def batch(spark: SparkSession, path: str, length: int) -> DataFrame:
    """The written pieces of one length."""
    return spark.read.parquet(path).filter(F.col("bucket") == length.bit_length() - 1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, with_ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")
