"""Token ids in binary shards, by a canonical length-limited Huffman code of global counts.

1. Texts are encoded once; a row holds a document's ids as compressed byte planes, in a written table.
2. Global counts of ids (one row per id) give code lengths of at most ``limit`` bits, by package-merge; a canonical code
   needs nothing else, so the codebook is the table of lengths.
3. Rows are range-partitioned and sorted by doc_id; each partition writes shards of about SHARD_TOKENS ids.
A shard holds a header, doc_ids, lengths, the bit offset of each block of BLOCK ids, and the code bits (first bit highest).
Blocks decode apart: a reader steps through all blocks of a shard at once, one table look-up per id and block.
Shards are rows of a Parquet table, so Spark's committer writes them whole or not at all, on any store.

Defined cases: null text is empty and has the end id alone; equal doc_ids stay next to each other, ordered by their ids;
null doc_id sorts first and is read back as null; an empty table gives no shard and no row; a very long text is one shard,
with 64-bit offsets; other columns are never read.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import load
from .flat import array_of, binary_array, crc32_each, slices, starts_of, tidied
from .op9_packing import tokenizer_path
from .shared import bounded, drop, hash_partitions, new_path, written

MAGIC = b"HUFIDS02"
HEADER = struct.Struct("<8sQQQI")
BLOCK = 256
LIMIT = 18
SHARD_TOKENS = 1 << 20
END_ID = 2


# --- the code -------------------------------------------------------------------------------------------------------
def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge); 0 for ids that don't occur."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts > 0)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of this length")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(weights))
        merged = both[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    need, lengths = 2 * len(used) - 2, np.zeros(len(used), np.uint8)
    for single in reversed(levels):
        alone = int(single[:need].sum())
        lengths[:alone] += 1
        need = 2 * (need - alone)
    out[order] = lengths
    return out


class Codebook:
    """The canonical code of these lengths: codes ascend by (length, id)."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8)
        used = np.flatnonzero(self.lengths)
        order = used[np.argsort(self.lengths[used], kind="stable")]
        self.limit = int(self.lengths.max(initial=1))
        room = np.int64(1) << (self.limit - self.lengths[order].astype(np.int64))
        self.codes = np.zeros(len(self.lengths), np.uint64)
        self.codes[order] = (starts_of(room)[:-1] >> (self.limit - self.lengths[order].astype(np.int64))).astype(np.uint64)
        self.table = np.zeros(1 << self.limit, np.uint32)
        self.table[: int(room.sum())] = np.repeat(order, room)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, bit offset of each block)."""
        size = self.lengths[ids].astype(np.int64)
        if not len(ids):
            return np.zeros(0, np.uint8), np.zeros(0, np.uint64)
        at = starts_of(size)
        word, off = at[:-1] >> 6, (at[:-1] & 63).astype(np.uint64)
        high = self.codes[ids] << (np.uint64(64) - size.astype(np.uint64))
        words = np.zeros((int(at[-1]) >> 6) + 1, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.bitwise_or.reduceat(high >> off, first)
        over = np.flatnonzero(off.astype(np.int64) + size > 64)
        words[word[over] + 1] |= high[over] << (np.uint64(64) - off[over])
        return words.astype(">u8").view(np.uint8)[: (int(at[-1]) + 7) >> 3], at[:-1][::BLOCK].astype(np.uint64)

    def decode(self, data: np.ndarray, checkpoints: np.ndarray, total: int) -> np.ndarray:
        """All ids; the blocks are read side by side."""
        out = np.zeros((len(checkpoints), BLOCK), np.uint32)
        wide = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
        window = wide[:-3] << np.uint32(24) | wide[1:-2] << np.uint32(16) | wide[2:-1] << np.uint32(8) | wide[3:]
        at, last = checkpoints.astype(np.int64), total - BLOCK * (len(checkpoints) - 1)
        shift = np.uint32(32 - self.limit)
        for step in range(BLOCK if len(checkpoints) > 1 else last):
            if step == last:
                at = at[:-1]
            ids = self.table[(window[at >> 3] << (at & 7).astype(np.uint32)) >> shift]
            out[: len(at), step] = ids
            at = at + self.lengths[ids]
        return out.reshape(-1)[:total]


# --- shards ---------------------------------------------------------------------------------------------------------
def shard_bytes(book: Codebook, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    data, checkpoints = book.encode(ids)
    return b"".join([HEADER.pack(MAGIC, len(doc_ids), len(ids), len(data), BLOCK), doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), checkpoints.astype("<u8").tobytes(), data.tobytes()])


def shard_parts(book: Codebook, payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids)."""
    magic, docs, total, size, block = HEADER.unpack_from(payload)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a shard of this format")
    at, blocks = HEADER.size, -(-total // block)
    doc_ids = np.frombuffer(payload, "<i8", docs, at)
    lengths = np.frombuffer(payload, "<u4", docs, at + 8 * docs)
    checkpoints = np.frombuffer(payload, "<u8", blocks, at + 12 * docs)
    data = np.frombuffer(payload, np.uint8, size, at + 12 * docs + 8 * blocks)
    return doc_ids, lengths, book.decode(data, checkpoints, total)


#: Stands for null among doc_ids; it sorts first as null does.
NULL_ID = -(1 << 63)


def planes(ids: np.ndarray, squeeze) -> bytes:
    """Ids as four byte planes, compressed."""
    return squeeze(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def from_planes(raw: bytes, expand) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(expand(raw), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def write(df: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> None:
    """Writes path/codebook and path/shards."""
    spark, tokenizer = bounded(df.sparkSession), tokenizer or tokenizer_path()

    def tokens(batches):
        model, squeeze = load(tokenizer), zstandard.ZstdCompressor(level=1).compress
        for part in slices(batches):
            ids, bounds = model.encode(array_of(part, "text"), end_id)
            cuts = bounds.tolist()
            yield pa.RecordBatch.from_arrays([array_of(part, "doc_id"), pa.array(np.diff(bounds)), pa.array([planes(ids[a:b], squeeze) for a, b in zip(cuts, cuts[1:])], pa.binary())], ["doc_id", "n", "z"])

    coded = written(df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidied(tokens), "doc_id long, n long, z binary"), "op6", compression="none")

    def count(batches):
        expand, seen = zstandard.ZstdDecompressor().decompress, np.zeros(1, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                got = np.bincount(from_planes(raw, expand))
                if len(got) > len(seen):
                    seen = np.concatenate([seen, np.zeros(len(got) - len(seen), np.int64)])
                seen[: len(got)] += got
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], ["id", "n"])

    # one row per id of the vocabulary reaches the driver
    counted = coded.select("z").mapInArrow(tidied(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 1, np.int64)
    counts[counted["id"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    limit = max(limit, int(max(1, (counts > 0).sum() - 1)).bit_length())
    lengths = code_lengths(counts, limit)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").write.parquet(f"{path}/codebook")

    def shards(batches):
        book, expand = Codebook(lengths), zstandard.ZstdDecompressor().decompress
        docs, rows, held, seq, before = [], [], 0, 0, 0

        def out():
            nonlocal docs, rows, held, seq, before
            ids = np.concatenate(rows)
            payload = shard_bytes(book, np.array(docs, np.int64), np.array([len(r) for r in rows]), ids)
            made = pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (seq, before, len(docs), len(ids))] + [pa.array([payload], pa.binary())], ["seq", "before", "docs", "tokens", "payload"])
            docs, rows, held, seq, before = [], [], 0, seq + 1, before + len(ids)
            return made

        for batch in batches:
            for doc, raw in zip(array_of(batch, "doc_id").to_pylist(), array_of(batch, "z").to_pylist()):
                docs.append(doc)
                rows.append(from_planes(raw, expand))
                held += len(rows[-1])
                if held >= SHARD_TOKENS:
                    yield out()
        if docs:
            yield out()

    ordered = coded.repartitionByRange(hash_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "z")
    ordered.mapInArrow(tidied(shards), "seq long, before long, docs long, tokens long, payload binary").withColumn("part", F.spark_partition_id()).write.option("compression", "none").parquet(f"{path}/shards")
    drop(coded)


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32 and, where wanted, ids (uint32 bytes)."""
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/codebook").first()[0]), np.uint8)
    shards = spark.read.schema("seq long, before long, docs long, tokens long, payload binary, part int").parquet(f"{path}/shards")
    # one row per partition that wrote
    totals = sorted((r[0], r[1]) for r in shards.groupBy("part").agg(F.sum("tokens")).collect())
    base = dict(zip([p for p, _ in totals], starts_of(np.array([n for _, n in totals], np.int64)).tolist()))

    def decoded(batches):
        book = Codebook(lengths)
        for batch in batches:
            for part, before, payload in zip(array_of(batch, "part").to_pylist(), array_of(batch, "before").to_pylist(), array_of(batch, "payload").to_pylist()):
                doc_ids, sizes, got = shard_parts(book, payload)
                at = starts_of(sizes.astype(np.int64))
                columns = [pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(base[part] + before + at[:-1]), pa.array(np.diff(at)), pa.array(crc32_each(got, at))]
                if ids:
                    columns.append(binary_array(got.astype("<u4").view(np.uint8), at * 4).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids])

    return shards.select("part", "before", "payload").mapInArrow(tidied(decoded), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "op6-files")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path)
    return read(spark, path, ids=False)
