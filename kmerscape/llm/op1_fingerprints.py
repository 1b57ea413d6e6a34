"""Document fingerprints: a quartile bucket digest.

Byte triplets of each window of four bytes are hashed to 256 buckets and counted. A bucket is encoded in two bits by the
quartile of its count among the document's buckets; a logarithmic length byte goes before. Two digests differ by the sum
of their buckets' quartile steps (opposite quartiles count double) and the length step, bounded by ``BOUND``.

Defined cases: null counts as empty; texts under four bytes have the all-zero body; equal texts have equal digests; a text of
any length is counted as a whole; other columns stay as they are in digest() and are never read by edited(); an empty table
gives an empty result.
The digest is a map without a shuffle. "The next document" needs an order: descending doc_id, null last, and rows of equal
doc_id by descending xxhash64 of their texts. Rows go once to buckets of ranges of this order, as many as the bytes of text
ask for; bounds come from quantiles, and a doc_id with the rows of several ranges is divided by the hash. The first row of
each range is also sent to the range before it, so that a range has all it needs. Texts are compressed for the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .flat import array_of, flat, sha256_each, slices, tidied
from .op4_exact_dedup import text_of
from .shared import bounded, hash_partitions

BUCKETS = 256
#: Bytes of text whose triplets are counted at a time.
SLICE = 1 << 20
#: The mean difference of two independent bodies: 256 buckets with 1.625 steps each (pairs of quartiles 0, 1, 2 or 6 apart).
BOUND = 416
#: Texts whose lengths differ by this factor are one length step apart.
LENGTH_STEP = 1.2
#: Bytes of text of a range, more or less.
RANGE_BYTES = 128 << 20
STEPS = np.array([0, 1, 2, 6], np.int64)
TRIPLETS = ((0, 1, 2, 0x9E3779B1), (0, 1, 3, 0x85EBCA77), (0, 2, 3, 0xC2B2AE3D))


def codes_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Length step and the quartile of each bucket: n x (1 + BUCKETS) uint8."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    counts = np.zeros((n, BUCKETS), np.int64)
    if len(data) > 3:
        doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
        inside = doc[3:] == doc[:-3]
        base = doc[:-3][inside].astype(np.int64) * BUCKETS
        wide, last = data.astype(np.uint32), len(data) - 3
        for a, b, c, salt in TRIPLETS:
            h = wide[a : last + a] * np.uint32(salt | 1) + wide[b : last + b] * np.uint32(0x27D4EB2F) + wide[c : last + c] * np.uint32(0x165667B1)
            h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(24)
            counts += np.bincount(base + h[inside], minlength=n * BUCKETS).reshape(n, BUCKETS)
    quarter = BUCKETS // 4
    limits = np.partition(counts, [quarter - 1, 2 * quarter - 1, 3 * quarter - 1], axis=1)[:, [quarter - 1, 2 * quarter - 1, 3 * quarter - 1]]
    body = (counts[:, :, None] > limits[:, None, :]).sum(axis=2)
    length = np.minimum(np.floor(np.log(np.maximum(sizes, 1)) / np.log(LENGTH_STEP)), 255)
    return np.concatenate([length[:, None], body], axis=1).astype(np.uint8)


def to_text(codes: np.ndarray) -> list[str]:
    """Hex: the length byte, then four buckets a byte."""
    four = codes[:, 1:].reshape(len(codes), -1, 4)
    packed = np.concatenate([codes[:, :1], four[:, :, 0] << 6 | four[:, :, 1] << 4 | four[:, :, 2] << 2 | four[:, :, 3]], axis=1).astype(np.uint8)
    return [row.tobytes().hex() for row in packed]


def from_text(digests) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex("".join(digests)), np.uint8).reshape(len(digests), 1 + BUCKETS // 4)
    four = packed[:, 1:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3
    return np.concatenate([packed[:, :1], four.reshape(len(packed), BUCKETS)], axis=1)


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bounded difference of digests: 0 to BOUND."""
    body = STEPS[np.abs(a[:, 1:].astype(np.int64) - b[:, 1:])].sum(axis=1)
    return np.minimum(body + np.abs(a[:, 0].astype(np.int64) - b[:, 0]), BOUND)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - difference(a, b) / BOUND


def digest(df: DataFrame, text: str = "text") -> DataFrame:
    """The frame with a column fingerprint."""

    @F.arrow_udf("string")
    def fingerprint(texts: pa.Array) -> pa.Array:
        out = []
        for part in slices([pa.RecordBatch.from_arrays([texts], ["text"])], limit=SLICE):
            out += to_text(codes_of(*flat(part.column(0))))
        return pa.array(out, pa.string())

    return df.withColumn("fingerprint", fingerprint(text_of(text)))


class Ranges:
    """Numbers of ranges, ascending with (doc_id, hash of the text); null ids come first, down from 0."""

    def __init__(self, bounds: list[int], nulls: int):
        self.bounds, self.nulls = np.array(bounds, np.int64), max(nulls, 1)

    def of(self, ids: pa.Array, hashes: pa.Array) -> np.ndarray:
        own, h = ids.fill_null(0).to_numpy(zero_copy_only=False), hashes.to_numpy(zero_copy_only=False)
        share = (h.astype(np.float64) + 2.0**63) / 2.0**64  # where the hash lies among all: 0 to 1
        low, high = (np.searchsorted(self.bounds, own, side=x) for x in ("left", "right"))
        each = high - low  # bounds that are this id: so many ranges has it
        out = np.where(each > 0, low + 1 + np.minimum((share * each).astype(np.int64), np.maximum(each - 1, 0)), high + 1)
        void = np.minimum((share * self.nulls).astype(np.int64), self.nulls - 1) - (self.nulls - 1)
        return np.where(ids.is_valid().to_numpy(zero_copy_only=False), out, void).astype(np.int32)


def with_next(df: DataFrame, doc_id: str, text: str, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, fingerprint, z (the compressed text), and fingerprint and z of the next document in descending
    doc_id."""
    spark = bounded(df.sparkSession)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    sizes = rows.agg(F.count("*").alias("all"), F.count("doc_id").alias("named"), F.sum(F.octet_length("text")).alias("bytes")).first()
    ranges = ranges or max(2 * hash_partitions(spark), -(-(sizes["bytes"] or 0) // RANGE_BYTES))
    bounds = rows.select("doc_id").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    place = Ranges(sorted(int(x) for x in bounds), -(-ranges * (sizes["all"] - sizes["named"]) // max(sizes["all"], 1)))
    keyed = rows.withColumn("h", F.xxhash64("text"))

    def described(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for part in slices(batches, limit=SLICE):
            data, offsets = flat(array_of(part, "text"))
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
            raw, cuts = data.tobytes(), offsets.tolist()
            body = pa.array([squeeze(raw[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())
            ids, h = array_of(part, "doc_id"), array_of(part, "h")
            yield pa.RecordBatch.from_arrays([ids, h, pa.array(np.diff(chars)), pa.array(to_text(codes_of(data, offsets)), pa.string()), pa.array(place.of(ids, h)), body], ["doc_id", "h", "n_chars", "fingerprint", "r", "z"])

    numbered = F.arrow_udf(lambda ids, h: pa.array(place.of(ids, h)), "int")
    # one row per range: as many as bounds, not as documents
    found = keyed.select("doc_id", "h").withColumn("r", numbered("doc_id", "h")).groupBy("r").agg(F.max_by("doc_id", F.struct("doc_id", "h")).alias("doc_id"), F.max_by("h", F.struct("doc_id", "h")).alias("h")).collect()
    heads = sorted((r.r, r.doc_id, r.h) for r in found) if found else [(0, None, 0)]
    to = {r: heads[i + 1][0] if i + 1 < len(heads) else heads[0][0] for i, (r, *_) in enumerate(heads)}
    heads_df = spark.createDataFrame([(r, top, h, to[r]) for r, top, h in heads], "r int, top long, top_h long, to int")
    placed = keyed.mapInArrow(tidied(described), "doc_id long, h long, n_chars long, fingerprint string, r int, z binary").join(F.broadcast(heads_df), "r")
    own = F.struct(F.col("r").alias("at"), F.lit(0).alias("guard"))
    guard = F.struct(F.col("to").alias("at"), F.lit(1).alias("guard"))
    first = F.col("doc_id").eqNullSafe(F.col("top")) & (F.col("h") == F.col("top_h"))
    dealt = placed.select("doc_id", "h", "n_chars", "fingerprint", "z", F.explode(F.when(first, F.array(own, guard)).otherwise(F.array(own))).alias("p"))
    order = Window.partitionBy("at").orderBy("guard", F.desc_nulls_last("doc_id"), F.desc("h"))
    follow = dealt.select("doc_id", "h", "n_chars", "fingerprint", "z", "p.*").select("*", F.lead(F.struct("z", "fingerprint")).over(order).alias("next"))
    return follow.filter("guard = 0").select("doc_id", "n_chars", "fingerprint", "z", F.col("next.fingerprint").alias("next_fingerprint"), F.col("next.z").alias("next_z"))


def edited(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its digest, that of its text with the last third replaced by the start of the next document,
    and the likeness to the edited text and to the next document."""

    def compare(batches):
        expand = zstandard.ZstdDecompressor().decompress
        for part in slices(batches, "z", limit=SLICE // 2):
            texts, heads = ([expand(z).decode() for z in array_of(part, c).to_pylist()] for c in ("z", "next_z"))
            new = pa.array([t[: n - n // 3] + h[: n // 3] for t, h, n in zip(texts, heads, array_of(part, "n_chars").to_pylist())], pa.large_string())
            data, offsets = flat(new)
            own, following = (from_text(array_of(part, c).to_pylist()) for c in ("fingerprint", "next_fingerprint"))
            changed = codes_of(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [array_of(part, "doc_id"), array_of(part, "n_chars"), pa.array(sha256_each(data, offsets)), array_of(part, "fingerprint"), pa.array(to_text(changed)), pa.array(likeness(own, changed)), pa.array(likeness(own, following))],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(df, doc_id, text).mapInArrow(tidied(compare), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
