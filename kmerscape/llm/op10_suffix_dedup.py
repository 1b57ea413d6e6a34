"""Suffix-array dedup on bytes: removes what a ``length``-byte string covers that also starts earlier.

anchors.py finds the windows that may repeat and collapses equal segments to one row with the first place and a count.
The suffixes at a segment's windows are sorted in buckets: sampled splitters (Spark's range partitioner) deal segments by
the leading bytes of their anchor, so that equal windows, which have equal anchors, never lie on two sides of a splitter;
what remains to compare across a boundary of buckets is therefore decided by the splitter itself. A bucket sorts its
suffixes by multikey quicksort, eight bytes a character, to depth ``length``: a round orders the suffixes that still tie
by their next character and splits the ties. Suffixes that tie to the end are equal windows; all but the earliest
(smaller doc_id, or earlier start) are marked. A segment with copies puts a later copy into the sort besides the first.

Defined cases: null text is empty; texts under ``length`` bytes stay; null doc_id is the smallest; rows of equal doc_id
count as one document, so equal rows are not earlier than each other; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors, bloom
from .flat import flat, sha256_each, slices, spread, starts_of

LENGTH = 100
GRAM = 38
#: Bytes of segments in a bucket's sort.
BUCKET = 2 << 20
LATER = (1 << 63) - 1


def tie_groups(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A group number for each suffix position, equal where the next ``length`` bytes are; -1 where no other is equal.

    Multikey quicksort with eight bytes a character. Rows are kept in the order of their groups; a round splits the groups
    that differ in the next character by sorting them on it, and leaves those that agree as they are."""
    out = np.full(len(at), -1, np.int64)
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.zeros(len(data) + 1, np.uint64)
    for byte in range(8):
        eight = eight << np.uint64(8) | wide[byte : byte + len(eight)]
    who, starts = np.arange(len(at)), np.zeros(min(len(at), 1), np.int64)
    for depth in range(0, length, 8):
        if not len(who):
            return out
        key = eight[at[who] + depth]
        if length - depth < 8:
            key >>= np.uint64(8 * (8 - (length - depth)))
        sizes = np.diff(np.append(starts, len(who)))
        differs = np.repeat(np.logical_or.reduceat(key != np.repeat(key[starts], sizes), starts), sizes)
        rows = np.flatnonzero(differs)
        if len(rows):
            group = np.repeat(np.arange(len(starts)), sizes)[rows]
            order = rows[np.lexsort((key[rows], group)) if len(starts) > 1 else np.argsort(key[rows], kind="stable")]
            who[rows], key[rows] = who[order], key[order]
        fresh = np.zeros(len(who), bool)
        fresh[starts] = True
        fresh[1:] |= key[1:] != key[:-1]
        alone = fresh & np.append(fresh[1:], True)
        who, starts = who[~alone], np.flatnonzero(fresh[~alone])
    out[who] = np.cumsum(np.bincount(starts, minlength=len(who))[: len(who)])
    return out


def later_windows(data, bounds, copies, doc, start, length) -> tuple[np.ndarray, np.ndarray]:
    """For each segment, masks of the windows of its first copy and of a later one that also start earlier."""
    windows = np.diff(bounds) - length + 1
    row = np.repeat(np.arange(len(windows)), windows)
    bit = spread(np.zeros(len(windows), np.int64), windows)
    again = np.flatnonzero(copies[row] > 1)
    row, bit = np.concatenate([row, row[again]]), np.concatenate([bit, bit[again]])
    copy = np.zeros(len(row), bool)
    copy[len(row) - len(again) :] = True
    group = tie_groups(data, bounds[row] + bit, length)
    masks = np.zeros((2, len(windows)), np.int64)
    some = np.flatnonzero(group >= 0)
    if len(some):
        row, bit, copy, group = row[some], bit[some], copy[some], group[some]
        own_doc, own_start = np.where(copy, LATER, doc[row]), start[row] + bit
        order = np.lexsort((own_start, own_doc, group))
        row, bit, copy, group, own_doc, own_start = (x[order] for x in (row, bit, copy, group, own_doc, own_start))
        fresh = np.concatenate([[True], group[1:] != group[:-1]])
        head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        late = (own_doc != own_doc[head]) | (own_start != own_start[head]) | (copy & ~copy[head])
        np.bitwise_or.at(masks, (copy[late].astype(np.int64), row[late]), np.int64(1) << bit[late])
    return masks[0], masks[1]


def _kernel(length: int):
    def run(data, offsets, n, copies, doc, a):
        return later_windows(data, offsets, copies, doc, a, length)

    return run


def repeats(df: DataFrame, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", max_bits: int = bloom.MAX_BITS, hot: int = anchors.HOT) -> DataFrame:
    """doc_id, tkey (hash of the text) and marks: windows (a + bit of mask) of bytes that also start earlier."""
    found = anchors.segments(anchors.keyed(df, doc_id, text), anchors.BYTES, length, gram, max_bits, hot)
    return anchors.marks(found, anchors.decide(found, _kernel(length), True, BUCKET))


def dedup(df: DataFrame, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", kept: bool = True, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end of each removed run) and, where wanted, the
    kept bytes."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["spans", "kept"] * kept]

    def run(batches):
        for part in slices(batches, 2, limit=1 << 20):
            data, offsets = flat(part.column(2))
            gone = anchors.covered(part.column(3), offsets, length)
            begins, ends = gone.copy(), gone.copy()
            begins[1:] &= ~gone[:-1]
            ends[:-1] &= ~gone[1:]
            inner = offsets[1:-1]
            inner = inner[(inner > 0) & (inner < len(data))]
            begins[inner] = gone[inner]
            ends[inner - 1] = gone[inner - 1]
            first = np.flatnonzero(begins)
            spans = np.searchsorted(first, offsets)
            left = np.concatenate([[0], np.cumsum(~gone)])[offsets]
            rest = data[~gone]
            columns = [part.column(0), pa.array(np.diff(offsets)), pa.array(np.diff(offsets) - np.diff(left)), pa.array(np.diff(spans)), pa.array(sha256_each(rest, left))]
            if kept:
                doc = np.repeat(offsets[:-1], np.diff(spans))
                pairs = np.stack([first - doc, np.flatnonzero(ends) + 1 - doc], axis=1).reshape(-1)
                pair = pa.ListArray.from_arrays(pa.array(np.arange(0, len(pairs) + 1, 2), pa.int32()), pa.array(pairs))
                raw = rest.tobytes()
                columns += [pa.ListArray.from_arrays(pa.array(spans, pa.int32()), pair), pa.array([raw[a:b] for a, b in zip(left.tolist(), left[1:].tolist())], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    ids = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<array<long>>, kept binary" * kept
    return anchors.with_marks(ids, repeats(df, length, gram, doc_id, text, **options), "doc_id", "text", run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), kept=False)
