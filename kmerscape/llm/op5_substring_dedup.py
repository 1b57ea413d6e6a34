"""Substring dedup on words by a compressed FM-index per shard.

Windows of ``window`` words whose sequence also starts anywhere else are found; their words can be removed. anchors.py
brings equal windows into one shard (by a hash of the anchor), each distinct segment once with its count. A shard's
segments are the text of a run-length compressed FM-index: suffix array by prefix doubling, Burrows-Wheeler transform, its
runs of equal symbols kept as one bit vector of starts and a wavelet matrix of the runs' symbols, so that the index grows
with the runs (repeated text has few) and not with the text. Segments that occur more than once enter the text twice, which
is all that the question "twice or more" needs. The documents' segments that belong to the shard are then streamed through
the index side by side, equal ones once: backward search extends a match leftwards while it has two occurrences, which gives
matching statistics; matches of ``window`` words or more are reported as intervals of repeated windows. Symbols are numbers
of words that are equal byte by byte.

A document meets only the shards of its own anchors: every other shard has none of its windows, as equal windows have equal
anchors. Streaming all documents through all shards would give the same intervals at quadratic cost.

Defined cases: null text has no words; texts under ``window`` words have no window; every copy goes, the first included;
repeated rows are two occurrences; null doc_id is a key like others; an empty table gives an empty result; long texts have
many segments, which are dealt apart (a single text is cut into its words as one value); columns of any other name stay as
they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors, bloom
from .flat import exact_ids, flat, sha256_each, slices, spread, starts_of, words

WINDOW = 35
GRAM = 10
#: Bytes of segments in a shard.
SHARD = 3 << 20


class Bits:
    """A packed bit vector with rank counters."""

    def __init__(self, bit: np.ndarray):
        padded = np.zeros((len(bit) // 64 + 1) * 64, bool)
        padded[: len(bit)] = bit
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.ranks = starts_of(np.bitwise_count(self.words).astype(np.int64))[:-1].astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many bits before each place are set."""
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ranks[block] + np.bitwise_count(self.words[block] & below).astype(np.int64)

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.ranks.nbytes


class WaveletMatrix:
    """Rank of symbols in a sequence; one packed bit vector per bit of a symbol."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels, now = max(1, int(symbols - 1).bit_length()), sequence.astype(np.int32)
        self.bits, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            self.bits.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefix of length ``at`` ends in the order of the last level, for each symbol."""
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.bits[i].ones(at)
            at = np.where(symbol >> level & 1, self.zeros[i] + ones, at - ones)
        return at

    @property
    def nbytes(self) -> int:
        return sum(b.nbytes for b in self.bits)


class RunLengths:
    """Rank of symbols in a sequence that is kept as runs of equal symbols."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        change = np.ones(len(sequence), bool)
        change[1:] = sequence[1:] != sequence[:-1]
        self.starts = np.append(np.flatnonzero(change), len(sequence))
        self.heads = np.append(sequence[self.starts[:-1]], -1)
        self.place, self.matrix = Bits(np.append(change, True)), WaveletMatrix(self.heads[:-1], symbols)
        runs = np.argsort(self.heads[:-1], kind="stable")
        self.before = starts_of(np.diff(self.starts)[runs])  # lengths of the runs by symbol, summed
        first = starts_of(np.bincount(self.heads[:-1], minlength=symbols))[:-1]
        # from the matrix's own order to the runs by symbol
        self.move = first - self.matrix.descend(np.arange(symbols), np.zeros(symbols, np.int64))
        self.first = self.before[first]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the symbol before ``at``, plus the number of smaller symbols in all."""
        run = self.place.ones(at + 1) - 1
        whole = self.before[self.move[symbol] + self.matrix.descend(symbol, run)]
        return whole + np.where(self.heads[run] == symbol, at - self.starts[run], 0)

    @property
    def nbytes(self) -> int:
        return self.place.nbytes + self.matrix.nbytes + sum(x.nbytes for x in (self.starts, self.heads, self.before, self.move, self.first))


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling; only suffixes that still tie are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.zeros(n, np.int64)
    change = np.concatenate([[True], symbols[order][1:] != symbols[order][:-1]])
    rank[order] = np.maximum.accumulate(np.where(change, np.arange(n), 0))
    step = 1
    while True:
        tied = np.concatenate([rank[order][1:] == rank[order][:-1], [False]])
        tied[1:] |= tied[:-1]
        slots = np.flatnonzero(tied)
        if not len(slots):
            return order
        who = order[slots]
        after = who + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        again = np.lexsort((second, rank[who]))
        order[slots] = who[again]
        first, second = rank[who][again], second[again]
        change = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        rank[order[slots]] = np.maximum.accumulate(np.where(change, slots, 0))
        step *= 2


class FmIndex:
    """Over segments of word numbers (0, 1, ...); ``copies`` (1 or 2) says how often each is in the text."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, copies: np.ndarray):
        ids = ids.astype(np.int64)
        lengths = np.diff(bounds)
        again = np.repeat(np.arange(len(lengths)), copies)
        size = lengths[again] + 1
        ends = np.cumsum(size) - 1
        text = np.zeros(int(size.sum()), np.int64)
        inner = np.ones(len(text), bool)
        inner[ends] = False
        text[inner] = len(again) + ids[spread(bounds[:-1][again], lengths[again])]
        text[ends] = np.arange(len(again))  # separators differ, so that suffixes do
        last = text[suffix_array(text) - 1]
        last = np.where(last < len(again), 0, last - len(again) + 1)
        self.runs = RunLengths(last, int(ids.max(initial=-1)) + 2)
        self.size, self.ids = len(text), ids + 1

    def back(self, symbol, low, high):
        """The interval of the match with this symbol before it."""
        both = self.runs.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return both[: len(symbol)], both[len(symbol) :]


def repeated_windows(values: np.ndarray, bounds: np.ndarray, copies: np.ndarray, window: int) -> np.ndarray:
    """For each segment a mask of its windows that occur twice or more in the shard."""
    index = FmIndex(values, bounds, np.minimum(copies, 2))
    lengths = np.diff(bounds)
    masks = np.zeros(len(lengths), np.int64)
    row = np.arange(len(lengths))
    want = lengths - window  # the last window that is not decided
    start = want + window  # the match is [start, want + window)
    low, high = np.zeros(len(row), np.int64), np.full(len(row), index.size, np.int64)
    while len(row):
        go = start > 0
        symbol = index.ids[bounds[row] + np.maximum(start - 1, 0)]
        new_low, new_high = index.back(symbol, low, high)
        go &= new_high - new_low >= 2
        low, high, start = np.where(go, new_low, low), np.where(go, new_high, high), start - go
        # a match that ends here: windows start .. want repeat, or the window at want doesn't
        stop = ~go
        if stop.any():
            hit = stop & (start <= want)
            reach = ((np.int64(1) << (want[hit] - start[hit] + 1)) - 1) << start[hit]
            masks[row[hit]] |= reach
            want = np.where(hit, start - 1, np.where(stop, want - 1, want))
            start = np.where(stop, want + window, start)
            low, high = np.where(stop, 0, low), np.where(stop, index.size, high)
            left = want >= 0
            row, want, start, low, high = row[left], want[left], start[left], low[left], high[left]
    return masks


def _kernel(window: int):
    def run(data, offsets, n, copies, doc, a):
        first, end, bounds = words(data, offsets)
        masks = repeated_windows(exact_ids(data, first, end), bounds, copies, window)
        return masks, masks

    return run


def repeats(df: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", max_bits: int = bloom.MAX_BITS, hot: int = anchors.HOT) -> DataFrame:
    """doc_id, tkey (hash of the text) and marks: windows (a + bit of mask) whose words also start elsewhere."""
    found = anchors.segments(anchors.keyed(df, doc_id, text), anchors.WORDS, window, gram, max_bits, hot)
    return anchors.marks(found, anchors.decide(found, _kernel(window), False, SHARD))


def kept_words(data: np.ndarray, offsets: np.ndarray, marks: pa.Array, window: int):
    """(bytes of the kept words joined by one space, their offsets, words, removed words)."""
    first, end, bounds = words(data, offsets)
    gone = anchors.covered(marks, bounds, window)
    size, stay = end - first, ~gone
    at = starts_of(size[stay] + 1)
    joined = np.full(int(at[-1]), 32, np.uint8)
    joined[spread(at[:-1], size[stay])] = data[spread(first[stay], size[stay])]
    kept = np.concatenate([[0], np.cumsum(stay)])[bounds]
    out = at[kept]
    # the space after each document's last word goes
    some = np.diff(kept) > 0
    joined = np.delete(joined, out[1:][some] - 1)
    return joined, out - np.concatenate([[0], np.cumsum(some)]), np.diff(bounds), np.diff(bounds) - np.diff(kept)


def dedup(df: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows with all columns; the text of rows with repeated windows is the words that are left, joined by spaces."""
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            for part in slices([batch], at, limit=1 << 20):
                marked = part.column(part.num_columns - 1)
                data, offsets = flat(part.column(at))
                joined, bounds, _, removed = kept_words(data, offsets, marked, window)
                view = joined.tobytes()
                old = part.column(at).to_pylist()
                new = [view[a:b].decode() if r else t for a, b, r, t in zip(bounds.tolist(), bounds[1:].tolist(), removed.tolist(), old)]
                columns = list(part.columns[:-2])
                columns[at] = pa.array(new, part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, part.schema.names[:-2])

    return anchors.with_marks(df, repeats(df, window, gram, doc_id, text, **options), doc_id, text, run, df.schema)


def report(df: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    def run(batches):
        for part in slices(batches, 2, limit=1 << 20):
            joined, bounds, n, removed = kept_words(*flat(part.column(2)), part.column(3), window)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(removed), pa.array(sha256_each(joined, bounds))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    ids = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return anchors.with_marks(ids, repeats(df, window, gram, doc_id, text, **options), "doc_id", "text", run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
