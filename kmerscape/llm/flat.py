"""Texts of an Arrow batch as one flat byte array, and steps that all operators take on such arrays.

An operator's Python side never loops over characters: a batch is cut into slices of bounded size, each slice is one
numpy byte array with document offsets, and words, shingles or windows are index arithmetic on it.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of text that are worked on at a time (a single longer text is still worked on whole).
SLICE_BYTES = 2 << 20
MASK64 = (1 << 64) - 1


def release() -> None:
    """Gives freed memory back to the system: a Python worker stays for later stages, and what it keeps adds up."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidied(run: Callable) -> Callable:
    """A function for mapInArrow that releases memory when its task ends."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, b"" if binary else "")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, text: str | int = "text", limit: int = SLICE_BYTES, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of a slice stay near ``limit`` bytes and ``rows`` rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = min(max(start + 1, int(np.searchsorted(ends, before + limit, side="right"))), start + rows)
            yield batch.slice(start, stop - start)
            start = stop


def binary_array(data: np.ndarray, offsets: np.ndarray, kind=None) -> pa.Array:
    """An Arrow array over flat bytes without a copy of each value."""
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(kind or pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + length), one after the other; one array of the result's size is made."""
    some = lengths > 0
    if not some.all():
        starts, lengths = starts[some], lengths[some]
    ends = np.cumsum(lengths)
    out = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    if len(ends):
        out[0] = starts[0]
        out[ends[:-1]] = starts[1:] - starts[:-1] - lengths[:-1] + 1
        np.cumsum(out, out=out)
    return out


def starts_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def is_blank(data: np.ndarray) -> np.ndarray:
    """ASCII space and \\x09-\\x0D."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end of each word in the bytes; offset of each document in the words). Words hold no byte of is_blank."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~is_blank(data)
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    ends = ink.copy()
    ends[:-1] &= ~ink[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = ink[cuts]
    ends[cuts - 1] = ink[cuts - 1]
    first = np.flatnonzero(begins)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Rolling:
    """Hashes of any range of a sequence, by prefix sums of value * base**position modulo 2**64. For ranges of some hundred
    values: beyond a thousand, there are sequences of two values that collide for every base."""

    def __init__(self, values: np.ndarray, base: int):
        """``values``: well mixed uint64."""
        n = len(values)
        self.base = base | 1
        self.back = _powers(pow(self.base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.multiply(values, _powers(self.base, n + 1)[:n], out=self.sums[1:])
        np.cumsum(self.sums, out=self.sums)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def all(self, length: int) -> np.ndarray:
        """The hash of each range of this length."""
        n = len(self.sums) - length
        return np.zeros(0, np.uint64) if n <= 0 else mix((self.sums[length:] - self.sums[:-length]) * self.back[:n])


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1); kept for the next slice unless it is long."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(n, 1 << 12)
        known = np.ones(size, np.uint64)
        done, step = 1, base
        while done < size:
            more = min(done, size - done)
            known[done : done + more] = known[:more] * np.uint64(step)
            step = step * step & MASK64
            done += more
        if size <= 1 << 21:
            _POWERS[base] = known
    return known[:n]


#: A well mixed value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


#: Mask of the first 0 to 8 bytes of a little-endian word.
FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """xxh3 of the bytes of each range."""
    view = memoryview(np.ascontiguousarray(data))
    return np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(start.tolist(), end.tolist())), np.uint64, len(start))


def word_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word. Up to 16 bytes are mixed as two numbers, longer words are hashed by xxh3: a polynomial
    modulo a power of two would give long words of two letters in certain orders one hash."""
    if not len(first):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    size = end - first
    low = eight[first] & FIRST_BYTES[np.minimum(size, 8)]
    high = eight[first + 8] & FIRST_BYTES[np.clip(size - 8, 0, 8)]
    out = mix(low ^ mix(high + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    long = np.flatnonzero(size > 16)
    if len(long):
        out[long] = range_hashes(data, first[long], end[long])
    return out


def exact_ids(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word, equal where the bytes are: hashes propose, bytes decide."""
    if not len(first):
        return np.zeros(0, np.int64)
    size = end - first
    _, one, ids = np.unique(word_hashes(data, first, end), return_index=True, return_inverse=True)
    other = one[ids]
    same = size == size[other]
    if same.all():
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        a, b = first, first[other]
        same = ((eight[a] ^ eight[b]) & FIRST_BYTES[np.minimum(size, 8)]) | ((eight[a + 8] ^ eight[b + 8]) & FIRST_BYTES[np.clip(size - 8, 0, 8)]) == 0
        long = np.flatnonzero(size > 16)
        if len(long):
            same[long] = np.logical_and.reduceat(data[spread(a[long], size[long])] == data[spread(b[long], size[long])], starts_of(size[long])[:-1])
    if same.all():
        return ids
    return binary_array(data[spread(first, size)], starts_of(size)).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def sha256_each(data, offsets) -> list[str]:
    view = memoryview(np.ascontiguousarray(data)).cast("B")
    bounds = offsets.tolist()
    return [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(bounds, bounds[1:])]


def crc32_each(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """crc32 of each range of ids, as little-endian unsigned 32-bit integers."""
    view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    bounds = (np.asarray(offsets) * 4).tolist()
    return np.fromiter((zlib.crc32(view[a:b]) for a, b in zip(bounds, bounds[1:])), np.int64, len(bounds) - 1)


def array_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
