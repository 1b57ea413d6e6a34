"""Bloom filters over 64-bit hashes, in pages that tasks build and merge apart.

All cells of a hash lie in one page of 65,536 cells, so partial filters merge page by page: a task sends, for each page,
the cells that its rows set (a hash that it has more often, twice); the owner of the page counts them (0, 1, 2 or more).
The number of pages grows with the keys, so a filter never fills up.

A filter is asked in one of two ways. Up to ``max_bits`` it is broadcast. Beyond that nothing of it is: a table of pages
(``pages``) is joined by page number, and operators whose test runs inside a Python step join their keys instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flat import flat, mix, tidied

PAGE = 1 << 16
CELLS = 4
BITS_PER_KEY = 20
#: The largest filter that is broadcast: 2**28 bits are 32 MB.
MAX_BITS = 1 << 28


def pages_for(keys: int, bits_per_key: int = BITS_PER_KEY) -> int:
    """A power of two."""
    want = max(1, -(-keys * bits_per_key // PAGE))
    return 1 << (want - 1).bit_length()


def fits(keys: int, max_bits: int = MAX_BITS) -> bool:
    """Whether a filter of so many keys may be broadcast."""
    return pages_for(keys) * PAGE <= max(max_bits, PAGE) and max_bits > 0


def cells_of(hashes: np.ndarray, pages: int) -> tuple[np.ndarray, np.ndarray]:
    """(page of each hash, its cells in the page: n x CELLS uint16)."""
    h = mix(hashes.astype(np.uint64))
    page = (mix(h + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(20)) % np.uint64(pages)
    return page.astype(np.int64), np.ascontiguousarray(h).view(np.uint16).reshape(-1, CELLS)


def _twice(values: np.ndarray) -> np.ndarray:
    """Each value as often as it occurs, but twice at most."""
    values, n = np.unique(values, return_counts=True)
    return np.repeat(values, np.minimum(n, 2))


def _merged(batches, least: int):
    """(page, bits) of the pages whose partial cells a task has."""
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        raw, offsets = flat(batch.column(1))
        for i, page in enumerate(batch.column(0).to_pylist()):
            got = np.bincount(np.frombuffer(raw[offsets[i] : offsets[i + 1]].tobytes(), np.uint16), minlength=PAGE)
            had = counts.setdefault(page, np.zeros(PAGE, np.uint8))
            np.minimum(got + had, 2, out=had, casting="unsafe")
    for page, had in counts.items():
        yield page, np.packbits(had >= least, bitorder="little")


def _by_page(page: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(page, kind="stable")
    own, first = np.unique(page[order], return_index=True)
    raw, cuts = cells[order], [*first.tolist(), len(order)]
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([raw[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], ["page", "cells"])


def build(hashes: DataFrame, keys: int) -> np.ndarray:
    """Bits of the cells that the one column of hashes sets, for a filter that fits()."""
    pages, column = pages_for(keys), hashes.columns[0]

    def partial(batches):
        for batch in batches:
            yield _by_page(*cells_of(np.unique(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)).view(np.uint64), pages))

    def merged(batches):
        for page, bits in _merged(batches, 1):
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.int64()), pa.array([bits.tobytes()], pa.binary())], ["page", "cells"])

    schema = "page long, cells binary"
    parts = hashes.filter(F.col(column).isNotNull()).mapInArrow(tidied(partial), schema)
    bits = np.zeros((pages, PAGE // 8), np.uint8)
    # one row per page, max_bits in all
    for row in parts.repartition(min(pages, 256), "page").mapInArrow(tidied(merged), schema).collect():
        bits[row.page] = np.frombuffer(row.cells, np.uint8)
    return bits


def contains(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether all cells of each hash are set."""
    page, cells = cells_of(hashes, len(bits))
    out = np.ones(len(hashes), bool)
    for i in range(CELLS):
        cell = cells[:, i]
        out &= (bits[page, cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
    return out


# --- filters as tables, asked by DataFrame operations -----------------------------------------------------------------
def page_of(h: Column, n: int) -> Column:
    return F.pmod(h, F.lit(n).cast("long"))


def pages(hashes: DataFrame, n: int, least: int) -> DataFrame:
    """(page, words): 1,024 longs of bits for each of ``n`` pages, of the cells that at least ``least`` (1 or 2) rows of the
    one column of hashes set. A page without such a cell has no row."""
    h = F.col(hashes.columns[0])
    placed = hashes.filter(h.isNotNull()).select(page_of(h, n).alias("page"), F.xxhash64(h).alias("cells"))

    def partial(batches):
        for batch in batches:
            both = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)], axis=1)
            both = _twice(np.ascontiguousarray(both).view("i8,i8").reshape(-1))
            yield _by_page(both["f0"], np.ascontiguousarray(both["f1"]).view(np.uint16).reshape(-1, CELLS))

    def merged(batches):
        for page, bits in _merged(batches, least):
            if bits.any():
                yield pa.RecordBatch.from_arrays([pa.array([page], pa.int64()), pa.array([bits.view("<i8")], pa.list_(pa.int64()))], ["page", "words"])

    parts = placed.mapInArrow(tidied(partial), "page long, cells binary")
    return parts.repartition(min(n, max(1024, n >> 6)), "page").mapInArrow(tidied(merged), "page long, words array<long>")  # some 64 pages a task


def asked(h: Column, words: Column) -> Column:
    """Whether all cells of a hash are set in its page."""
    cells = F.xxhash64(h)
    out = F.lit(True)
    for i in range(CELLS):
        cell = F.shiftrightunsigned(cells, 16 * i).bitwiseAND(F.lit(PAGE - 1).cast("long")).cast("int")
        out = out & (F.getbit(F.get(words, F.shiftright(cell, 6)), cell.bitwiseAND(F.lit(63))) == 1)
    return out


def split(df: DataFrame, h: Column, filter_pages: DataFrame, n: int, names: tuple[str, str], max_bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows whose hash the filter may hold, the other rows). ``names``: two names that are free in the frame. A filter of
    up to ``max_bits`` bits is broadcast; a larger one meets the rows by page, in a shuffle."""
    at, bits = names
    side = filter_pages.select(F.col("page").alias(at), F.col("words").alias(bits))
    side = F.broadcast(side) if n * PAGE <= max_bits else side.hint("merge")
    fits_in = (page_of(h, n) == F.col(at)) & asked(h, F.col(bits))
    return df.join(side, fits_in, "left_semi"), df.join(side, fits_in, "left_anti")
