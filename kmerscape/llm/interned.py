"""Ids of distinct byte strings, kept between the slices of a Python worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .flat import BYTE_VALUES, Rolling, binary_array, spread, starts_of


class Interned:
    """A map from byte strings to id sequences in numpy arrays: sorted 64-bit hashes, compared byte by byte on a hit.

    It stops taking new strings beyond ``limit``; those are then encoded in every slice. Results never depend on it.
    """

    def __init__(self, limit: int = 1_000_000):
        self.limit = limit
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.text, self.text_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.ids_at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def find(self, data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Row of each string, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        rows = np.where(self.hashes[at] == hashes, self.rows[at], -1)
        sizes = np.diff(offsets)
        hit = np.flatnonzero(rows >= 0)
        hit = hit[(self.text_at[rows[hit] + 1] - self.text_at[rows[hit]]) == sizes[hit]]
        same = self.text[spread(self.text_at[rows[hit]], sizes[hit])] == data[spread(offsets[:-1][hit], sizes[hit])]
        ok = np.logical_and.reduceat(same, starts_of(sizes[hit])[:-1]) if len(hit) else np.zeros(0, bool)
        out = np.full(len(hashes), -1, np.int64)
        out[hit[ok]] = rows[hit[ok]]
        return out

    def add(self, data, offsets, hashes, ids, ids_at) -> None:
        room = self.limit - len(self.rows)
        at = np.searchsorted(self.hashes, hashes)
        new = np.ones(len(hashes), bool) if not len(self.hashes) else self.hashes[np.minimum(at, len(self.hashes) - 1)] != hashes
        _, first = np.unique(hashes, return_index=True)
        once = np.zeros(len(hashes), bool)
        once[first] = True
        keep = np.flatnonzero(new & once)[: max(room, 0)]
        if not len(keep):
            return
        sizes, counts = np.diff(offsets)[keep], np.diff(ids_at)[keep]
        base = len(self.text_at) - 1
        self.text = np.concatenate([self.text, data[spread(offsets[:-1][keep], sizes)]])
        self.text_at = np.concatenate([self.text_at, self.text_at[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids[spread(ids_at[:-1][keep], counts)]])
        self.ids_at = np.concatenate([self.ids_at, self.ids_at[-1] + np.cumsum(counts)])
        order = np.argsort(hashes[keep], kind="stable")
        keys, rows = hashes[keep][order], base + order
        where = np.searchsorted(self.hashes, keys)
        self.hashes, self.rows = np.insert(self.hashes, where, keys), np.insert(self.rows, where, rows)

    def encode(self, data: np.ndarray, starts: np.ndarray, how: Callable) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each string); the strings are the parts of ``data`` between ``starts``.

        ``how(data, offsets)`` returns (ids, offsets in them) of strings that are not known yet.
        """
        coded = binary_array(data, np.append(starts, len(data))).dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        _, offs, raw = coded.dictionary.buffers()
        offsets = np.frombuffer(offs, np.int64, len(coded.dictionary) + 1)
        own = np.frombuffer(raw, np.uint8)[: offsets[-1]]
        hashes = Rolling(BYTE_VALUES[own], 0xA0761D6478BD642F).of(offsets[:-1], offsets[1:])
        rows = self.find(own, offsets, hashes)
        lost = np.flatnonzero(rows < 0)
        sizes = np.diff(offsets)[lost]
        part, part_at = own[spread(offsets[:-1][lost], sizes)], starts_of(sizes)
        ids, ids_at = how(part, part_at) if len(lost) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        # known strings first, then the new ones
        begin, count = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        hit = rows >= 0
        begin[hit], count[hit] = self.ids_at[rows[hit]], self.ids_at[rows[hit] + 1] - self.ids_at[rows[hit]]
        begin[lost], count[lost] = len(self.ids) + ids_at[:-1], np.diff(ids_at)
        pool = np.concatenate([self.ids, ids])
        counts = count[index]
        out = pool[spread(begin[index], counts)]
        if len(lost):
            self.add(part, part_at, hashes[lost], ids, ids_at)
        return out, counts
