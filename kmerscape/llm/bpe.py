"""Byte-level BPE ids of whole texts by the tokenizers library, each distinct piece encoded once.

A text may be cut wherever a token of the pre-tokenizer surely ends; the pieces are encoded apart, with the same ids.
Cuts: before a space or line feed that follows something other than white space, and between an ASCII letter or digit
and other printable ASCII (but not beside an apostrophe, as in 's).
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from .flat import flat, spread, starts_of
from .interned import Interned

_LOADED: dict[str, ByteBpe] = {}
#: Characters of a joined string that is given to the library at once.
JOINED = 1 << 16
#: Kinds of bytes: 0 other, 1 letter, 2 digit, 3 printable rest, 4 apostrophe, 5 beyond ASCII.
KIND = np.zeros(256, np.uint8)
KIND[33:127] = 3
KIND[[*range(65, 91), *range(97, 123)]] = 1
KIND[48:58] = 2
KIND[39] = 4
KIND[128:] = 5


def load(path: str) -> ByteBpe:
    """The tokenizer of a file, once per process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start: at each text and at each cut. White space beyond ASCII: C2 85, C2 A0, and some three-byte
    characters that start with E1, E2 or E3."""
    if not len(data):
        return np.zeros(0, np.int64)
    kind = KIND[data]
    here, before = kind[1:], kind[:-1]
    solid = before > 0
    high = np.flatnonzero(before == 5)
    if len(high):
        two, three = data[np.maximum(high - 1, 0)], data[np.maximum(high - 2, 0)]
        solid[high[(two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3))]] = False
    cut = np.zeros(len(data), bool)
    blank = (data[1:] == 32) | (data[1:] == 10)
    plain = (before >= 1) & (before <= 3) & (here >= 1) & (here <= 3) & (before != here)
    cut[1:] = (blank & solid) | plain
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut)


class ByteBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("this encoder takes byte-level BPE files without a normaliser or prefix space")
        # the same model behind a splitter on white space: for pieces that are one pre-token, with the space written as Ġ
        self.whole = Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": None, "added_tokens": [], "post_processor": None}))
        self.whole.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.size[i] = len(token)
        self.known = Interned()
        self.special = [t["content"].encode() for t in spec["added_tokens"]]

    def fresh(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of distinct pieces: those of ASCII letters, of digits or of other characters in joined strings."""
        kind = KIND[data]
        lead = data[offsets[:-1]] == 32
        body = np.zeros(len(data), np.uint8)
        first = offsets[:-1] + lead
        empty = first >= offsets[1:]
        first = np.minimum(first, len(data) - 1)
        body[:] = kind == np.repeat(kind[first], np.diff(offsets))
        body[offsets[:-1][lead]] = 1
        simple = np.logical_and.reduceat(body.astype(bool), offsets[:-1]) & (kind[first] >= 1) & (kind[first] <= 3) & ~empty
        counts = np.zeros(len(simple), np.int64)
        got: list[tuple[np.ndarray, np.ndarray]] = []
        if simple.any():
            rows = np.flatnonzero(simple)
            sizes = np.diff(offsets)[rows]
            # each piece with a blank after it; its own space becomes a mark that turns into Ġ
            line = np.full(int(sizes.sum()) + len(rows), 32, np.uint8)
            ends = np.cumsum(sizes + 1)
            chars = data[spread(offsets[:-1][rows], sizes)]
            chars = np.where(chars == 32, np.uint8(1), chars)
            line[spread(ends - sizes - 1, sizes)] = chars
            cuts = [0, *ends[np.flatnonzero(np.diff(ends // JOINED))].tolist(), len(line)]
            raw = line.tobytes().decode("ascii").replace("\x01", "Ġ")
            parts = [raw[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]
            ids = np.fromiter((i for e in self.whole.encode_batch_fast(parts, add_special_tokens=False) for i in e.ids), np.uint32)
            reach = np.cumsum(self.size[ids])
            stop = np.searchsorted(reach, np.cumsum(sizes), side="left") + 1
            counts[rows] = np.diff(stop, prepend=0)
            if len(ids) != stop[-1] or reach[-1] != sizes.sum():
                raise ValueError("the model dropped characters")
            got.append((rows, ids))
        rest = np.flatnonzero(~simple)  # also texts with an added token, whole
        if len(rest):
            text, bounds = data.tobytes(), offsets.tolist()
            coded = [e.ids for e in self.tokenizer.encode_batch_fast([text[bounds[i] : bounds[i + 1]].decode() for i in rest.tolist()], add_special_tokens=False)]
            counts[rest] = np.fromiter(map(len, coded), np.int64, len(coded))
            got.append((rest, np.fromiter((i for c in coded for i in c), np.uint32)))
        bounds = starts_of(counts)
        out = np.zeros(int(bounds[-1]), np.uint32)
        for rows, ids in got:
            out[spread(bounds[:-1][rows], counts[rows])] = ids
        return out, bounds

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offset of each text in them); end_id is appended to each text."""
        data, offsets = flat(texts)
        starts = piece_starts(data, offsets)
        raw = data.tobytes()
        if any(t in raw for t in self.special):
            # the library finds added tokens before anything else: texts that hold one aren't cut
            whole = [any(t in raw[a:b] for t in self.special) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            starts = starts[~np.repeat(whole, np.diff(offsets))[starts] | np.isin(starts, offsets)]
        if len(starts):
            ids, counts = self.known.encode(data, starts, self.fresh)
            bounds = starts_of(counts)[np.searchsorted(starts, offsets)]
        else:
            ids, bounds = np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if end_id is not None:
            ids = np.insert(ids, bounds[1:], np.uint32(end_id))
            bounds = bounds + np.arange(len(bounds))
        return ids, bounds
