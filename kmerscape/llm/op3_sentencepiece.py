"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A slice's distinct words are one flat array of symbols. In a round each word finds its best pair (lowest rank of the
merged piece, leftmost of equals), all such pairs that don't overlap merge at once in all words, and the array is
compacted; words without a pair leave. Where a merge makes a better pair than the one merged, only the word's leftmost
merge counts in that round, as the library's queue would do. Words end before a run of spaces, over which no piece
reaches (checked when the model is loaded). Characters without a piece become bytes.

The library reads the model file and names its pieces; encoding and decoding are done here, with tables.

Defined cases: null counts as empty and has the end id alone; very long words take many rounds but stay exact; equal rows
give equal rows; an empty table gives none. Decoding bytes that aren't UTF-8 gives U+FFFD, as bytes.decode does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .flat import array_of, binary_array, flat, sha256_each, slices, spread, starts_of, tidied
from .interned import Interned
from .shared import bounded

SPACE = "▁"
NONE = np.int32(0x7FFFFFFF)
_LOADED: dict[str, PieceModel] = {}


def load(path: str) -> PieceModel:
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.end = sp.eos_id()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        normal = {p: i for i, p in enumerate(pieces) if not special[i]}
        if sp.normalize(" a  éﬁ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}éﬁ" or any(sp.is_unused(i) for i in range(n)):
            raise ValueError("models without normalisation, with a dummy prefix and without unused pieces are supported")
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece reaches over the end of a word")
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        # ranks: order of scores, so equal scores have equal ranks
        scores = np.array([sp.get_score(i) for i in range(n)], np.float32)
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[32] = self.char[ord(SPACE)]
        self.n = n
        pairs = {normal[p[:k]] * n + normal[p[k:]]: i for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal}
        self._table(np.array(list(pairs), np.uint64), np.array(list(pairs.values()), np.int32))
        # a symbol without a piece is n + code point; it has no pairs
        text = [b"" if sp.is_control(i) else b"\xe2\x81\x87" if sp.is_unknown(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.text, self.text_at = np.frombuffer(b"".join(text), np.uint8), starts_of(np.array([len(t) for t in text]))
        digits = [b"%d " % i for i in range(n)]
        self.digits, self.digits_at = np.frombuffer(b"".join(digits), np.uint8), starts_of(np.array([len(d) for d in digits]))
        self.known = Interned()

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open hash table in arrays; a quarter full, so that most look-ups take one step."""
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF)), np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):
            free = self.keys[at[left]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            slot, first = np.unique(at[left][free], return_index=True)
            put = left[free][first]
            self.keys[slot], self.values[slot] = keys[put], values[put]
            left = np.setdiff1d(left, put)
            at[left] = (at[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1."""
        keys = left.astype(np.uint64) * np.uint64(self.n) + right.astype(np.uint64)
        keys[(left >= self.n) | (right >= self.n)] = np.uint64(0xFFFFFFFFFFFFFFFE)
        out = np.full(len(keys), -1, np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            go = ~hit & (found != np.uint64(0xFFFFFFFFFFFFFFFF))
            todo, at = todo[go], (at[go] + 1) & (len(self.keys) - 1)
        return out

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, lengths) of all words after all merges."""
        done = np.zeros(len(symbols), np.int64)
        counts = lengths.copy()
        homes = starts_of(lengths)[:-1]
        words = np.flatnonzero(lengths > 0)
        cur, size = symbols[spread(homes[words], lengths[words])].astype(np.int64), lengths[words]
        pair = self._pairs(cur, size)
        while len(words):
            starts = starts_of(size)
            rank = np.where(pair >= 0, self.rank[pair], NONE)
            best = np.minimum.reduceat(rank, starts[:-1])
            stop = best == NONE
            if stop.any():
                own = np.repeat(stop, size)
                counts[words[stop]] = size[stop]
                done[spread(homes[words[stop]], size[stop])] = cur[own]
                cur, pair, rank = cur[~own], pair[~own], rank[~own]
                words, size, best = words[~stop], size[~stop], best[~stop]
                if not len(words):
                    break
                starts = starts_of(size)
            word = np.repeat(np.arange(len(words)), size)
            at = np.flatnonzero(rank == best[word])
            # of adjacent candidates every second merges, counted from the first of their run
            fresh = np.ones(len(at), bool)
            fresh[1:] = (at[1:] != at[:-1] + 1) | (word[at[1:]] != word[at[:-1]])
            run = np.cumsum(fresh) - 1
            at = at[((np.arange(len(at)) - np.flatnonzero(fresh)[run]) & 1) == 0]
            new_cur, new_size, new_pair = self._merge_at(cur, pair, size, word, at)
            if len(at) > len(words):
                # a pair as good as the merged one: the queue would have taken it first, so merge just the leftmost.
                # It may exist now, or after a merge and before the next one to its right
                new_rank = np.where(new_pair >= 0, self.rank[new_pair], NONE)
                worse = np.minimum.reduceat(new_rank, starts_of(new_size)[:-1]) <= best
                close = at[:-1][(at[1:] == at[:-1] + 2) & (word[at[1:]] == word[at[:-1]])]
                between = self.merged(pair[close].astype(np.int64), cur[close + 2])
                worse[word[close[np.where(between >= 0, self.rank[between], NONE) <= best[word[close]]]]] = True
                if worse.any():
                    lead = np.ones(len(at), bool)
                    lead[1:] = word[at[1:]] != word[at[:-1]]
                    new_cur, new_size, new_pair = self._merge_at(cur, pair, size, word, at[lead | ~worse[word[at]]])
            cur, size, pair = new_cur, new_size, new_pair
        return done[spread(homes, counts)], counts

    def _pairs(self, cur: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each symbol the piece that it makes with the next one of its word, or -1."""
        out = np.full(len(cur), -1, np.int32)
        inner = np.ones(len(cur), bool)
        inner[np.cumsum(size) - 1] = False
        i = np.flatnonzero(inner)
        out[i] = self.merged(cur[i], cur[i + 1])
        return out

    def _merge_at(self, cur, pair, size, word, at):
        new = cur.copy()
        new[at] = pair[at]
        keep = np.ones(len(cur), bool)
        keep[at + 1] = False
        size = size - np.bincount(word[at], minlength=len(size))
        pair, changed = pair.copy(), np.zeros(len(cur), bool)
        changed[at] = True
        new, pair, changed = new[keep], pair[keep], changed[keep]
        changed[:-1] |= changed[1:]
        last = np.cumsum(size) - 1
        pair[last] = -1
        changed[last] = False
        i = np.flatnonzero(changed)
        pair[i] = self.merged(new[i], new[i + 1])
        return new, size, pair

    def fresh(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of distinct words of UTF-8 bytes."""
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.diff(np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets])
        symbols = self.char[points].astype(np.int64)
        symbols = np.where(symbols < 0, self.n + points, symbols)
        symbols, lengths = self.merge(symbols, lengths)
        lost = symbols >= self.n
        if lost.any():
            raw = [chr(p).encode() for p in (symbols[lost] - self.n).tolist()]
            wide = np.ones(len(symbols), np.int64)
            wide[lost] = [len(r) for r in raw]
            out = np.repeat(symbols, wide)
            out[np.repeat(lost, wide)] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            lengths = np.diff(np.concatenate([[0], np.cumsum(wide)])[starts_of(lengths)])
            symbols = out
        return symbols.astype(np.uint32), starts_of(lengths)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids with an end id after each text, offset of each text)."""
        data, offsets = flat(texts)
        filled = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][filled], np.uint8(32))
        offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
        if len(data):
            space = data == 32
            mark = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
            first = space.copy()
            first[mark] = True  # a literal mark counts as a space
            last = space
            last[mark + 2] = True
            cut = first
            cut[1:] &= ~last[:-1]
            cut[offsets[:-1][filled]] = True
            starts = np.flatnonzero(cut)
            ids, counts = self.known.encode(data, starts, self.fresh)
            bounds = starts_of(counts)[np.searchsorted(starts, offsets)]
        else:
            ids, bounds = np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        return np.insert(ids, bounds[1:], np.uint32(self.end)), bounds + np.arange(len(bounds))

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes, offset of each text): pieces one after the other, without the space of the dummy prefix."""
        sizes = np.diff(self.text_at)[ids]
        data = self.text[spread(self.text_at[ids], sizes)]
        at = starts_of(sizes)[bounds]
        some = np.flatnonzero(np.diff(at) > 0)
        lead = at[:-1][some]
        drop = lead[data[lead] == 32]
        lost = np.zeros(len(at) - 1, np.int64)
        lost[some[data[lead] == 32]] = 1
        data, at = np.delete(data, drop), at - np.concatenate([[0], np.cumsum(lost)])
        try:
            data.tobytes().decode()
        except UnicodeDecodeError:
            raw = data.tobytes()
            fixed = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(at.tolist(), at[1:].tolist())]
            data, at = np.frombuffer(b"".join(fixed), np.uint8), starts_of(np.array([len(f) for f in fixed], np.int64))
        return data, at


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(df: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("ids", "decoded", "ids_sha256", "decoded_sha256")) -> DataFrame:
    """doc_id, n_tokens, and of ``outputs``: ids (array), decoded text, and their sha256 digests."""
    path = path or model_path()
    kinds = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}

    def run(batches):
        model = load(path)
        for part in slices(batches):
            ids, bounds = model.encode(array_of(part, "text"))
            made = {}
            if {"decoded", "decoded_sha256"} & set(outputs):
                data, at = model.decode(ids, bounds)
                made["decoded"] = binary_array(data, at, pa.large_string()).cast(pa.string()) if "decoded" in outputs else None
                made["decoded_sha256"] = pa.array(sha256_each(data, at)) if "decoded_sha256" in outputs else None
            if "ids_sha256" in outputs:
                sizes = np.diff(model.digits_at)[ids]
                line, ends = model.digits[spread(model.digits_at[ids], sizes)], starts_of(sizes)[bounds]
                cut = np.delete(line, ends[1:] - 1)
                made["ids_sha256"] = pa.array(sha256_each(cut, ends - np.arange(len(ends))))
            if "ids" in outputs:
                made["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.uint32()).cast(pa.int32()))
            yield pa.RecordBatch.from_arrays([array_of(part, "doc_id"), pa.array(np.diff(bounds)), *[made[o] for o in outputs]], ["doc_id", "n_tokens", *outputs])

    schema = ", ".join(["doc_id long, n_tokens long", *[f"{o} {kinds[o]}" for o in outputs]])
    bounded(df.sparkSession)
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidied(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), outputs=("ids_sha256", "decoded_sha256"))
