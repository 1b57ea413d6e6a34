"""Counts of windows within E mismatches, by seeds that stay in their text.

A window is cut into E + 1 blocks, of which two windows within E mismatches share one at least. A block is a place of the text
whichever window it belongs to, so each place without an N is sent once, with as many bases around it as its windows need;
neighbours that go to one bucket go as one piece of text. The bucket is that of the least hash of the block's short substrings,
the same on both strands. A bucket cuts the windows of its places, counts equal ones once, meets those of equal blocks, verifies
them by xor and popcount, and answers each place with what its windows have found; a pair counts at its first equal block
only. Groups and buckets are those of packed.py; pairs are made in slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.alphabet import EVEN_BITS
from ..sources.place import bounded
from ..sources.stored import flat
from .packed import FREQ, NUMBER, ODD, Entries, binaries, buckets_of, grouping, rolled, sorted_by, spans, values_of

#: Bases of the substrings whose least hash says where a block goes, and of the shortest block that is worth it.
SHORT, LEAST_BLOCK = 10, 14
#: Windows of a group, places of a bucket (and of a part of it, as buckets may have more), pairs of a slice.
GROUP, BUCKET, PART, SLICE = 1 << 20, 1 << 17, 1 << 18, 1 << 20
#: Three bases of five kinds are a byte.
UNPACKED = np.array([(v // 25, v // 5 % 5, v % 5) for v in range(125)] + [(4, 4, 4)] * 131, np.uint8)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * ODD
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def filled(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Text:
    """Digits with what windows of them are as numbers: value and mask (N) words, on either strand."""

    def __init__(self, digits: np.ndarray):
        self.unknown = digits == 4
        self.x = np.where(self.unknown, 0, digits).astype(np.uint64)
        self.cache: dict[tuple[str, int, bool], np.ndarray] = {}

    def numbers(self, what: str, length: int, back: bool) -> np.ndarray:
        key = what, length, back
        if key not in self.cache:
            x = self.unknown.astype(np.uint64) if what == "mask" else np.uint64(3) - self.x if back else self.x
            self.cache[key] = rolled(x, length, 2, back)
        return self.cache[key]

    def words(self, what: str, at: np.ndarray, k: int, back: bool = False) -> list[np.ndarray]:
        return [self.numbers(what, n, back)[at + (k - o - n if back else o)] for o, n in spans(k, 2)]


class Near:
    def __init__(self, k: int, errors: int, both: bool, span: int, groups: int, parts: int):
        self.k, self.errors, self.both, self.span, self.groups, self.parts = k, errors, both, span, groups, parts
        size = k // (errors + 1)
        self.block, self.offsets = min(31, size), [j * size for j in range(errors + 1)]
        self.blocks = [[self._bits(o, n, at) for o, n in spans(k, 2)] for at in self.offsets]

    def _bits(self, o: int, n: int, at: int) -> np.uint64:
        """The bits of the word of bases o to o + n that are those of the block at ``at``."""
        return np.uint64(sum(1 << 2 * (n - 1 - (t - o)) for t in range(max(o, at), min(o + n, at + self.block))))

    def pieces(self, table: pa.Table) -> tuple:
        """Pieces of the chunks' text by bucket: (digits, offsets and windows of chunks, first place, places, begin, end, bucket)."""
        data, offsets = flat(table.column("bases"))
        digits, k, b = NUMBER[data], self.k, self.block
        windows = np.maximum(np.minimum(self.span, np.diff(offsets) - k + 1), 0)
        length = np.where(windows > 0, windows - 1 + k, 0)
        places = np.where(windows > 0, length - b + 1, 0)
        at, chunk = filled(offsets[:-1], places), np.repeat(np.arange(len(places)), places)
        unknown = np.concatenate(([0], np.cumsum(digits == 4, dtype=np.int32)))
        whole = unknown[at + b] == unknown[at]
        at, chunk = at[whole], chunk[whole]
        text, m = Text(digits), min(SHORT, b)
        least = mixed(np.minimum(text.numbers("value", m, False), text.numbers("value", m, True)))
        width, size = b - m + 1, 1
        while size * 2 <= width:
            least = np.minimum(least[: len(least) - size], least[size:])
            size *= 2
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        bucket = buckets_of(mixed(least[at]), self.parts)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (chunk[1:] != chunk[:-1]) | (bucket[1:] != bucket[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
        order = np.argsort(bucket[first], kind="stable")
        first, count = first[order], count[order]
        place, chunk, bucket = at[first], chunk[first], bucket[first]
        begin = np.maximum(offsets[:-1][chunk], place - (k - b))
        end = np.minimum(offsets[:-1][chunk] + length[chunk], place + count - 1 + k)
        return digits, offsets, windows, place, count, begin, end, bucket

    def asked(self, table: pa.Table, g: int) -> pa.Table:
        digits, _, _, place, count, begin, end, bucket = self.pieces(table)
        size = -(-(end - begin) // 3) * 3
        from_ = filled(begin, size)
        inside = from_ < np.repeat(end, size)
        text = np.where(inside, digits[np.minimum(from_, len(digits) - 1)], 4).reshape(-1, 3) if len(from_) else np.zeros((0, 3), np.uint8)
        packed = (text[:, 0] * 25 + text[:, 1] * 5 + text[:, 2]).astype(np.uint8)
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        bounds = np.append(starts, len(bucket))
        heads = np.stack([place - begin, count, end - begin], axis=1).astype(np.int32)
        return pa.table({"p": pa.array(bucket[starts].astype(np.int32)), "g": pa.array(np.full(len(starts), g, np.int32)), "heads": binaries(heads, bounds), "text": binaries(packed, np.concatenate(([0], np.cumsum(size // 3)))[bounds])})

    def answered(self, table: pa.Table) -> pa.Table:
        heads, rows = values_of(table.column("heads"), np.int32)
        left, count, length = heads.reshape(-1, 3).T.astype(np.int64)
        text = Text(UNPACKED[values_of(table.column("text"), np.uint8)[0]].reshape(-1))
        size = -(-length // 3) * 3
        begin = np.cumsum(size) - size
        at = filled(begin + left, count)
        low, high = np.repeat(begin, count), np.repeat(begin + length, count)
        seed, other = text.numbers("value", self.block, False)[at], text.numbers("value", self.block, True)[at]
        out = np.zeros((len(at), self.errors + 1), np.uint64)
        parts = -(-len(at) // PART)
        part = buckets_of(mixed(np.minimum(seed, other)), parts) if parts > 1 else np.zeros(len(at), np.int64)
        unknown = np.concatenate(([0], np.cumsum(text.unknown, dtype=np.int32)))
        for i in range(parts):
            mine = np.flatnonzero(part == i)
            if len(mine):
                self.meet(text, unknown, at[mine], low[mine], high[mine], seed[mine], other[mine], mine, out)
        places = np.concatenate(([0], np.cumsum(count)))[np.concatenate(([0], np.cumsum(rows // 3)))]
        return pa.table({"g": table.column("g"), "p": table.column("p"), "found": binaries(out, places)})

    def meet(self, text: Text, unknown, at, low, high, seed, other, mine, out) -> None:
        """Adds to ``out`` what the windows of places find among those of the same places."""
        k, cache = self.k, {}

        def windows(offset: int):
            """Of the windows that have a place at ``offset``: (places, entries, first place of each, windows of each)."""
            if offset not in cache:
                start = at - offset
                fits = np.flatnonzero((start >= low) & (start + k <= high))
                fits = fits[unknown[start[fits] + k] - unknown[start[fits]] <= self.errors]
                found = Entries([*text.words("value", start[fits], k), *text.words("mask", start[fits], k)])
                cache[offset] = fits, found, fits[found.first], np.diff(found.bounds)
            return cache[offset]

        for j, offset in enumerate(self.offsets):
            fits, found, first, cnt = windows(offset)
            if not len(fits):
                continue
            ask = np.argsort(seed[first])
            start = at[first] - offset
            asks = [x[ask] for x in (*text.words("value", start, k), *text.words("mask", start, k))]
            hits, seeds, weights = [text.words("value", start, k) + text.words("mask", start, k)], [seed[first]], [cnt]
            if self.both:
                mirrored = k - self.block - offset
                _, _, first, cnt = windows(mirrored)
                start = at[first] - mirrored
                hits.append(text.words("value", start, k, True) + text.words("mask", start, k, True))
                seeds.append(other[first])
                weights.append(cnt)
            seeds, weights = np.concatenate(seeds), np.concatenate(weights)
            order = np.argsort(seeds)
            seeds, weights = seeds[order], weights[order].astype(np.float64)
            hits = [np.concatenate(x)[order] for x in zip(*hits)]
            wanted = seed[fits[found.first]][ask]
            begin = np.searchsorted(seeds, wanted, "left")
            many = np.searchsorted(seeds, wanted, "right") - begin
            freq, ends = np.zeros(len(ask)), np.cumsum(many)
            i = 0
            while i < len(ask):
                to = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE, "right")))
                a, b = np.repeat(np.arange(i, to), many[i:to]), filled(begin[i:to], many[i:to])
                a, b = self.verified(asks, hits, a, b, j)
                freq[i:to] += np.bincount(a - i, weights=weights[b], minlength=to - i)
                i = to
            of = np.empty(len(ask), np.uint64)
            of[ask] = freq.astype(np.uint64)
            out[mine[fits], j] = of[found.inverse()]

    def verified(self, asks, hits, a: np.ndarray, b: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs within the errors that have no equal block before the j-th."""
        width, even = len(asks) // 2, np.uint64(EVEN_BITS)
        total, differ = np.zeros(len(a), np.uint8), []
        for w in range(width):
            x = asks[w][a] ^ hits[w][b]
            d = ((x | (x >> np.uint64(1))) & even) | asks[width + w][a] | hits[width + w][b]
            total = total + np.bitwise_count(d)
            differ.append(d)
            near = total <= self.errors
            if not near.all():
                a, b, total, differ = a[near], b[near], total[near], [y[near] for y in differ]
        for bits in self.blocks[:j]:
            odd = np.zeros(len(a), bool)
            for d, m in zip(differ, bits):
                if m:
                    odd |= (d & m) != 0
            if not odd.all():
                a, b, differ = a[odd], b[odd], [y[odd] for y in differ]
        return a, b

    def given(self, chunks: pa.Table, answers: pa.Table) -> pa.Table:
        digits, offsets, windows, place, count, *_ = self.pieces(chunks)
        found = values_of(sorted_by(answers, "p").column("found"), np.uint64)[0].reshape(-1, self.errors + 1)
        at, total = filled(place, count), np.zeros(len(digits), np.uint64)
        for j, offset in enumerate(self.offsets):
            some = np.flatnonzero(found[:, j])
            total[at[some] - offset] += found[some, j]
        out = total[filled(offsets[:-1], windows)]
        return chunks.select(["file_id", "seq_id", "seq_len", "chunk_start"]).append_column("freq", binaries(out, np.concatenate(([0], np.cumsum(windows)))))


def fits(k: int, errors: int) -> bool:
    """Whether blocks are long enough to part the windows of a large corpus."""
    return errors > 0 and k // (errors + 1) >= LEAST_BLOCK


def near_frequencies(corpus, k: int, errors: int, both: bool, wins: int, group: int = GROUP, bucket: int = BUCKET) -> DataFrame:
    """(file_id, seq_id, seq_len, chunk_start, freq): as packed.frequencies, with up to ``errors`` mismatches."""
    bounded(corpus.chunks.sparkSession)
    near = Near(k, errors, both, corpus.span, max(1, -(-wins // group)), max(1, -(-wins // bucket)))

    def chunks():
        return corpus.reaching(k).select("file_id", "seq_id", "seq_len", "chunk_start", "bases", grouping(near.groups)).groupBy("g")

    asks = chunks().applyInArrow(lambda key, t: near.asked(t, key[0].as_py()), "p int, g int, heads binary, text binary")
    answers = asks.groupBy("p").applyInArrow(lambda t: near.answered(t), "g int, p int, found binary")
    return chunks().cogroup(answers.groupBy("g")).applyInArrow(lambda c, a: near.given(c, a), FREQ)
