"""Exact counts of windows by packed numbers, in groups of chunks.

A window is one or more 64-bit numbers, made from a group's bases by shifts of whole arrays. Each group of chunks sends its
different k-mers once to the buckets of their hashes (ask), a bucket adds up what all groups have of a k-mer and answers each
group in the order it asked (total), and the group, cut again, gives its windows their answers (frequencies). So no window is a
row of a shuffle, a k-mer that fills the corpus is one entry of a group, and a group's answers are in the order of positions.
Groups and buckets have a bounded number of windows, whatever the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.place import bounded
from ..sources.stored import flat, texts_of

#: Windows of a group and of a bucket, at most and at least; of k-mers of more than one number accordingly fewer.
MOST, LEAST = 1 << 21, 1 << 17
#: Bases that are cut together where no group is needed.
PART = 1 << 20
#: Groups of a corpus that is large enough for them.
GROUPS = 64
#: Number of each base's byte; N is 4.
NUMBER = np.full(256, 4, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    NUMBER[_b] = _i
LETTERS = np.frombuffer(b"ACGTN", np.uint8)
ODD = np.uint64(0x9E3779B97F4A7C15)
FREQ = "file_id int, seq_id long, seq_len long, chunk_start long, freq binary"


def per_word(bits: int) -> int:
    """Bases in one number: of two bits, or of three where N is a base as well."""
    return 62 // bits


def spans(k: int, bits: int) -> list[tuple[int, int]]:
    """(offset, length) of the numbers of a k-mer."""
    per = per_word(bits)
    return [(o, min(per, k - o)) for o in range(0, k, per)]


def rolled(x: np.ndarray, length: int, bits: int, back: bool = False) -> np.ndarray:
    """For each place of x the number of the ``length`` digits from there; with ``back`` the first digit is the least."""
    if len(x) < length:
        return np.zeros(0, np.uint64)
    out, have, power, size = None, 0, x, 1
    while length:
        if length & 1:
            if out is None:
                out, have = power, size
            else:
                n = len(power) - have
                out = out[:n] | (power[have:] << np.uint64(bits * have)) if back else (out[:n] << np.uint64(bits * size)) | power[have:]
                have += size
        length >>= 1
        if length:
            n = len(power) - size
            power = power[:n] | (power[size:] << np.uint64(bits * size)) if back else (power[:n] << np.uint64(bits * size)) | power[size:]
            size *= 2
    return out


class Cut:
    """The windows of chunks: ``words`` (one array for each number of a k-mer) of those that count, ``chunk`` and ``offset`` of
    each, ``kept`` (their places among all windows), ``counts`` (all windows of each chunk), and ``twice``: windows that are
    their own reverse complement."""

    def __init__(self, bases: pa.Array | pa.ChunkedArray, k: int, span: int, both: bool = False, errors: int = 0, bits: int = 2):
        data, offsets = flat(bases)
        digits = NUMBER[data]
        self.counts = np.maximum(np.minimum(span, np.diff(offsets) - k + 1), 0)
        before = np.cumsum(self.counts) - self.counts
        at = np.repeat(offsets[:-1] - before, self.counts) + np.arange(self.counts.sum())
        unknown = np.concatenate(([0], np.cumsum(digits == 4, dtype=np.int32)))
        self.kept = np.flatnonzero(unknown[at + k] - unknown[at] <= errors)
        at = at[self.kept]
        self.chunk = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)[self.kept]
        x = digits.astype(np.uint64) if bits == 3 else np.where(digits == 4, 0, digits).astype(np.uint64)
        cache: dict[tuple[int, bool], np.ndarray] = {}

        def word(length: int, back: bool) -> np.ndarray:
            if (length, back) not in cache:
                cache[length, back] = rolled(np.uint64(3) - x if back else x, length, bits, back)
            return cache[length, back]

        self.words = [word(n, False)[at + o] for o, n in spans(k, bits)]
        self.twice = None
        if both:
            other = [word(n, True)[at + k - o - n] for o, n in spans(k, bits)]
            less, same = np.zeros(len(at), bool), np.ones(len(at), bool)
            for a, b in zip(self.words, other):
                less |= same & (b < a)
                same &= a == b
            self.words, self.twice = [np.where(less, b, a) for a, b in zip(self.words, other)], same


def hashed(words: list[np.ndarray]) -> np.ndarray:
    """64 bits of each k-mer; of those of one number no two have the same."""
    h = words[0] * ODD
    for w in words[1:]:
        h = ((h ^ (h >> np.uint64(29))) + w) * ODD
    return h


class Entries:
    """Different k-mers (by ``by``, if given, which must be grouped in ascending order) in the order of their hashes: ``first``,
    the place of one window of each; ``bounds`` of their windows in ``order``; ``inverse``, the entry of each window."""

    def __init__(self, words: list[np.ndarray], by: np.ndarray | None = None):
        h = hashed(words)
        n = len(h)
        self.order = np.argsort(h, kind=None if by is None else "stable")
        s = h[self.order]
        new = np.ones(n, bool)
        new[1:] = s[1:] != s[:-1]
        if len(words) > 1 and n > 1:
            differ = np.zeros(n - 1, bool)
            for w in words:
                w = w[self.order]
                differ |= w[1:] != w[:-1]
            if (differ & ~new[1:]).any():  # two k-mers with one hash
                self.order = np.lexsort(([] if by is None else [by]) + [*words[::-1], h])
                s = h[self.order]
                new[1:] = s[1:] != s[:-1]
                for w in words:
                    w = w[self.order]
                    new[1:] |= w[1:] != w[:-1]
        self.new_key = new
        if by is not None:
            b = by[self.order]
            new = new.copy()
            new[1:] |= b[1:] != b[:-1]
        self.new = new
        starts = np.flatnonzero(new)
        self.bounds = np.append(starts, n)
        self.first = self.order[starts]
        self.hash = s[starts]

    def inverse(self) -> np.ndarray:
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.new) - 1
        return out


def buckets_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Ascending with the hash."""
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of values, from each bound to the next, as bytes."""
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    return texts_of(np.ascontiguousarray(values).reshape(-1).view(np.uint8), bounds * width, pa.binary())


def values_of(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """(values, their number in each row)."""
    data, offsets = flat(column)
    return np.frombuffer(data.tobytes(), kind), np.diff(offsets) // np.dtype(kind).itemsize


def sorted_by(table: pa.Table, *names: str) -> pa.Table:
    return table.take(pa.array(np.lexsort([table.column(n).to_numpy() for n in names[::-1]])))


def parts_of(wins: int, words: int, most: int = MOST) -> int:
    size = max(1, min(most // words, max(LEAST, wins // GROUPS)))
    return max(1, -(-wins // size))


def grouping(parts: int) -> Column:
    return F.pmod(F.xxhash64("file_id", "seq_id", "chunk_start"), F.lit(parts)).cast("int").alias("g")


class Plan:
    """What all steps of one count know."""

    def __init__(self, k: int, span: int, parts: int, both: bool = False, by_file: bool = False, errors: int = 0):
        self.k, self.span, self.parts, self.both, self.by_file, self.errors = k, span, parts, both, by_file, errors
        self.bits = 3 if errors else 2
        self.palindromes = 2  # a palindrome is its own reverse complement and counts on both strands
        self.width = len(spans(k, self.bits))

    def entries(self, table: pa.Table) -> tuple[Cut, Entries, np.ndarray | None]:
        cut = Cut(table.column("bases"), self.k, self.span, self.both, self.errors, self.bits)
        files = table.column("file_id").to_numpy()[cut.chunk].astype(np.int32) if self.by_file else None
        return cut, Entries(cut.words, files), files

    def asked(self, table: pa.Table, g: int) -> pa.Table:
        """A group's k-mers for each bucket, with their numbers of windows."""
        cut, found, files = self.entries(table)
        counts = np.diff(found.bounds).astype(np.uint64)
        if self.both and not self.by_file:
            counts[cut.twice[found.first]] *= np.uint64(self.palindromes)
        bucket = buckets_of(found.hash, self.parts)
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        bounds = np.append(starts, len(bucket))
        keys = np.stack([w[found.first] for w in cut.words], axis=1) if len(found.first) else np.zeros((0, self.width), np.uint64)
        narrow = counts.astype(np.uint32) if not len(counts) or counts.max() < 1 << 32 else counts
        columns = {"p": pa.array(bucket[starts].astype(np.int32)), "g": pa.array(np.full(len(starts), g, np.int32)), "keys": binaries(keys, bounds), "counts": binaries(narrow, bounds), "wide": pa.array(np.full(len(starts), narrow.dtype == np.uint64))}
        columns["files"] = binaries(files[found.first], bounds) if self.by_file else pa.nulls(len(starts), pa.binary())
        return pa.table(columns)

    def met(self, table: pa.Table):
        """(sizes of the rows, words, counts, files, entries) of a bucket."""
        keys, sizes = values_of(table.column("keys"), np.uint64)
        sizes = sizes // self.width
        words = list(keys.reshape(-1, self.width).T.copy())
        files = values_of(table.column("files"), np.int32)[0] if self.by_file else None
        wide = table.column("wide").fill_null(False).to_numpy()
        if wide.any():
            column = table.column("counts")
            counts = np.concatenate([values_of(column.slice(i, 1), np.uint64 if w else np.uint32)[0].astype(np.int64) for i, w in enumerate(wide)])
        else:
            counts = values_of(table.column("counts"), np.uint32)[0].astype(np.int64)
        # what only asks counts for nothing
        counts[np.repeat(table.column("wide").is_null().to_numpy(), sizes)] = 0
        if self.by_file:
            order = np.argsort(files, kind="stable")
            back = np.empty_like(order)
            back[order] = np.arange(len(order))
            return sizes, [w[order] for w in words], counts[order], files[order], back, Entries([w[order] for w in words], files[order])
        return sizes, words, counts, None, None, Entries(words)

    def answered(self, table: pa.Table) -> pa.Table:
        """Each row's frequencies, in its order."""
        sizes, words, counts, files, back, found = self.met(table)
        if self.by_file:
            key = np.cumsum(found.new_key) - 1
            freq = np.bincount(key, weights=found.new).astype(np.uint64)
            out = np.empty(len(key), np.uint64)
            out[found.order] = freq[key]
            out = out[back]
        else:
            out = np.add.reduceat(counts[found.order], found.bounds[:-1]).astype(np.uint64)[found.inverse()]
        return pa.table({"g": table.column("g"), "p": table.column("p"), "freqs": binaries(out, np.concatenate(([0], np.cumsum(sizes))))})

    def merged(self, table: pa.Table) -> pa.Table:
        """A bucket's rows as one, of no group."""
        _, words, counts, _, _, found = self.met(table)
        out = np.add.reduceat(counts[found.order], found.bounds[:-1]).astype(np.uint64)
        bounds = np.array([0, len(out)])
        keys = np.stack([w[found.first] for w in words], axis=1)
        return pa.table({"p": table.column("p").slice(0, 1), "g": pa.array([-1], pa.int32()), "keys": binaries(keys, bounds), "counts": binaries(out, bounds), "wide": pa.array([True]), "files": pa.nulls(1, pa.binary())})

    def different(self, table: pa.Table, least_files: int = 0) -> pa.Table:
        """(kmer, file_id, cnt) of a bucket; with ``least_files`` those k-mers that so many files have, without the file."""
        sizes, words, counts, files, _, found = self.met(table)
        first, cnt = found.first, np.add.reduceat(counts[found.order], found.bounds[:-1])
        if least_files:
            keys = np.flatnonzero(found.new_key[found.bounds[:-1]])
            many = np.diff(np.append(keys, len(first))) >= least_files
            cnt, first = np.add.reduceat(cnt, keys)[many], first[keys][many]
        return pa.table({"kmer": self.letters([w[first] for w in words]), "file_id": pa.array(files[first] if self.by_file else np.zeros(len(first), np.int32)), "cnt": pa.array(cnt.astype(np.int64))})

    def letters(self, words: list[np.ndarray]) -> pa.Array:
        out = np.empty((len(words[0]), self.k), np.uint8)
        for w, (o, n) in zip(words, spans(self.k, self.bits)):
            for i in range(n):
                out[:, o + i] = LETTERS[((w >> np.uint64(self.bits * (n - 1 - i))) & np.uint64((1 << self.bits) - 1)).astype(np.int64)]
        return texts_of(out.reshape(-1), np.arange(len(out) + 1) * self.k)

    def given(self, chunks: pa.Table, answers: pa.Table) -> pa.Table:
        """The frequencies of all windows of each chunk of a group; 0 where a window has none."""
        if self.by_file:
            chunks = sorted_by(chunks, "file_id")
        cut, found, _ = self.entries(chunks)
        freqs, _ = values_of(sorted_by(answers, "p").column("freqs"), np.uint64)
        out = np.zeros(cut.counts.sum(), np.uint64)
        out[cut.kept] = freqs[found.inverse()]
        return chunks.select(["file_id", "seq_id", "seq_len", "chunk_start"]).append_column("freq", binaries(out, np.concatenate(([0], np.cumsum(cut.counts)))))


ASKED = "p int, g int, keys binary, counts binary, wide boolean, files binary"


def _ask(corpus, plan: Plan) -> DataFrame:
    bounded(corpus.chunks.sparkSession)
    order = ["file_id"] if plan.by_file else []
    chunks = corpus.reaching(plan.k).select("file_id", "seq_id", "seq_len", "chunk_start", "bases", grouping(plan.parts))
    return chunks.groupBy("g").applyInArrow(lambda key, t: plan.asked(sorted_by(t, *order) if order else t, key[0].as_py()), ASKED)


def frequencies(corpus, k: int, both: bool, by_file: bool, wins: int, most: int = MOST) -> DataFrame:
    """(file_id, seq_id, seq_len, chunk_start, freq): a row for each chunk, with the frequencies of the windows that start in
    it as 64-bit numbers, 0 for those with an N."""
    plan = Plan(k, corpus.span, parts_of(wins, len(spans(k, 2)), most), both, by_file)
    answers = _ask(corpus, plan).groupBy("p").applyInArrow(lambda t: plan.answered(t), "g int, p int, freqs binary")
    return _give(corpus, answers, plan)


def kmer_counts(corpus, k: int, wins: int, errors: int = 0, by_file: bool = False, both: bool = False, palindromes: int = 1, least_files: int = 0, most: int = MOST) -> DataFrame:
    """(kmer, file_id, cnt) of the different k-mers with at most ``errors`` Ns; file_id is 0 if not asked for. With ``both`` under
    the canonical one, where a palindrome counts ``palindromes`` times. ``least_files``: only those that so many files have, over all files."""
    plan = Plan(k, corpus.span, parts_of(wins, len(spans(k, 3 if errors else 2)), most), both, by_file or bool(least_files), errors)
    plan.palindromes = palindromes
    return _ask(corpus, plan).groupBy("p").applyInArrow(lambda t: plan.different(t, least_files), "kmer string, file_id int, cnt long")


def stored_counts(corpus, plan: Plan) -> DataFrame:
    """The counts of a corpus as its buckets have them (ASKED, of no group): what arriving chunks are asked against."""
    return _ask(corpus, plan).groupBy("p").applyInArrow(lambda t: plan.merged(t), ASKED)


def against(arrived, counts: DataFrame, plan: Plan) -> DataFrame:
    """(file_id, seq_id, seq_len, chunk_start, freq) of the chunks of another corpus: how often the one of ``counts`` has them."""
    asks = _ask(arrived, plan).withColumn("wide", F.lit(None).cast("boolean"))
    answers = counts.unionByName(asks).groupBy("p").applyInArrow(lambda t: plan.answered(t), "g int, p int, freqs binary").filter("g >= 0")
    return _give(arrived, answers, plan)


def _give(corpus, answers: DataFrame, plan: Plan) -> DataFrame:
    chunks = corpus.reaching(plan.k).select("file_id", "seq_id", "seq_len", "chunk_start", "bases", grouping(plan.parts))
    return chunks.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(lambda c, a: plan.given(c, a), FREQ)


def different_per_sequence(corpus, k: int, long: int = MOST) -> DataFrame:
    """(file_id, seq_id, n, different): windows and different k-mers of each sequence that has any, k-mers with Ns included.
    Found in stretches of ``long`` positions; the k-mers of a sequence of more are dealt by their numbers."""
    bounded(corpus.chunks.sparkSession)
    width, span = len(spans(k, 3)), corpus.span
    stretch = max(1, long // span) * span
    names = ["file_id", "seq_id", "start"]

    def slices(batches):
        """Whole stretches, of PART bases at most unless one has more."""
        for table in whole(batches, names):
            first = np.append(turns(table, names), table.num_rows)
            ends = np.cumsum(pc.binary_length(table.column("bases")).to_numpy())[first[1:] - 1]
            i = 0
            while i < len(ends):
                to = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PART, "right")))
                yield table.slice(first[i], first[to] - first[i])
                i = to

    def stretches(batches):
        for table in slices(batches):
            first = turns(table, names)
            which = np.repeat(np.arange(len(first)), np.diff(np.append(first, table.num_rows)))
            heads = table.select(["file_id", "seq_id"]).take(pa.array(first)).combine_chunks()
            cut = Cut(table.column("bases"), k, span, False, k, 3)
            by = which[cut.chunk]
            found = Entries(cut.words, by)
            short = table.column("seq_len").to_numpy()[first] <= stretch
            n, here = np.bincount(by, minlength=len(first)), by[found.first]
            some = np.flatnonzero(n > 0)
            counts = np.bincount(here[short[here]], minlength=len(first))
            none = {f"w{i}": pa.nulls(len(some), pa.int64()) for i in range(width)}
            yield from pa.table({"file_id": heads.column("file_id").take(pa.array(some)), "seq_id": heads.column("seq_id").take(pa.array(some)), "n": pa.array(n[some]), "different": pa.array(counts[some]), **none}).to_batches()
            far = np.flatnonzero(~short[here])
            if len(far):
                row = pa.array(here[far])
                zero = pa.array(np.zeros(len(far), np.int64))
                words = {f"w{i}": pa.array(w[found.first[far]].view(np.int64)) for i, w in enumerate(cut.words)}
                yield from pa.table({"file_id": heads.column("file_id").take(row), "seq_id": heads.column("seq_id").take(row), "n": zero, "different": zero, **words}).to_batches(max_chunksize=1 << 17)

    words = [f"w{i}" for i in range(width)]
    rows = corpus.reaching(k).select("file_id", "seq_id", "seq_len", (F.col("chunk_start") - F.col("chunk_start") % stretch).alias("start"), "chunk_start", "bases")
    dealt = rows.repartition("file_id", "seq_id", "start").sortWithinPartitions("file_id", "seq_id", "start", "chunk_start")
    found = dealt.mapInArrow(stretches, "file_id int, seq_id long, n long, different long, " + ", ".join(f"{w} long" for w in words))
    # a k-mer of a long sequence is counted once; all else has no numbers
    once = found.groupBy("file_id", "seq_id", *words).agg(F.sum("n").alias("n"), F.when(F.col("w0").isNull(), F.sum("different")).otherwise(1).alias("different"))
    return once.groupBy("file_id", "seq_id").agg(F.sum("n").alias("n"), F.sum("different").alias("different"))


def turns(table: pa.Table, names: list[str]) -> np.ndarray:
    """The rows where a new value of the columns begins."""
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for name in names:
        column = table.column(name).to_numpy()
        change[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(change)


def whole(batches, names: list[str]):
    """Tables in which all rows of a value of the columns are together; rows come sorted by them."""
    held, rows = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        first = turns(table, names)
        goes_on = rows is not None and all(table.column(n)[0] == v for n, v in zip(names, rows))
        if held and not goes_on:
            yield pa.concat_tables(held).combine_chunks()
            held = []
        last = int(first[-1])
        if last:
            yield pa.concat_tables([*held, table.slice(0, last)]).combine_chunks()
            held = []
        held.append(table.slice(last))
        rows = [table.column(n)[table.num_rows - 1] for n in names]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def exploded(freq: DataFrame, zeros: bool = False) -> DataFrame:
    """(file_id, seq_id, pos, freq) of the windows that have a hit, or of all."""
    bounded(freq.sparkSession)

    def rows(batches):
        for batch in batches:
            values, counts = values_of(pa.chunked_array([batch.column("freq")]), np.int64)
            row = np.repeat(np.arange(len(counts)), counts)
            offset = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
            hit = np.arange(len(values)) if zeros else np.flatnonzero(values)
            row = row[hit]
            pos = batch.column("chunk_start").to_numpy()[row] + offset[hit]
            for i in range(0, len(hit), 1 << 17):
                at = slice(i, i + (1 << 17))
                yield pa.RecordBatch.from_arrays([batch.column("file_id").take(pa.array(row[at])), batch.column("seq_id").take(pa.array(row[at])), pa.array(pos[at]), pa.array(values[hit][at])], ["file_id", "seq_id", "pos", "freq"])

    return freq.select("file_id", "seq_id", "chunk_start", "freq").mapInArrow(rows, "file_id int, seq_id long, pos long, freq long")


def dense_values(batch: pa.RecordBatch, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies of all own bases of the chunks, their number in each): 0 where no window starts."""
    values, counts = values_of(pa.chunked_array([batch.column("freq")]), np.int64)
    own = np.minimum(span, batch.column("seq_len").to_numpy() - batch.column("chunk_start").to_numpy())
    out = np.zeros(own.sum(), np.int64)
    begin = np.cumsum(own) - own
    out[np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(len(values))] = values
    return out, own


def runs_in_chunks(freq: DataFrame, span: int, most: int | None = None) -> DataFrame:
    """(file_id, seq_id, start, end, value, touches) of runs of equal non-zero frequencies (``most`` at most) within each chunk;
    ``touches``: it may go on in the chunk before or after."""
    bounded(freq.sparkSession)

    def runs(batches):
        for batch in batches:
            values, counts = values_of(pa.chunked_array([batch.column("freq")]), np.int64)
            if most is not None:
                values = np.minimum(values, most)
            row = np.repeat(np.arange(len(counts)), counts)
            before = np.cumsum(counts) - counts
            new = np.ones(len(values), bool)
            new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(values))
            some = values[first] != 0
            first, last = first[some], last[some]
            row = row[first]
            begin = batch.column("chunk_start").to_numpy()
            start, end = begin[row] + first - before[row], begin[row] + last - before[row]
            touches = ((start == begin[row]) & (start > 0)) | (end == begin[row] + span)
            for i in range(0, len(first), 1 << 17):
                at = slice(i, i + (1 << 17))
                which = pa.array(row[at])
                yield pa.RecordBatch.from_arrays([batch.column("file_id").take(which), batch.column("seq_id").take(which), pa.array(start[at]), pa.array(end[at]), pa.array(values[first[at]]), pa.array(touches[at])], ["file_id", "seq_id", "start", "end", "value", "touches"])

    return freq.select("file_id", "seq_id", "chunk_start", "freq").mapInArrow(runs, "file_id int, seq_id long, start long, end long, value long, touches boolean")


def dense_rows(freq: DataFrame, span: int) -> DataFrame:
    """(file_id, seq_id, pos, freq) of every base; 0 where no window starts, or none has a hit."""
    bounded(freq.sparkSession)

    def rows(batches):
        for batch in batches:
            values, own = dense_values(batch, span)
            row = np.repeat(np.arange(len(own)), own)
            pos = batch.column("chunk_start").to_numpy()[row] + np.arange(len(values)) - np.repeat(np.cumsum(own) - own, own)
            for i in range(0, len(values), 1 << 17):
                at = slice(i, i + (1 << 17))
                which = pa.array(row[at])
                yield pa.RecordBatch.from_arrays([batch.column("file_id").take(which), batch.column("seq_id").take(which), pa.array(pos[at]), pa.array(values[at])], ["file_id", "seq_id", "pos", "freq"])

    return freq.mapInArrow(rows, "file_id int, seq_id long, pos long, freq long")
