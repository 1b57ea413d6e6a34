"""Repeated windows of a corpus: candidates by anchors, so that only text that may repeat is indexed or sorted.

A window is ``window`` consecutive tokens (words or bytes) of one document. Its anchor is the least-hashed of its
``gram``-token substrings, the leftmost of equals; equal windows have equal anchors at equal places. Consecutive windows
with the same anchor form a run of at most window - gram + 1 windows.

1. Anchors are counted over the whole corpus (hashes only; pre-aggregated). Those that occur once are done with.
2. The texts are read again, and runs whose anchor repeats are written: a slim row for the equal ones of a text (a periodic
   text has many), and their segments (the bytes that the windows cover), of which a task collapses equal ones to a row with
   a count and the first place. A Bloom filter of the repeated anchors tells which they are, as long as it fits into
   ``max_bits`` to broadcast (it may pass an anchor too many, which changes no result). Beyond that the anchors' places are
   joined with the repeated anchors, and each document gets the list of its own. Where an anchor has more than ``HOT`` runs
   (a frequent passage, perhaps in ever new context), each window is a run of its own, and is dealt by its own hash.
3. Segments are dealt by anchor, which keeps equal windows together. The operator's kernel decides which windows of a
   segment repeat, one bit per window; it compares words or bytes, never hashes alone.
4. A join brings the bits back to the runs; documents without any (a Bloom filter of the others tells, while it fits) pass
   straight through, and a join on document and text hash brings the marks to the rest.

A segment is known by its anchor's hash and the xxh3 hash of its bytes, 128 bits in all.

Tables that are no longer read are removed, and shuffles that nothing holds any more are released, as the steps go.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .flat import BYTE_VALUES, Rolling, array_of, binary_array, flat, mix, range_hashes, slices, spread, starts_of, tidied, word_hashes, words
from .shared import bounded, drop, free, hash_partitions, written

#: Runs of one anchor beyond which they are dealt by window.
HOT = 20_000
#: Bytes of segments that a task holds before it writes them.
HELD = 8 << 20
#: Bytes of text whose anchors are found at a time.
SLICE = 1 << 19
NULL_ID = -(1 << 63)
#: Bytes of an anchor that the range partitioner sees.
LEAD = 16
#: Places of equal runs of one text in a row; their steps take 256 KB.
PLACES = 1 << 16


class Kind(NamedTuple):
    """What a token is: tokens(data, offsets) gives mixed values, the offset of each document in tokens, and span, which
    gives (first byte, number of bytes) of ranges (first token, number of tokens)."""

    tokens: Callable


def _word_tokens(data, offsets):
    first, end, bounds = words(data, offsets)

    def span(start, size):
        some = size > 0
        begin = first[np.where(some, start, 0)] if len(first) else start
        return begin, np.where(some, end[np.where(some, start + size - 1, 0)] - begin, 0) if len(first) else size

    return word_hashes(data, first, end), bounds, span


def _byte_tokens(data, offsets):
    return BYTE_VALUES[data], offsets, lambda start, size: (start, size)


WORDS, BYTES = Kind(_word_tokens), Kind(_byte_tokens)


def runs(roll: Rolling, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor's place, anchor's hash) of each run of windows with one anchor."""
    hashes = roll.all(gram)
    wide = window - gram + 1
    if len(hashes) < wide:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while 2 * size <= wide:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if wide > size:
        least = np.minimum(least[: len(least) - (wide - size)], least[wide - size :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # windows that end within their document
    step = np.zeros(len(place) + 1, np.int32)
    first, last = bounds[:-1], bounds[1:] - window + 1
    some = last > first
    np.add.at(step, first[some], 1)
    np.add.at(step, last[some], -1)
    valid = np.cumsum(step[:-1]) > 0
    begins = valid.copy()
    begins[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    start = np.flatnonzero(begins)
    ends = valid.copy()
    ends[:-1] &= (place[1:] != place[:-1]) | ~valid[1:]
    return start, np.flatnonzero(ends) + 1 - start, place[start], hashes[place[start]]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def merged(h, sid, doc, a, copies) -> tuple[np.ndarray, np.ndarray]:
    """(row of the first place of each distinct (h, sid), in the order of the rows; its copies)."""
    order = np.lexsort((a, doc, sid, h))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (sid[order][1:] != sid[order][:-1])
    starts = np.flatnonzero(fresh)
    first = order[starts]
    total = np.add.reduceat(copies[order], starts) if len(starts) else copies[:0]
    again = np.argsort(first)
    return first[again], total[again]


def by_text(doc, h, sid, a) -> tuple[np.ndarray, pa.Array]:
    """(row of the first place of each distinct (doc, h, sid); the steps from there to its further places, four bytes each,
    null where there is none). A row holds PLACES places at most."""
    order = np.lexsort((a, sid, h, doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (doc[order][1:] != doc[order][:-1]) | (h[order][1:] != h[order][:-1]) | (sid[order][1:] != sid[order][:-1])
    starts = np.flatnonzero(fresh)
    fresh |= (np.arange(len(order)) - starts[np.cumsum(fresh) - 1]) % PLACES == 0
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, len(order)))
    steps = np.diff(a[order], prepend=0)[~fresh].astype("<u4").view(np.uint8)
    some = pc.if_else(pa.array(sizes > 1), binary_array(steps, starts_of(4 * (sizes - 1))), None).cast(pa.binary())
    # in the order of the rows, whose places are small when they are packed
    back = np.argsort(order[starts])
    return order[starts][back], some.take(pa.array(back))


def places(a: np.ndarray, steps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the further places that by_text() tells."""
    data, offsets = flat(steps)
    n, by = np.diff(offsets) // 4, np.frombuffer(data.tobytes(), "<u4").astype(np.int64)
    total, row = starts_of(by), np.repeat(np.arange(len(n)), n)
    return row, a[row] + total[1:] - total[offsets[:-1] // 4][row]


class _Segments:
    """Segments that a task holds: columns h, sid, doc, a, copies, n, route, p (place of the anchor's bytes), content."""

    schema = pa.schema([("kind", pa.int8()), ("h", pa.int64()), ("sid", pa.int64()), ("doc_id", pa.int64()), ("tkey", pa.int64()), ("a", pa.int64()), ("n", pa.int32()), ("copies", pa.int64()), ("route", pa.int64()), ("p", pa.int32()), ("content", pa.binary())])

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, columns: list[np.ndarray], data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
        row, copies = merged(*columns[:4], np.ones(len(columns[0]), np.int64))
        content = data[spread(begin[row], length[row])]
        self.parts.append(([c[row] for c in columns], copies, content, length[row]))
        self.size += len(content)

    def batches(self):
        if not self.parts:
            return
        columns = [np.concatenate(c) for c in zip(*[p[0] for p in self.parts])]
        content, length = np.concatenate([p[2] for p in self.parts]), np.concatenate([p[3] for p in self.parts])
        row, copies = merged(*columns[:4], np.concatenate([p[1] for p in self.parts]))
        at = starts_of(length)[:-1]
        self.parts, self.size = [], 0
        for some in np.array_split(np.arange(len(row)), max(1, len(row) >> 14)):
            h, sid, doc, a, n, route, p = (c[row[some]] for c in columns)
            own = length[row[some]]
            raw = binary_array(content[spread(at[row[some]], own)], starts_of(own)).cast(pa.binary())
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(some), np.int8)), signed(h), signed(sid), pa.array(doc), none, pa.array(a), pa.array(n.astype(np.int32)), pa.array(copies[some]), pa.array(route.view(np.int64), mask=route == h), pa.array(p.astype(np.int32)), raw], schema=self.schema)


def segments(docs: DataFrame, kind: Kind, window: int, gram: int, max_bits: int, hot: int = HOT) -> DataFrame:
    """A written table of two kinds of rows. 0: the runs whose anchor repeats, equal ones of a text as one: h (anchor), sid
    (hash of the content), doc_id, tkey, a (first window), n, and as content the steps to the further places (see by_text).
    1: their segments, collapsed by task: h, sid, doc_id and a of the first place, n, copies, route (null: h), p (the anchor's
    place in content), content. doc_id is NULL_ID for null."""
    if not 1 <= window - gram + 1 <= 63:
        raise ValueError("a run must have 1 to 63 windows")
    spark = bounded(docs.sparkSession)

    def count(batches):
        for part in slices(batches, limit=SLICE):
            values, bounds, _ = kind.tokens(*flat(part.column(0)))
            _, _, _, h = runs(Rolling(values, 0x8CB92BA72F3D8DD7), bounds, window, gram)
            h, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([signed(h), pa.array(n.astype(np.int32))], ["h", "n"])

    repeated = written(docs.select("text").mapInArrow(tidied(count), "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1"), "anchors")
    few = bloom.fits(repeated.count(), max_bits)
    if few:
        filters = []
        for least in (1, hot):
            some = repeated.filter(F.col("n") > least)
            rows = some.count()
            filters.append(bloom.build(some.select("h"), rows) if rows else None)
        shared = spark.sparkContext.broadcast(filters)
        drop(repeated)
        asked = docs.select("doc_id", "tkey", "text")
    else:
        asked = _with_known(docs, kind, window, gram, repeated, hot)

    def known_of(part, doc, h):
        """(whether each anchor repeats, whether it is hot)."""
        if few:
            known, hot_ones = shared.value
            none = np.zeros(len(h), bool)
            return (bloom.contains(x, h) if x is not None else none for x in (known, hot_ones))
        lists = array_of(part, "known")
        at, own = np.diff(lists.offsets.to_numpy()), lists.flatten()
        key = own.field("h").to_numpy().view(np.uint64) ^ mix(np.repeat(np.arange(len(at)), at).astype(np.uint64))
        asks = h ^ mix(doc.astype(np.uint64))
        return np.isin(asks, key), np.isin(asks, key[own.field("hot").to_numpy(zero_copy_only=False)])

    def extract(batches):
        held = _Segments()
        for part in slices(batches, "text", limit=SLICE):
            data, offsets = flat(array_of(part, "text"))
            values, bounds, span = kind.tokens(data, offsets)
            roll = Rolling(values, 0x8CB92BA72F3D8DD7)
            start, n, place, h = runs(roll, bounds, window, gram)
            some, apart = known_of(part, np.searchsorted(bounds, start, side="right") - 1, h)
            start, n, place, h, apart = start[some], n[some], place[some], h[some], apart[some]
            if apart.any():
                each = np.where(apart, n, 1)
                row = np.repeat(np.arange(len(h)), each)
                off = spread(np.zeros(len(h), np.int64), each)
                start, n, place, h, apart = start[row] + off, np.where(apart[row], 1, n[row]), place[row], h[row], apart[row]
            size = n + window - 1
            begin, length = span(start, size)
            sid = range_hashes(data, begin, begin + length)
            doc = np.searchsorted(bounds, start, side="right") - 1
            ids, a = array_of(part, "doc_id").to_numpy()[doc], start - bounds[doc]
            row, steps = by_text(doc, h, sid, a)
            zeros = pa.nulls(len(row), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(row), np.int8)), signed(h[row]), signed(sid[row]), pa.array(ids[row]), pa.array(array_of(part, "tkey").to_numpy()[doc[row]]), pa.array(a[row]), pa.array(n[row].astype(np.int32)), zeros, zeros, pa.nulls(len(row), pa.int32()), steps],
                schema=held.schema,
            )
            anchor, _ = span(place, np.full(len(h), gram))
            # by tokens, as two windows may have equal words and other blanks
            own = roll.of(start, start + size) if apart.any() else h
            held.add([h, sid, ids, a, n, np.where(apart, own, h), np.where(apart, 0, anchor - begin)], data, begin, length)
            if held.size >= HELD:
                yield from held.batches()
        yield from held.batches()

    out = written(asked.mapInArrow(tidied(extract), "kind byte, h long, sid long, doc_id long, tkey long, a long, n int, copies long, route long, p int, content binary"), "segments")
    drop(repeated)
    return out


def _with_known(docs: DataFrame, kind: Kind, window: int, gram: int, repeated: DataFrame, hot: int) -> DataFrame:
    """The documents that have repeated anchors, each with the list of its own (known: h, hot)."""

    def places(batches):
        for part in slices(batches, "text", limit=SLICE):
            values, bounds, _ = kind.tokens(*flat(array_of(part, "text")))
            start, _, _, h = runs(Rolling(values, 0x8CB92BA72F3D8DD7), bounds, window, gram)
            doc = np.searchsorted(bounds, start, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(array_of(part, c).to_numpy()[doc]) for c in ("doc_id", "tkey")] + [signed(h)], ["doc_id", "tkey", "h"])

    own = docs.select("doc_id", "tkey", "text").mapInArrow(tidied(places), "doc_id long, tkey long, h long").join(repeated.hint("merge"), "h")
    lists = written(own.groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("h", (F.col("n") > hot).alias("hot"))).alias("known")), "anchors")
    return docs.select("doc_id", "tkey", "text").join(lists.hint("merge"), ["doc_id", "tkey"])


def decide(found: DataFrame, kernel: Callable, by_range: bool, limit: int) -> DataFrame:
    """A written table of h, sid, doc_id and a of the first place, and the kernel's bits: first (windows of the first copy
    that repeat) and later (of other copies); rows without any bit are left out. A kernel gets about ``limit`` bytes."""
    n = hash_partitions(found.sparkSession)
    dealt = found.filter("kind = 1").select(F.coalesce("route", "h").alias("route"), "p", "h", "sid", "doc_id", "a", "n", "copies", "content")
    if by_range:
        lead = F.substring("content", F.col("p") + 1, F.lit(LEAD))
        dealt = dealt.repartitionByRange(n, lead, "route").sortWithinPartitions(lead, "route")
    else:
        dealt = dealt.drop("p").repartition(n, "route").sortWithinPartitions("route")

    def run(batches):
        for table in budgeted(batches, limit):
            h, sid, doc, a, copies, size = (table.column(c).to_numpy() for c in ("h", "sid", "doc_id", "a", "copies", "n"))
            row, copies = merged(h, sid, doc, a, copies)
            data, offsets = flat(table.column("content"))
            length = np.diff(offsets)[row]
            first, later = kernel(data[spread(offsets[row], length)], starts_of(length), size[row], copies, doc[row], a[row])
            some = (first | later) != 0
            row = row[some]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[row], sid[row], doc[row], a[row], first[some], later[some])], ["h", "sid", "doc0", "a0", "first", "later"])

    return written(dealt.mapInArrow(tidied(run), "h long, sid long, doc0 long, a0 long, first long, later long"), "bits")


def budgeted(batches, limit: int):
    """Tables of rows of about ``limit`` bytes of content; rows of one route stay together."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += array_of(batch, "content").nbytes
        if size < limit:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        route = table.column("route").to_numpy()
        ends = np.cumsum(np.diff(flat(table.column("content"))[1]))
        start = 0
        for turn in (np.flatnonzero(np.diff(route) != 0) + 1).tolist():
            if ends[turn - 1] - (ends[start - 1] if start else 0) >= limit:
                yield table.slice(start, turn - start)
                start = turn
        held, size = table.slice(start).to_batches(), int(ends[-1] - (ends[start - 1] if start else 0))
    if held:
        yield pa.Table.from_batches(held)


def marks(found: DataFrame, bits: DataFrame) -> DataFrame:
    """A written table of doc_id (NULL_ID for null), tkey and marks. These are the list ``one`` of (a, mask): windows a + i
    whose bit i is set, and the list ``more`` of (a, steps, mask): the same at the places that steps tell."""
    full = F.when(F.col("n") >= 63, F.lit((1 << 63) - 1)).otherwise(F.expr("shiftleft(1L, n)") - 1)
    first = (F.col("doc_id") == F.col("doc0")) & (F.col("a") == F.col("a0"))
    mask = F.when(first, F.col("first")).otherwise(F.col("later")).bitwiseAND(full)
    # the first copy's is the least place of all, so it is never one of the further places
    rest = F.col("later").bitwiseAND(full)
    slim = found.filter("kind = 0").select("h", "sid", "doc_id", "tkey", "a", "n", F.col("content").alias("steps"))
    each = slim.join(bits, ["h", "sid"]).select("doc_id", "tkey", "a", mask.alias("mask"), "steps", rest.alias("rest"))
    each = each.filter("mask != 0 or (steps is not null and rest != 0)")
    one = F.when(F.col("mask") != 0, F.struct("a", "mask"))
    more = F.when(F.col("steps").isNotNull() & (F.col("rest") != 0), F.struct("a", "steps", F.col("rest").alias("mask")))
    # sets, which leave nulls out: equal rows of one document have equal marks
    both = F.struct(F.collect_set(one).alias("one"), F.collect_set(more).alias("more"))
    out = written(each.groupBy("doc_id", "tkey").agg(both.alias("marks")), "marks")
    drop(found, bits)
    return out


def listed(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the lists' values, the list of each)."""
    starts = lists.offsets.to_numpy() if len(lists) else np.zeros(1, np.int32)
    sizes = np.diff(starts).astype(np.int64)
    if lists.null_count:
        sizes = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, sizes)
    return spread(starts[:-1].astype(np.int64), sizes), np.repeat(np.arange(len(sizes)), sizes)


def covered(marks: pa.Array, bounds: np.ndarray, window: int) -> np.ndarray:
    """Whether each token lies in a marked window. ``bounds``: offset of each document in tokens."""
    step = np.zeros(int(bounds[-1]) + 1, np.int32)
    one, more = marks.flatten()
    rows, doc = listed(one)
    some, home = listed(more)
    if len(rows) or len(some):
        a, mask = (one.values.field(c).to_numpy(zero_copy_only=False)[rows] for c in ("a", "mask"))
        first, own = (more.values.field(c).to_numpy(zero_copy_only=False)[some] for c in ("a", "mask"))
        row, place = places(first, more.values.field("steps").take(pa.array(some)))
        a, mask = np.concatenate([a + bounds[doc], place + bounds[home[row]]]), np.concatenate([mask, own[row]])
        for bit in range(64):
            start = a[(mask >> bit) & 1 == 1] + bit
            np.add.at(step, start, 1)
            np.add.at(step, start + window, -1)
    return np.cumsum(step[:-1]) > 0


def keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id (NULL_ID for null), tkey (hash of the text), text."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(body).alias("tkey"), body.alias("text"))


def with_marks(df: DataFrame, found: DataFrame, doc_id: str, text: str, run: Callable, schema, max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """mapInArrow of ``run`` over the frame's rows, with all columns, then the text (null as empty) and its marks (null:
    none) as the last two. Only rows whose document may have marks shuffle; a stage has one Python step."""
    body, key = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))
    body_, own_, doc_, h_, marks_ = free(df, "body", "own", "doc", "h", "marks")
    names = [*df.columns, body_, marks_]
    columns = [f"`{c}`" for c in names[:-1]]
    rows = df.withColumns({body_: body, own_: F.xxhash64(body), doc_: key})
    m = found.select(F.col("doc_id").alias(doc_), F.col("tkey").alias(own_), F.col("marks").alias(marks_))
    keys = found.count()
    if not bloom.fits(keys, max_bits):
        return rows.join(m, [doc_, own_], "left").select(*columns, f"`{marks_}`").mapInArrow(tidied(run), schema)
    shared = df.sparkSession.sparkContext.broadcast(bloom.build(found.select(F.xxhash64("doc_id", "tkey").alias("h")), keys))
    kind = arrow_type(found.schema["marks"].dataType)

    def may_have(h: pa.Array) -> np.ndarray:
        return bloom.contains(shared.value, h.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))

    def unmarked(batches):
        def own():
            for batch in batches:
                some = batch.filter(pa.array(~may_have(batch.column(batch.num_columns - 1))))
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.nulls(some.num_rows, kind)], names)

        return run(own())

    asked = F.arrow_udf(lambda h: pa.array(may_have(h)), "boolean")
    rows = rows.withColumn(h_, F.xxhash64(doc_, own_))
    plain = rows.select(*columns, f"`{h_}`").mapInArrow(tidied(unmarked), schema)
    return plain.unionAll(rows.filter(asked(F.col(h_))).join(m, [doc_, own_], "left").select(*columns, f"`{marks_}`").mapInArrow(tidied(run), schema))


def arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
