"""N-gram Jaccard join: MinHash banding, verified on full n-gram sets.

1. A document's n-grams of words (unchanged, split at ASCII white space; a shorter text is one n-gram) are hashed; documents
   with equal sets collapse to a class with a count, so copies are never paired.
2. Each class has a MinHash signature. Band and row counts come from the target recall: the most rows per band whose bands
   reach ``recall`` at the threshold within ``max_hashes``. Band keys are shuffled; keys of one class only drop out.
3. In a bucket, members are compared with leaders, not with each other: a member near a leader joins it, another becomes a
   leader; all members that could have a link to someone at a leader are tied to it. By the triangle inequality of the
   Jaccard distance, two members with a link are tied to a common leader. A bucket of more than ``part`` members is dealt to
   parts by class: each part finds its leaders, and all leaders of the key meet the members of every part. Only spanning
   edges leave; their components are families.
4. The sets of families' representatives are read again from the texts (a Bloom filter picks the documents while it may be
   broadcast, else a join does) and sent once to their family; large families are dealt to blocks, and pairs of blocks are
   tasks. All pairs of a task are verified by bit counts over the n-grams that occur at least twice in it: at most
   2 x ``block`` sets and ``block_bytes`` / 8 such n-grams, 128 MB of bits. Tasks return link counts and spanning edges.

No cap on partners or candidates, and pairs are never rows. Exact link counts need every pair of a family, so the work of a
family is quadratic in its different sets, in tasks of bounded size.

Defined cases: texts without a word have no n-gram, so no link and a class of their own; null text likewise; a null doc_id
is a document like others that comes after all numbers, so its class prints null only if no member has one; repeated rows
are copies, and dedup() keeps one; a text of any length is one set; an empty table gives an empty result; columns of any
other name stay as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .components import components
from .flat import Rolling, array_of, binary_array, flat, mix, slices, spread, starts_of, tidied, word_hashes, words
from .shared import bounded, drop, free, hash_partitions, written

SIZE = 5
THRESHOLD = 0.8
RECALL = 0.9995
MAX_HASHES = 128
#: Estimated similarity to a leader at which a member joins it, and at which it is tied to it: 1 - (0.3 + 0.2), less the
#: error of the estimates.
JOIN, TIE = 0.7, 0.4
#: Members and bytes of sets of a block.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
#: Members of a bucket's part.
PART = 1024
SEED = 0x2545F4914F6CDD1D
#: Bytes of text whose n-grams are made at a time.
SLICE = 1 << 20


def banding(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows)."""
    best = None
    for rows in range(1, max_hashes + 1):
        chance = threshold**rows
        bands = 1 if chance >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-chance))
        if bands * rows <= max_hashes:
            best = bands, rows
    if not best:
        raise ValueError("max_hashes is too small for this recall")
    return best


def ngrams(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct n-grams of each document in ascending order, offset of each document)."""
    first, end, bounds = words(data, offsets)
    roll = Rolling(word_hashes(data, first, end), 0xC6A4A7935BD1E995)
    counts = np.diff(bounds)
    n = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    begin = spread(bounds[:-1], n)
    doc = np.repeat(np.arange(len(n)), n)
    hashes = roll.of(begin, np.minimum(begin + size, bounds[1:][doc]))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[fresh], np.searchsorted(doc[fresh], np.arange(len(n) + 1))


def set_keys(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that stand for each set."""
    out = []
    for salt in (1, 2):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes ^ mix(np.array([salt], np.uint64))), out=sums[1:])
        out.append(mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)))
    return out[0], out[1]


def signatures(hashes: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """MinHash signatures of the non-empty sets: n x count uint64."""
    some = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(bounds) - 1, count), np.uint64)
    factors = mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(SEED)) | np.uint64(1)
    # as many sets at a time as stay in the processor's cache
    at = 0
    while at < len(some):
        stop = max(at + 1, int(np.searchsorted(bounds[some], bounds[some[at]] + (1 << 14))))
        rows = some[at:stop]
        low, high = bounds[rows[0]], bounds[rows[-1] + 1]
        part, cuts = hashes[low:high], bounds[rows] - low
        for k in range(count):
            out[rows, k] = np.minimum.reduceat(part * factors[k], cuts)
        at = stop
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band, the band's number included: n x bands."""
    key = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64) + np.uint64(SEED)), (len(signature), bands)).copy()
    cut = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    for i in range(rows):
        key = mix(key ^ cut[:, :, i])
    return key


def short(signature: np.ndarray) -> np.ndarray:
    """Sixteen bits of each value, to estimate similarities."""
    return (mix(signature) >> np.uint64(48)).astype(np.uint16)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number in each of n nodes' components, by the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new[label]
    return label


def _describe(size: int, bands: int, rows: int):
    def run(batches):
        for part in slices(batches, limit=SLICE):
            hashes, bounds = ngrams(*flat(array_of(part, "text")), size)
            first, second = set_keys(hashes, bounds)
            full = signatures(hashes, bounds, bands * rows)
            keys = band_keys(full, bands, rows)
            n = len(first)
            sets = [binary_array(x.view(np.uint8).reshape(-1), np.arange(n + 1) * x.shape[1] * x.itemsize).cast(pa.binary()) for x in (keys, short(full))]
            yield pa.RecordBatch.from_arrays([array_of(part, "doc_id"), array_of(part, "tkey"), signed(first), signed(second), pa.array(np.diff(bounds)), *sets], ["doc_id", "tkey", "k1", "k2", "n", "bands", "sketch"])

    return run


def _band_rows(bands: int):
    def run(batches):
        for batch in batches:
            data, _ = flat(array_of(batch, "bands"))
            keys = np.ascontiguousarray(data).view(np.uint64)
            yield pa.RecordBatch.from_arrays([signed(keys), array_of(batch, "cid").take(pa.array(np.repeat(np.arange(batch.num_rows), bands)))], ["key", "cid"])

    return run


def grouped(batches, keys: list[str]):
    """Record batches of the rows of each group; the rows come sorted by ``keys``. Yields (tables of whole groups)."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [array_of(batch, k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        turns = np.flatnonzero(change)
        same = bool(held) and all(array_of(held[-1], k)[-1].as_py() == c[0] for k, c in zip(keys, columns))
        if held and not same:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if not len(turns):
            held.append(batch)
            continue
        last = int(turns[-1])
        yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _elect(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaders; ties as pairs: leader, member)."""
    leaders, a, b, free_ = [], [], [], np.ones(len(own), bool)
    while free_.any():
        leader = int(np.argmax(free_))
        alike = (own == own[leader]).mean(axis=1)
        tied = np.flatnonzero(alike >= TIE)
        leaders.append(leader)
        a.append(np.full(len(tied), leader))
        b.append(tied)
        free_ &= alike < JOIN
        free_[leader] = False
    return np.array(leaders, np.int64), np.concatenate(a), np.concatenate(b)


def _groups_of(table: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sketches, first row of each group and the number of rows)."""
    turn = np.ones(table.num_rows, bool)
    turn[1:] = False
    for name in names:
        column = table.column(name).to_numpy()
        turn[1:] |= column[1:] != column[:-1]
    sketch = np.ascontiguousarray(flat(table.column("sketch"))[0]).view(np.uint16).reshape(table.num_rows, -1)
    return sketch, np.append(np.flatnonzero(turn), table.num_rows)


def _leaders(batches):
    """The leaders of each part of a bucket."""
    for table in grouped(batches, ["key", "part"]):
        sketch, starts = _groups_of(table, ["key", "part"])
        rows = np.concatenate([a + _elect(sketch[a:b])[0] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())])
        yield from table.select(["key", "cid", "parts", "sketch"]).take(pa.array(rows)).combine_chunks().to_batches()


def _tie(batches):
    """Spanning edges of the members of each bucket, or part of a bucket with the leaders of all parts (these come first)."""
    for table in grouped(batches, ["key", "part"]):
        sketch, starts = _groups_of(table, ["key", "part"])
        cid, leads = table.column("cid").to_numpy(), table.column("leads").to_numpy(zero_copy_only=False)
        sizes = np.diff(starts)
        two = starts[:-1][sizes == 2]
        near = (sketch[two] == sketch[two + 1]).mean(axis=1) >= TIE if len(two) else np.zeros(0, bool)
        left, right = [cid[two[near]]], [cid[two[near] + 1]]
        for begin, size in zip(starts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            own, led = sketch[begin : begin + size], int(leads[begin : begin + size].sum())
            if led:
                tied = [np.flatnonzero((own == own[i]).mean(axis=1) >= TIE) for i in range(led)]
                a, b = np.repeat(np.arange(led), [len(t) for t in tied]), np.concatenate(tied)
            else:
                _, a, b = _elect(own)
            label = spanning(size, a, b)
            moved = np.flatnonzero(label != np.arange(size))
            left.append(cid[begin + moved])
            right.append(cid[begin + label[moved]])
        a, b = np.concatenate(left), np.concatenate(right)
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def _tied(met: DataFrame, sketches: DataFrame, part: int, n: int) -> DataFrame:
    """(a, b): spanning edges of the buckets. ``met``: key, cid, members."""
    parts = F.ceil(F.col("members") / part).cast("int")
    rows = met.join(sketches, "cid").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    found = rows.filter("parts > 1").select("key", "part", "cid", "parts", "sketch").repartition(n, "key", "part").sortWithinPartitions("key", "part").mapInArrow(tidied(_leaders), "key long, cid long, parts int, sketch binary")
    leaders = found.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "cid", "sketch", F.lit(True).alias("leads"))
    both = rows.select("key", "part", "cid", "sketch", F.lit(False).alias("leads")).unionAll(leaders)
    return both.repartition(n, "key", "part").sortWithinPartitions("key", "part", F.desc("leads")).mapInArrow(tidied(_tie), "a long, b long")


def links(values: np.ndarray, bounds: np.ndarray, side: np.ndarray, both: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all pairs of sets whose Jaccard similarity reaches the threshold; ``both``: only pairs across sides."""
    n = np.diff(bounds)
    known, ids, counts = np.unique(values, return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    row, keep = np.repeat(np.arange(len(n)), n), shared[ids]
    row, column = row[keep], number[ids[keep]]
    bits = np.zeros((len(n), max(1, -(-int(shared.sum()) // 64))), np.uint64)
    np.bitwise_or.at(bits, (row, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
    left, right = [], []
    other = np.flatnonzero(side == 1)
    for i in np.flatnonzero(side == 0).tolist():
        to = other if both else np.arange(i + 1, len(n))
        to = to[(np.minimum(n[to], n[i]) >= threshold * np.maximum(n[to], n[i]) - 1e-9)]
        for part in np.array_split(to, max(1, len(to) * bits.shape[1] >> 20)):
            common = np.bitwise_count(bits[i] & bits[part]).sum(axis=1).astype(np.int64)
            hit = part[common >= threshold * (n[i] + n[part] - common) - 1e-9]
            if len(hit):
                left.append(np.full(len(hit), i))
                right.append(hit)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _verify(threshold: float):
    """Of each task: rows (cid, links, to): the number of linked documents, and an edge to a linked class (or itself)."""

    def run(batches):
        for table in grouped(batches, ["family", "p", "q"]):
            family, p, q = (table.column(c).to_numpy() for c in ("family", "p", "q"))
            turn = np.ones(len(p), bool)
            turn[1:] = (family[1:] != family[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
            starts = np.append(np.flatnonzero(turn), len(p)).tolist()
            cid, copies, block = (table.column(c).to_numpy() for c in ("cid", "copies", "block"))
            data, offsets = flat(table.column("grams"))
            for a, b in zip(starts, starts[1:]):
                own = a + np.unique(cid[a:b], return_index=True)[1]  # repeated rows of a representative count once
                sizes = offsets[own + 1] - offsets[own]
                values = np.ascontiguousarray(data[spread(offsets[own], sizes)]).view(np.uint64)
                i, j = links(values, starts_of(sizes // 8), (block[own] != p[a]).astype(np.int8), bool(p[a] != q[a]), threshold)
                if not len(i):
                    continue
                count = np.bincount(i, copies[own][j], len(own)) + np.bincount(j, copies[own][i], len(own))
                label, some = spanning(len(own), i, j), np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(cid[own][some]), pa.array(count[some].astype(np.int64)), pa.array(cid[own][label[some]])], ["cid", "links", "to"])

    return run


def join(df: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES, doc_id: str = "doc_id", text: str = "text", max_bits: int = bloom.MAX_BITS, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, part: int = PART) -> DataFrame:
    """One row per document: doc_id, tkey (hash of the text), class_id (smallest doc_id of the documents that links
    connect), rep_id (smallest doc_id with the same n-grams), n_links (other documents at or above the threshold, copies
    included), first (whether it is the row, or a repeated row of the one, that stays for its class)."""
    spark = bounded(df.sparkSession)
    n = hash_partitions(spark)
    bands, rows = banding(threshold, recall, max_hashes)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("tkey"), body.alias("text"))
    described = written(keyed.mapInArrow(tidied(_describe(size, bands, rows)), "doc_id long, tkey long, k1 long, k2 long, n long, bands binary, sketch binary"), "op8")
    some = described.filter("n > 0")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tkey")).alias("rep")
    classes = written(
        some.groupBy("k1", "k2").agg(F.count("*").alias("copies"), rep, F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")).withColumn("cid", F.monotonically_increasing_id()),
        "op8",
    )
    keys = classes.select("cid", "bands").mapInArrow(tidied(_band_rows(bands)), "key long, cid long")
    shared = keys.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    met = written(keys.join(shared, "key"), "op8")
    families = written(components(_tied(met, classes.select("cid", "sketch"), part, n)).select(F.col("node").alias("cid"), F.col("component").alias("family")), "op8")
    drop(met)

    chosen = written(families.join(classes.select("cid", "k1", "k2", "copies", "n", "rep"), "cid"), "op8")
    drop(families)
    asked, reps = keyed, chosen.count()
    shared_bits = None
    if bloom.fits(reps, max_bits):
        shared_bits = spark.sparkContext.broadcast(bloom.build(chosen.select(F.xxhash64("rep.doc_id", "rep.tkey").alias("h")), reps))
    else:
        named = chosen.select(F.col("rep.doc_id").alias("rep_doc"), F.col("rep.tkey").alias("rep_key"))
        asked = keyed.join(named.hint("merge"), keyed["doc_id"].eqNullSafe(named["rep_doc"]) & (keyed["tkey"] == named["rep_key"]), "left_semi")

    def sets(batches):
        for batch in batches:
            if shared_bits is not None:
                own = bloom.contains(shared_bits.value, array_of(batch, "h").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                batch = batch.filter(pa.array(own))
            for part in slices([batch], limit=SLICE):
                hashes, bounds = ngrams(*flat(array_of(part, "text")), size)
                first, second = set_keys(hashes, bounds)
                yield pa.RecordBatch.from_arrays([array_of(part, "doc_id"), array_of(part, "tkey"), signed(first), signed(second), binary_array(hashes.view(np.uint8), bounds * 8).cast(pa.binary())], ["doc_id", "tkey", "k1", "k2", "grams"])

    own = asked.withColumn("h", F.xxhash64("doc_id", "tkey")).mapInArrow(tidied(sets), "doc_id long, tkey long, k1 long, k2 long, grams binary")
    wanted = chosen.withColumn("rep_doc", F.col("rep.doc_id")).withColumn("rep_key", F.col("rep.tkey"))
    same = own["k1"].eqNullSafe(wanted["k1"]) & (own["k2"] == wanted["k2"]) & own["doc_id"].eqNullSafe(wanted["rep_doc"]) & (own["tkey"] == wanted["rep_key"])
    given = own.join(wanted, same).select("family", "cid", "copies", "n", "grams")
    blocks = chosen.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") * 8 / block_bytes)).cast("int").alias("blocks"))
    placed = given.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x")).select("family", "cid", "copies", "grams", "block", F.least("block", "x").alias("p"), F.greatest("block", "x").alias("q"))
    verified = written(dealt.repartition(n, "family", "p", "q").sortWithinPartitions("family", "p", "q").mapInArrow(tidied(_verify(threshold)), "cid long, links long, to long"), "op8")
    linked = verified.groupBy("cid").agg(F.sum("links").alias("links"))
    parts = components(verified.filter("cid != to").select(F.col("cid").alias("a"), F.col("to").alias("b")))
    named = classes.select("cid", "k1", "k2", "copies", "rep").join(parts.select(F.col("node").alias("cid"), "component"), "cid", "left").join(linked, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    heads = named.groupBy("component").agg(F.min("rep").alias("head"))
    result = written(named.join(heads, "component").select("k1", "k2", F.col("rep.doc_id").alias("rep_id"), "head", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "op8")
    drop(classes, chosen, verified)
    alone = described.filter("n = 0").select("doc_id", "tkey", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("rep_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"))
    first = F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("head.tkey") == F.col("tkey"))
    return some.select("doc_id", "tkey", "k1", "k2").join(result, ["k1", "k2"]).select("doc_id", "tkey", F.col("head.doc_id").alias("class_id"), "rep_id", "n_links", first.alias("first")).unionAll(alone)


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = bloom.MAX_BITS, **options) -> DataFrame:
    """The rows, with all columns, of which one stays for each class. Rows that surely stay don't shuffle: a Bloom filter of
    the others' keys, and of those of repeated rows, tells."""
    found = join(df, doc_id=doc_id, text=text, max_bits=max_bits, **options).groupBy("doc_id", "tkey").agg(F.max("first").alias("first"), F.count("*").alias("n"))
    special = written(found.filter("not first or n > 1"), "op8")
    ident, key, page, words, left, right, stays = free(df, "id", "key", "page", "words", "id2", "key2", "stays")
    rows = df.withColumns({ident: F.col(doc_id).cast("long"), key: F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))})
    n = bloom.pages_for(special.count())
    cells = written(bloom.pages(special.select(F.xxhash64("doc_id", "tkey").alias("h")), n, least=1), "op8")
    asked, plain = bloom.split(rows, F.xxhash64(ident, key), cells, n, (page, words), max_bits)
    side = special.select(F.col("doc_id").alias(left), F.col("tkey").alias(right), F.col("first").alias(stays))
    met = asked.join(side, F.col(ident).eqNullSafe(F.col(left)) & (F.col(key) == F.col(right)), "left")
    again = met.filter(f"`{stays}`").dropDuplicates([ident, key])
    return plain.select(*[f"`{c}`" for c in df.columns]).unionAll(met.filter(f"`{stays}` is null").unionAll(again).select(*[f"`{c}`" for c in df.columns]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "class_id", "rep_id", "n_links")
