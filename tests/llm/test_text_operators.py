"""Operators on single texts against the libraries, brute force and exact round trips."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kmerscape.llm import flat, op1_fingerprints, op3_sentencepiece, op4_exact_dedup, op6_token_files, op9_packing
from kmerscape.llm.shared import new_path

from .conftest import prose, rows, texts


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(op9_packing.tokenizer_path())
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_are_split_as_by_the_pattern():
    import re

    data, offsets = flat.flat(pa.array(texts()))
    first, end, bounds = flat.words(data, offsets)
    for i, t in enumerate(texts()):
        want = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        assert [bytes(data[a:b]) for a, b in zip(first[bounds[i] : bounds[i + 1]], end[bounds[i] : bounds[i + 1]])] == want


def test_exact_dedup(docs, no_docs):
    got = op4_exact_dedup.mark(docs).collect()
    groups = {}
    for d, t, *_ in rows():
        groups.setdefault(t or "", []).append(d)
    best = {t: max((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    assert len(got) == len(rows())
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter((d, best[t or ""], len(groups[t or ""]), sha(t or "")) for d, t, *_ in rows())
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert op4_exact_dedup.mark(no_docs).count() == 0


@pytest.mark.parametrize("max_bits", [0, 1 << 28])
def test_exact_dedup_keeps_rows_with_all_columns(clashing, max_bits):
    kept = op4_exact_dedup.dedup(clashing, max_bits=max_bits)
    assert kept.columns == clashing.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted({t or "" for t in texts()})


def test_exact_dedup_by_a_filter_that_is_not_broadcast(spark):
    many = spark.range(70_000).selectExpr("id doc_id", "cast(id % 60000 as string) text")
    got = op4_exact_dedup.mark(many, max_bits=0)
    assert got.filter("group_size = 2").count() == 20_000 and got.filter("kept").count() == 60_000


def test_packing(unique_docs, no_docs, ids_of):
    got = op9_packing.pack(unique_docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 for r in got)
    for i, t in enumerate(texts()):
        ids, pieces = [*ids_of(t), 1], sorted(by[i], key=lambda r: r.start)
        at = 0
        for p in pieces:
            assert p.start == at and p.length <= 2048 and p.length & (p.length - 1) == 0 and p.doc_tokens == len(ids) and 1 << p.bucket == p.length
            assert np.frombuffer(p.ids, "<u4").tolist() == ids[at : at + p.length] and p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    assert op9_packing.pack(no_docs).count() == 0


def test_sentencepiece_is_the_library(unique_docs, no_docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=op3_sentencepiece.model_path())
    got = {r.doc_id: r for r in op3_sentencepiece.encode(unique_docs).collect()}
    for i, t in enumerate(texts()):
        want = [*sp.encode(t or ""), sp.eos_id()]
        assert list(got[i].ids) == want and got[i].n_tokens == len(want)
        assert got[i].decoded == sp.decode(want)
        assert got[i].ids_sha256 == sha(" ".join(map(str, want))) and got[i].decoded_sha256 == sha(sp.decode(want))
    assert op3_sentencepiece.encode(no_docs).count() == 0


def test_sentencepiece_on_hard_words():
    import random

    import sentencepiece

    sp, rng = sentencepiece.SentencePieceProcessor(model_file=op3_sentencepiece.model_path()), random.Random(5)
    hard = ["".join(rng.choice("aabn=- \n▁é") for _ in range(rng.randrange(60))) for _ in range(3000)]
    hard += [" " * n + "x" + " " * m for n in range(40) for m in (0, 1, 17)] + ["=" * n for n in range(70)] + ["ab" * n for n in range(70)]
    ids, bounds = op3_sentencepiece.load(op3_sentencepiece.model_path()).encode(pa.array(hard))
    for i, t in enumerate(hard):
        assert ids[bounds[i] : bounds[i + 1] - 1].tolist() == sp.encode(t), repr(t)


def test_token_files(spark, docs, no_docs, ids_of, monkeypatch):
    path = new_path(spark, "t")
    op6_token_files.write(docs, path)
    got = sorted(op6_token_files.read(spark, path).collect(), key=lambda r: r.start)
    at, last = 0, -1
    want = Counter((d, len(ids_of(t)) + 1, crc([*ids_of(t), 2])) for d, t, *_ in rows())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    for r in got:
        assert r.start == at and (r.doc_id if r.doc_id is not None else -1) >= last
        at, last = at + r.n_tokens, r.doc_id if r.doc_id is not None else -1
        assert crc(np.frombuffer(r.ids, "<u4")) == r.ids_crc32
    empty = new_path(spark, "t")
    op6_token_files.write(no_docs, empty)
    assert op6_token_files.read(spark, empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_huffman_round_trip_and_optimality(seed):
    rng = np.random.default_rng(seed)
    n = [1, 2, 3, 300, 5000, 70_000][seed]
    counts = np.zeros(n + 3, np.int64)
    counts[:n] = np.maximum(1, (1e6 / np.arange(1, n + 1) ** 1.5)).astype(np.int64)
    lengths = op6_token_files.code_lengths(counts, 18)
    assert lengths.max() <= 18 and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
    if 2 < n <= 5000:  # the limit doesn't bind: as good as Huffman's own tree
        import heapq

        heap, cost = counts[counts > 0].tolist(), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            s = heapq.heappop(heap) + heapq.heappop(heap)
            cost += s
            heapq.heappush(heap, s)
        assert (counts * op6_token_files.code_lengths(counts, 24)).sum() == cost
    book = op6_token_files.Codebook(lengths)
    for size in (1, 255, 256, 257, 10_000):
        ids = rng.choice(n, size, p=counts[:n] / counts.sum()).astype(np.uint32)
        data, checkpoints = book.encode(ids)
        assert (book.decode(data, checkpoints, size) == ids).all()


def test_fingerprints(unique_docs, no_docs, clashing):
    got = {r.doc_id: r for r in op1_fingerprints.edited(unique_docs).collect()}
    all_texts = [t or "" for t in texts()]
    own = {r.text or "": r.fingerprint for r in op1_fingerprints.digest(clashing).collect()}
    for i, t in enumerate(all_texts):
        follow, k = all_texts[i - 1], len(t) // 3
        new = t[: len(t) - k] + follow[:k]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(t), sha(new), own[t])
        codes = [op1_fingerprints.codes_of(*flat.flat(pa.array([x]))) for x in (t, new, follow)]
        assert r.edited_fingerprint == op1_fingerprints.to_text(codes[1])[0]
        assert r.near_edited == op1_fingerprints.likeness(codes[0], codes[1])[0] and r.near_next == op1_fingerprints.likeness(codes[0], codes[2])[0]
        assert (op1_fingerprints.from_text([r.fingerprint]) == codes[0]).all()
    assert op1_fingerprints.edited(no_docs).count() == 0
    a, b = prose(300, 900), prose(301, 900)
    codes = op1_fingerprints.codes_of(*flat.flat(pa.array([a, a.replace("a", "e", 20), b])))
    assert op1_fingerprints.likeness(codes[:1], codes[:1])[0] == 1
    assert op1_fingerprints.likeness(codes[:1], codes[1:2])[0] > op1_fingerprints.likeness(codes[:1], codes[2:])[0]


def by_hand(text):
    """The digest, bucket by bucket: counts of hashed triplets, quartiles, and the length's step."""
    import math

    raw, counts, m = text.encode(), [0] * 256, 0xFFFFFFFF
    for i in range(len(raw) - 3):
        w = raw[i : i + 4]
        for a, b, c, salt in op1_fingerprints.TRIPLETS:
            h = (w[a] * (salt | 1) + w[b] * 0x27D4EB2F + w[c] * 0x165667B1) & m
            h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & m
            counts[h >> 24] += 1
    ranked = sorted(counts)
    q = [ranked[63], ranked[127], ranked[191]]
    codes = [sum(x > y for y in q) for x in counts]
    step = min(int(math.floor(math.log(max(len(raw), 1)) / math.log(1.2))), 255)
    return step, codes


def likeness_by_hand(a, b):
    steps = {0: 0, 1: 1, 2: 2, 3: 6}
    return 1 - min(416, sum(steps[abs(x - y)] for x, y in zip(a[1], b[1])) + abs(a[0] - b[0])) / 416


def test_digest_and_likeness_by_hand():
    some = [t or "" for t in texts()]
    codes = op1_fingerprints.codes_of(*flat.flat(pa.array(some)))
    own = [by_hand(t) for t in some]
    for i, (step, body) in enumerate(own):
        assert codes[i].tolist() == [step, *body]
        packed = bytes([step]) + bytes(body[j] << 6 | body[j + 1] << 4 | body[j + 2] << 2 | body[j + 3] for j in range(0, 256, 4))
        assert op1_fingerprints.to_text(codes[i : i + 1]) == [packed.hex()]
        assert op1_fingerprints.likeness(codes[i : i + 1], codes[:1])[0] == pytest.approx(likeness_by_hand(own[i], own[0]))


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_order_of_equal_and_null_ids(spark, docs, ranges):
    """Descending doc_id, null last; rows of one doc_id by descending hash of the text, however many they are."""
    import xxhash

    extra = [(7, prose(500 + i, 20 + i)) for i in range(40)] + [(None, prose(600 + i, 30)) for i in range(30)]
    table = [(d, t or "") for d, t, *_ in rows()] + extra
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64 - 2**63
    ordered = sorted(table, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])), reverse=True)
    want = Counter()
    for i, (d, t) in enumerate(ordered):
        k, follow = len(t) // 3, ordered[(i + 1) % len(ordered)][1]
        want[d, len(t), sha(t[: len(t) - k] + follow[:k])] += 1
    import zstandard

    got = Counter()
    for r in op1_fingerprints.with_next(df, "doc_id", "text", ranges).collect():
        t, follow = (zstandard.ZstdDecompressor().decompress(z).decode() for z in (r.z, r.next_z))
        k = len(t) // 3
        got[r.doc_id, r.n_chars, sha(t[: len(t) - k] + follow[:k])] += 1
    assert got == want
    assert op1_fingerprints.edited(docs).count() == len(rows())


def test_a_doc_id_of_many_rows_has_many_ranges():
    place = op1_fingerprints.Ranges([5, 5, 5, 5, 9], 3)
    h = pa.array(np.linspace(-(2**63), 2**63 - 1025, 100).astype(np.int64))
    for ids, ranges in ((pa.array([5] * 100), {1, 2, 3, 4}), (pa.array([None] * 100, pa.int64()), {-2, -1, 0}), (pa.array([4] * 100), {1}), (pa.array([6] * 100), {5})):
        r = place.of(ids, h)
        assert (np.diff(r) >= 0).all() and set(r.tolist()) == ranges


def test_packing_of_null_and_repeated_rows_and_buckets(spark, docs, clashing, ids_of, tmp_path):
    pieces = op9_packing.pack(docs)
    want = Counter((d, len(ids_of(t)) + 1) for d, t, *_ in rows())
    assert Counter((r.doc_id, r.doc_tokens) for r in pieces.filter("start = 0").collect()) == want
    op9_packing.write(pieces, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == pieces.count()
    for length in (1, 64, 2048):
        assert {r.length for r in op9_packing.batch(spark, str(tmp_path / "p"), length).collect()} <= {length}
    assert op9_packing.pack(clashing).count() > 0


def test_sentencepiece_of_null_and_repeated_rows_and_a_long_word(spark, docs, clashing):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=op3_sentencepiece.model_path())
    assert Counter((r.doc_id, r.n_tokens) for r in op3_sentencepiece.encode(docs).collect()) == Counter((d, len(sp.encode(t or "")) + 1) for d, t, *_ in rows())
    long = "".join(prose(700, 4000).split(" "))
    got = op3_sentencepiece.encode(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert list(got.ids)[:-1] == sp.encode(long) and op3_sentencepiece.encode(clashing).count() == len(texts())


def test_token_files_with_clashing_columns(spark, clashing):
    path = new_path(spark, "t")
    op6_token_files.write(clashing, path)
    assert op6_token_files.read(spark, path, ids=False).count() == len(texts())


def test_names_of_the_operators_own_do_not_clash(spark):
    names = ["page", "words", "sha", "id", "row", "_row", "h", "best", "size", "__maybe", "__id", "__sha", "__row"]
    df = spark.createDataFrame([(i, t, *names) for i, t in enumerate(["a", "b", "a", "c"])], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = op4_exact_dedup.dedup(df)
    assert got.columns == df.columns and sorted((r.doc_id, r.row, r.page) for r in got.collect()) == [(1, "row", "page"), (2, "row", "page"), (3, "row", "page")]
    assert op4_exact_dedup.mark(df).count() == 4
