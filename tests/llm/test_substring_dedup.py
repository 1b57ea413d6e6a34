"""Both substring operators against brute force, at sizes that take every path."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from kmerscape.llm import anchors
from kmerscape.llm import op5_substring_dedup as op5
from kmerscape.llm import op10_suffix_dedup as op10

from .conftest import SCHEMA, prose, rows


def brute_words(table, window):
    docs = [(d, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for d, t in table]
    seen = Counter(tuple(w[i : i + window]) for _, w in docs for i in range(len(w) - window + 1))
    for d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        yield d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()


def brute_bytes(table, length):
    first = {}
    for d, t in table:
        b, key = (t or "").encode(), -1 if d is None else d
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(first.get(s, (1 << 60, 0)), (key, i))
    for d, t in table:
        b, key = (t or "").encode(), -1 if d is None else d
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (key, i):
                gone[i : i + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        yield d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()


def mixed(seed, n):
    """Passages in ever new context, copies, and periodic texts."""
    rng = random.Random(seed)
    passages = [prose(900 + i, 45 + 20 * i) for i in range(4)]
    out = []
    for i in range(n):
        parts = [prose(seed * 1000 + i, rng.randrange(1, 60))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages).split(" ")
            a = rng.randrange(len(p) // 2)
            parts += [" ".join(p[a : a + rng.randrange(20, len(p))]), prose(rng.random(), rng.randrange(1, 9))]
        out.append((i, " ".join(parts)))
    return out + [(n + i, out[i][1]) for i in range(0, n, 3)] + [(2 * n, "la " * 200), (2 * n + 1, "la lo " * 60 + "la " * 50)]


OPTIONS = [{}, {"max_bits": 0, "hot": 3}, {"hot": 1}]


@pytest.mark.parametrize("options", OPTIONS)
@pytest.mark.parametrize("which", ["cases", "mixed"])
def test_words(spark, options, which):
    table = [(d, t) for d, t, *_ in rows()] if which == "cases" else mixed(3, 60)
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, op5.report(df, **options).collect())) == Counter(brute_words(table, 35))


@pytest.mark.parametrize("options", OPTIONS)
@pytest.mark.parametrize("which", ["cases", "mixed"])
def test_bytes(spark, options, which):
    table = [(d, t) for d, t, *_ in rows()] if which == "cases" else mixed(4, 40)
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    got = op10.dedup(df, **options).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(brute_bytes(table, 100))
    for r in got:
        assert r.n_spans == len(r.spans) and sum(b - a for a, b in r.spans) == r.n_removed and hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256


def test_removed_words_in_texts(clashing, no_docs):
    got = op5.dedup(clashing)
    assert got.columns == clashing.columns and got.schema == clashing.schema
    want = {d: s for d, _, n, s in brute_words([(r.doc_id, r.text) for r in clashing.collect()], 35) if n}
    plain = {r.doc_id: r.text for r in clashing.collect()}
    for r in got.collect():
        assert hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id] if r.doc_id in want else r.text == plain[r.doc_id]
    assert op5.dedup(no_docs).count() == op5.report(no_docs).count() == op10.dedup(no_docs).count() == 0


def test_fm_index_counts():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 7, 400)
    bounds = np.array([0, 50, 50, 173, 400])
    index = op5.FmIndex(values, bounds, np.array([1, 1, 2, 1]))
    segments = [values[a:b] for a, b in zip(bounds, bounds[1:])]
    segments.append(segments[2])
    known = np.unique(values)
    for size in range(1, 6):
        for _ in range(30):
            word = rng.integers(0, 7, size)
            low, high = np.array([0]), np.array([index.size])
            for c in word[::-1]:
                low, high = index.back(np.array([np.searchsorted(known, c) + 1]), low, high)
            assert high[0] - low[0] == sum((s[i : i + size] == word).all() for s in segments for i in range(len(s) - size + 1))


def test_suffix_ties():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    for length in (5, 8, 13, 16):
        at = np.arange(len(data) - length)
        group = op10.tie_groups(data, at, length)
        seen = {}
        for i, g in enumerate(group.tolist()):
            seen.setdefault(bytes(data[i : i + length]), set()).add((g, i if g < 0 else 0))
        assert all(len(s) == 1 for s in seen.values()) and len({next(iter(s)) for s in seen.values()}) == len(seen)


def test_index_is_compressed():
    rng = np.random.default_rng(4)
    once = rng.integers(0, 200, 300)
    many = np.concatenate([np.roll(once, i) for i in range(100)])
    small, large = (op5.FmIndex(x, np.arange(0, len(x) + 1, 300), np.ones(len(x) // 300, np.int64)).runs for x in (once, many))
    assert large.nbytes < 0.25 * 100 * small.nbytes


THUE_MORSE = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))


def test_long_words_that_a_polynomial_cannot_tell_apart(spark):
    """A word of two letters in Thue-Morse order and its complement have one hash modulo 2**64 for every base."""
    head = prose(8, 34)
    table = [(0, head + " " + THUE_MORSE), (1, head + " " + THUE_MORSE.translate(str.maketrans("ab", "ba")))]
    df = spark.createDataFrame(table, "doc_id long, text string")
    assert {r.n_removed for r in op5.report(df).collect()} == {0}
    same = spark.createDataFrame([table[0], (1, table[0][1])], df.schema)
    assert {r.n_removed for r in op5.report(same).collect()} == {35}


def test_names_of_the_operators_own_do_not_clash(spark):
    text = prose(9, 80)
    names = ["__body", "body", "own", "doc", "h", "marks", "_h", "__marks"]
    df = spark.createDataFrame([(i, text, *names) for i in range(2)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = op5.dedup(df)
    assert got.schema == df.schema and [tuple(r)[1:] for r in got.collect()] == [("", *names)] * 2


def test_equal_words_with_other_blanks(spark):
    words = prose(10, 50).split(" ")
    table = [(0, " ".join(words)), (1, "\n ".join(words)), (2, "  ".join(words[5:]))]
    df = spark.createDataFrame(table, "doc_id long, text string")
    for options in OPTIONS:
        assert Counter(map(tuple, op5.report(df, **options).collect())) == Counter(brute_words(table, 35))


def test_very_long_text(spark):
    """One document of 3 MB that holds another one in its middle."""
    passage = prose(11, 300)
    table = [(0, prose(12, 300_000) + " " + passage + " " + prose(13, 300_000)), (1, passage)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    assert Counter(map(tuple, op5.report(df).collect())) == Counter(brute_words(table, 35))
    got = {r.doc_id: r.n_removed for r in op10.dedup(df, kept=False).collect()}
    assert got == {0: 0, 1: len(passage.encode())}


@pytest.mark.parametrize("options", OPTIONS)
def test_periodic_texts_have_a_row_for_each_distinct_run(spark, options):
    """Equal runs of a text are one row that meets the bits, however often and wherever they start."""
    def table(times):
        loops = [(i, prose(60 + i, 40) + " " + "la lo " * times + prose(80 + i, 40) + " " + "la lo " * (times // 2)) for i in range(12)]
        return [*loops, loops[5], (3, loops[4][1]), (None, loops[6][1])]

    found = []
    for times in (100, 200):
        df = spark.createDataFrame(table(times), "doc_id long, text string")
        for kind, window, gram in ((anchors.WORDS, 35, 10), (anchors.BYTES, 100, 38)):
            slim = anchors.segments(anchors.keyed(df, "doc_id", "text"), kind, window, gram, options.get("max_bits", 1 << 28), options.get("hot", anchors.HOT)).filter("kind = 0")
            found.append(slim.count())
            assert slim.select("doc_id", "tkey", "h", "sid").distinct().count() == found[-1] - slim.filter("doc_id = 5").count() // 2
    assert found[:2] == found[2:]
    df = spark.createDataFrame(table(100), "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, op5.report(df, **options).collect())) == Counter(brute_words(table(100), 35))
    assert Counter(tuple(r)[:5] for r in op10.dedup(df, **options).collect()) == Counter(brute_bytes(table(100), 100))


@pytest.mark.parametrize("most", [anchors.PLACES, 3, 1])
def test_places_of_equal_runs(monkeypatch, most):
    monkeypatch.setattr(anchors, "PLACES", most)

    rng = np.random.default_rng(5)
    doc, h, sid, a = rng.integers(0, 5, 500), rng.integers(0, 3, 500).astype(np.uint64), rng.integers(0, 3, 500).astype(np.uint64), rng.permutation(10**6)[:500]
    row, steps = anchors.by_text(doc, h, sid, a)
    assert len(row) == sum(-(-n // most) for n in Counter(zip(doc, h, sid)).values())
    at, place = anchors.places(a[row], steps)
    assert Counter([*zip(doc[row], h[row], sid[row], a[row]), *zip(doc[row][at], h[row][at], sid[row][at], place)]) == Counter(zip(doc, h, sid, a))
