"""The n-gram Jaccard join, components and the pipeline against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from kmerscape.llm import op8_ngram_join as op8
from kmerscape.llm.components import components

from .conftest import prose, rows


def brute(table, size=5, threshold=0.8):
    """{row: (doc_id, class, links)}"""
    sets = []
    for _, t in table:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set())
    label, links = list(range(len(table))), [0] * len(table)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                label[max(root(i), root(j))] = min(root(i), root(j))
    classes = {}
    for i, (d, _) in enumerate(table):
        classes.setdefault(root(i), []).append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in classes.items()}
    return Counter((d, least[root(i)], links[i]) for i, (d, _) in enumerate(table))


def near_copies(seed, families, members, spread):
    rng, out = random.Random(seed), []
    for f in range(families):
        base = prose(seed * 100 + f, rng.randrange(60, 200)).split(" ")
        for _ in range(members):
            words = list(base)
            for _ in range(rng.randrange(spread)):
                words[rng.randrange(len(words))] = prose(rng.random(), 1)
            out.append(" ".join(words))
    rng.shuffle(out)
    return [(i, t) for i, t in enumerate(out)] + [(len(out) + i, t) for i, t in enumerate(out[:9])]


@pytest.mark.parametrize("options", [{}, {"block": 3, "max_bits": 0, "part": 5}])
@pytest.mark.parametrize("table", [[(d, t) for d, t, *_ in rows()], near_copies(1, 12, 12, 8), near_copies(2, 3, 60, 4)], ids=["cases", "near", "groups"])
def test_links_and_classes(spark, table, options):
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    got = op8.join(df, **options).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute(table)


def test_one_of_each_class_stays(clashing, no_docs, spark):
    got = op8.dedup(clashing)
    assert got.columns == clashing.columns
    table = [(r.doc_id, r.text) for r in clashing.collect()]
    assert sorted(r.doc_id for r in got.collect()) == sorted(d for (d, c, _) in brute(table) if d == c)
    assert op8.dedup(no_docs).count() == op8.join(no_docs).count() == 0


def test_the_row_that_names_its_class_stays(spark):
    """Null doc_ids come last; of repeated rows one stays."""
    text = prose(20, 200)
    words = text.split(" ")
    near = " ".join([*words[:-1], "other"])
    df = spark.createDataFrame([(None, near), (3, text), (1, "t u v"), (1, "t u v"), (2, "t u v"), (None, "alone"), (None, "alone"), (7, ""), (7, "")], "doc_id long, text string")
    for bits in (0, 1 << 28):
        got = op8.join(df, max_bits=bits).collect()
        assert {r.class_id for r in got if r.n_links == 1 and r.rep_id in (None, 3)} == {3, None}  # the pair, and the two nulls
        assert sorted(map(str, op8.dedup(df, max_bits=bits).collect())) == sorted(map(str, df.filter("doc_id in (1, 3, 7) or text = 'alone'").distinct().collect()))


def test_long_words_that_a_polynomial_cannot_tell_apart(spark):
    from .test_substring_dedup import THUE_MORSE

    other = THUE_MORSE.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(0, THUE_MORSE), (1, other), (2, "a b c d " + THUE_MORSE), (3, "a b c d " + other)], "doc_id long, text string")
    assert [r.n_links for r in op8.join(df).collect()] == [0] * 4


def test_names_of_the_operators_own_do_not_clash(spark):
    names = ["__id", "__key", "id", "key", "page", "words", "id2", "key2", "stays", "tkey", "first"]
    df = spark.createDataFrame([(i, t, *names) for i, t in enumerate(["a b", "a b", "c"])], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = op8.dedup(df)
    assert got.schema == df.schema and sorted(tuple(r) for r in got.collect()) == [(0, "a b", *names), (2, "c", *names)]


def test_banding_reaches_its_recall():
    for threshold, recall in ((0.8, 0.9995), (0.9, 0.999), (0.5, 0.95)):
        bands, rows_ = op8.banding(threshold, recall)
        assert bands * rows_ <= op8.MAX_HASHES and 1 - (1 - threshold**rows_) ** bands >= recall


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(100)] + [(5000, 5000 + i) for i in range(1, 200)]
    label = {n: n for e in edges for n in e}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in edges:
        label[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in label if any(n in e and e[0] != e[1] for e in edges)}
