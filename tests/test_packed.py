"""Counting in groups of chunks, without and with errors, against brute force."""

import os
import random

import numpy as np
import pytest

from kmerscape.operators import frequency as fr
from kmerscape.operators import near, packed, sinks, windows
from kmerscape.operators.runs import runs, runs_of_chunks
from kmerscape.plans import catalog
from kmerscape.sources import stored
from kmerscape.streaming.arrivals import Against

from . import brute
from .test_kmers import CASES, collected, corpus_of, table

SF = "/root/testdata/sf0.001"


@pytest.fixture
def small(monkeypatch):
    """Groups, buckets and slices of few windows, whatever the corpus."""
    monkeypatch.setattr(packed, "LEAST", 40)
    monkeypatch.setattr(near, "SLICE", 50)
    monkeypatch.setattr(near, "PART", 60)
    monkeypatch.setattr(near, "LEAST_BLOCK", 1)
    monkeypatch.setattr(near.near_frequencies, "__defaults__", (40, 50))


def made_up(seed):
    """Two files with Ns, poly-A, a sequence too short, and near copies on both strands."""
    rng = random.Random(seed)
    first = "".join(rng.choice("ACGTN" if rng.random() < 0.05 else "ACGT") for _ in range(260)) + "A" * 70

    def near_copy(s):
        return "".join(rng.choice("ACGTN") if rng.random() < 0.03 else c for c in s)

    turned = first[50:200][::-1].translate(str.maketrans("ACGT", "TGCA"))
    return [[("a", first), ("e", "ACG")], [("b", near_copy(first) + near_copy(turned)), ("c", first[100:300])]]


@pytest.mark.parametrize("name", [n for n in CASES if CASES[n][2] == 0])
def test_exact_cases(spark, small, name):
    files, k, _, both, by_file, intervals = CASES[name]
    for span in (4096, 8):
        got = collected(fr._grouped(corpus_of(spark, files, span, 8), k, both, by_file, table(spark, intervals)))
        assert got == brute.frequency(files, k, 0, both, by_file, intervals), span


@pytest.mark.parametrize("k", [1, 31, 32, 101])
def test_kmers_of_several_numbers(spark, small, monkeypatch, k):
    files = made_up(3)
    corpus = corpus_of(spark, files, 128, 100)
    for both, by_file in ((True, False), (False, True)):
        assert collected(fr._grouped(corpus, k, both, by_file, None)) == brute.frequency(files, k, 0, both, by_file)


def test_kmers_with_one_hash_stay_apart(monkeypatch):
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 3, 500).astype(np.uint64) for _ in range(2)]
    monkeypatch.setattr(packed, "hashed", lambda w: np.zeros(len(w[0]), np.uint64))
    by = np.sort(rng.integers(0, 4, 500)).astype(np.int32)
    for keys, found in ((words, packed.Entries(words)), ([*words, by], packed.Entries(words, by))):
        pairs = list(zip(*[x.tolist() for x in keys]))
        assert len(found.first) == len(set(pairs))
        at = found.inverse()
        assert all(pairs[found.first[at[i]]] == pairs[i] for i in range(500))


@pytest.mark.parametrize("k,errors", [(6, 2), (13, 2), (20, 3), (33, 4), (40, 1), (70, 1), (100, 4)])
def test_with_errors(spark, small, k, errors):
    files = made_up(4)
    corpus = corpus_of(spark, files, 128, 100)
    for both in (True, False):
        assert collected(fr._grouped(corpus, k, both, False, None, errors)) == brute.frequency(files, k, errors, both)
    some = [("a", 5, 90), ("c", 0, 20)]
    assert collected(fr._grouped(corpus, k, True, False, table(spark, some), errors)) == brute.frequency(files, k, errors, True, False, some)


def test_counts(spark, small):
    corpus = corpus_of(spark, made_up(5), 128, 100)
    wins = windows.windows(corpus, 7)
    assert sorted(map(tuple, windows.counted(corpus, 7).collect())) == sorted(map(tuple, windows.kmers(wins).collect()))
    by_file = windows.kmers(wins, 1, ("file_id",)).select("kmer", "file_id", "cnt")
    assert sorted(map(tuple, windows.counted(corpus, 7, 1, True).collect())) == sorted(map(tuple, by_file.collect()))
    from kmerscape.operators.packed import different_per_sequence

    want = sorted(map(tuple, wins.groupBy("file_id", "seq_id").agg({"pos": "count"}).collect()))
    for long in (1 << 20, 128):  # all sequences whole, and all in stretches
        got = {(r.file_id, r.seq_id): (r.n, r.different) for r in different_per_sequence(corpus, 7, long).collect()}
        assert sorted((*k, v[0]) for k, v in got.items()) == want
        assert {k: v[1] for k, v in got.items()} == {(r[0], r[1]): r[2] for r in wins.selectExpr("file_id", "seq_id", "kmer").distinct().groupBy("file_id", "seq_id").count().collect()}


def test_sinks_of_chunks(spark, small):
    """Rows by chunk and rows by position give the same lines, where runs cross chunks and where no window starts."""
    files = [*made_up(6), [("n", "N" * 40 + "AC" * 100)]]
    corpus = corpus_of(spark, files, 16, 8)
    by_chunk, by_position = corpus.in_chunks(5).cache(), corpus.frequency(5).cache()
    assert sorted(map(tuple, runs_of_chunks(by_chunk, 16).collect())) == sorted(map(tuple, runs(by_position, "freq").collect()))
    for value in ("mappability", "freq8"):
        for kind in ("bedgraph", "bed", "wig", "txt"):
            made = [sorted(map(tuple, getattr(sinks, kind)(f, corpus.directory, value, 16).collect())) for f in (by_chunk, by_position)]
            assert made[0] == made[1], (kind, value)
        made = [sorted(map(tuple, sinks.raw(f, corpus.directory, value, 64, 16).collect())) for f in (by_chunk, by_position)]
        assert made[0] == made[1], value
    assert sorted(map(tuple, corpus.mappability(5, value="freq8").collect())) == sorted(map(tuple, fr.with_value(fr.dense(by_position, corpus.directory), "freq8").collect()))


def test_arriving_chunks(spark, small, tmp_path):
    files = made_up(7)
    corpus = corpus_of(spark, files[:1], 64, 32)
    other = corpus_of(spark, files, 64, 32)
    other.chunks.write.parquet(str(tmp_path / "in"))
    asked = Against.counted(corpus, 9, str(tmp_path / "counts"))
    stream = spark.readStream.schema(stored.CHUNKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    asked.write(stream, str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination()
    got = collected(asked.read(spark, str(tmp_path / "out")))
    text = {(f, s): t for f, seqs in enumerate(files) for s, (_, t) in enumerate(seqs)}
    turned = str.maketrans("ACGT", "TGCA")
    have = [t[i : i + 9] for _, t in files[0] for i in range(len(t) - 8)]

    def freq(kmer):
        return 0 if "N" in kmer else have.count(kmer) + have.count(kmer[::-1].translate(turned))

    assert got == {(f, s, i): freq(t[i : i + 9]) for (f, s), t in text.items() for i in range(len(t) - 8)}


WHOLE = "mappability_e0 raw_payloads runs selection_e0 txt_lines unique_kmers wig_lines freq_e1_documents freq_e2_documents freq_e3_documents freq_e4_documents bed_selection bedgraph_lines exclude_pseudo_e0 freq16_dense freq8_saturated freq_e0_both freq_e0_palindromes freq_e0_fwd kmer_windows shared_by_all_files kmer_count_by_file kmer_count freq_k101".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", WHOLE)
def test_no_window_is_a_row_of_a_shuffle(spark, monkeypatch, name):
    monkeypatch.setattr(fr, "JOIN_WINDOWS", 0)
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "InArrow" in plan and "substring(raw" not in plan
