"""Frequencies, locations and encodings against brute force."""

import random
import struct

import pytest

from kmerscape.functions.alphabet import mismatches, packed
from kmerscape.operators import frequency as fr
from kmerscape.operators import locate as lo
from kmerscape.operators import match, sinks, windows
from kmerscape.operators.runs import runs, value_before
from kmerscape.sources import stored
from kmerscape.sources.corpus import Corpus

from . import brute

#: Own sequences, each for a rule: a repeat with its reverse complement, runs of N, palindromes, sequences of K or fewer bases,
#: and several files that share k-mers.
REPEAT = [[("chrom1", "GATTACAGATTACATGTAATCCTGATTACA")]]
UNKNOWN = [[("chrom1", "ACNNGTACGNTTACGNNACGAANN")]]
SHORT = [[("s1", "CAGTCAGTTGACTGAC"), ("s2", "CAGT"), ("s3", "CAG"), ("s4", "GGAATTCCATGGAATT"), ("s5", "T")]]
FILES = [[("s1", "CAGTCAGTTGACTGACAC"), ("s2", "ACA"), ("s3", "TTGACTGGTCAA")], [("s1", "CAGTTGACAAAA")], [("s1", "GGTCAACAGTCAGTTGAC"), ("s2", "ACGTACGTAAAA")]]
UNIQUE = [FILES[0], [("t1", FILES[1][0][1])], [("u1", FILES[2][0][1]), ("u2", FILES[2][1][1])]]
SOME = [("s1", 2, 5), ("s1", 8, 9), ("s3", 0, 12), ("u2", 3, 7)]
MOST = [*SOME, ("u1", 0, 18), ("u2", 0, 12)]
CASES = {
    "one strand": (REPEAT, 5, 0, False, False, None), "both strands": (REPEAT, 5, 0, True, False, None), "N one strand": (UNKNOWN, 3, 0, False, False, None), "N both strands": (UNKNOWN, 3, 0, True, False, None),
    "N costs an error": (UNKNOWN, 4, 1, False, False, None), "N costs an error, both": (UNKNOWN, 4, 2, True, False, None), "N in a selection": (UNKNOWN, 4, 1, True, False, [("chrom1", 1, 6), ("chrom1", 12, 24)]),
    "short sequences": (SHORT, 4, 0, False, False, None), "palindromes": (SHORT, 4, 0, True, False, None), "selection beyond the last window": (SHORT, 4, 0, True, False, [("s1", 0, 3), ("s2", 1, 4), ("s5", 0, 1)]),
    "files": (FILES, 4, 0, True, False, None), "count files": (FILES, 4, 0, True, True, None), "count files, one strand": (FILES, 4, 0, False, True, None), "count files with errors": (FILES, 5, 1, True, True, None),
    "a file without selection": (UNIQUE, 4, 0, True, True, SOME), "nearly all selected": (UNIQUE, 4, 0, True, True, MOST), "all match": (SHORT, 2, 3, True, False, None), "all match, files": (FILES, 2, 2, True, True, None), "intervals that overlap, in any order": (UNKNOWN, 3, 1, True, False, [("chrom1", 9, 18), ("chrom1", 0, 11), ("none", 0, 5), ("chrom1", 3, 3)]),
}


def corpus_of(spark, files, span=4096, overlap=256):
    rows = [(f, f"genome{f}.fa", s, n, t) for f, seqs in enumerate(files) for s, (n, t) in enumerate(seqs)]
    df = spark.createDataFrame(rows, "file_id int, file_name string, seq_id long, seq_name string, seq string")
    chunks = stored.cut(df.filter("seq != ''"), ["file_id", "seq_id"], "seq", span, overlap)
    return Corpus(df.selectExpr("file_id", "file_name", "seq_id", "seq_name", "cast(length(seq) as long) seq_len"), chunks, span, overlap)


def collected(df):
    return {(r.file_id, r.seq_id, r.pos): r.freq for r in df.collect()}


def table(spark, intervals):
    return None if intervals is None else spark.createDataFrame(intervals, "seq_name string, begin long, end long")


def test_frequencies_counted_by_hand():
    spot = lambda t, k, e, both: brute.dense([[("x", t)]], brute.frequency([[("x", t)]], k, e, both))[0][0]
    assert spot("AAAA", 2, 0, False) == [3, 3, 3, 0] and spot("AATT", 2, 0, True) == [2, 2, 2, 0] and spot("ANA", 1, 0, False) == [2, 0, 2]
    assert spot("ACGT", 4, 0, True) == [2, 0, 0, 0] and spot("ACAG", 2, 1, False) == [2, 1, 2, 0]


@pytest.mark.parametrize("name", CASES)
def test_frequency_and_encodings(spark, name):
    files, k, e, both, ep, intervals = CASES[name]
    corpus, names = corpus_of(spark, files), [f"genome{f}.fa" for f in range(len(files))]
    want = brute.frequency(files, k, e, both, ep, intervals)
    freq = corpus.frequency(k, e, both, ep, table(spark, intervals)).cache()
    assert collected(freq) == want
    kept = fr.selected(corpus.directory, table(spark, intervals))
    for value, kinds in (("mappability", ("txt", "bedgraph")), ("freq16", ("wig", "bed"))):
        for kind in kinds:
            got = {n: "" for n in brute.files_of(files, want, names, value, kind, intervals)}
            for r in getattr(sinks, kind)(freq, kept, value).orderBy("file_id", "seq_id", "start").collect():
                got[r.file_name] += r.line + "\n"
            assert got == brute.files_of(files, want, names, value, kind, intervals), (kind, value)
    freq.unpersist()


@pytest.mark.parametrize("name", ["both strands", "N costs an error, both", "palindromes", "files", "count files", "all match"])
def test_locations_and_csv(spark, name):
    files, k, e, both, _, _ = CASES[name]
    corpus, want = corpus_of(spark, files), brute.hits(files, k, e, both)
    found = corpus.locate(k, e, reverse_complement=both).cache()
    got = {(r.file_id, r.seq_id, r.pos): ([tuple(x) for x in r.plus], [tuple(x) for x in r.minus]) for r in lo.nested(found).collect()}
    assert got == want
    lines = {(r.file_id, r.seq_id, r.pos): r.line for r in lo.csv_rows(found, corpus.directory, both).collect()}
    cell = lambda cs, f: "|".join(f"{s},{p}" for g, s, p in cs if g == f)
    assert lines == {c: ";".join([f"{c[1]},{c[2]}", *[cell(h, f) for h in ((p, m) if both else (p,)) for f in range(len(files))]]) for c, (p, m) in want.items()}
    found.unpersist()


@pytest.mark.parametrize("errors", range(5))
@pytest.mark.parametrize("alphabet", ["ACGT", "ACGTN"])
def test_random_sequences(spark, errors, alphabet):
    rng = random.Random(100 * errors + len(alphabet))
    files = [[(f"s{i}", "".join(rng.choice(alphabet) for _ in range(150))) for i in range(3)], [("s0", "".join(rng.choice(alphabet) for _ in range(90)))]]
    for k in {errors + 1 + (errors >= 2), rng.randrange(errors + 2, 9), 40}:
        both, ep = rng.random() < 0.5, rng.random() < 0.5
        assert collected(corpus_of(spark, files, 64, 16).frequency(k, errors, both, ep)) == brute.frequency(files, k, errors, both, ep), (k, both, ep)


@pytest.mark.parametrize("s", [1, 2, 3])
def test_seeds_of_any_number_of_blocks(spark, s):
    rng = random.Random(s)
    kmers = sorted({"".join(rng.choice("ACN") for _ in range(11)) for _ in range(120)})
    df = spark.createDataFrame([(x, 1) for x in kmers], "kmer string, cnt long")
    for errors in (1, 2, 4):
        got = [(r.kmer, r.hit) for r in match.pairs(match.queries_of(df.select("kmer"), False), df, 11, errors, s=s).collect()]
        assert sorted(got) == [(a, b) for a in kmers for b in kmers if brute.mm(a, b) <= errors]


def test_blocks_of_a_seed_grow_with_the_corpus():
    assert match.blocks_per_seed(20, 4, 1000) < match.blocks_per_seed(20, 4, 10**9)
    assert match.blocks_per_seed(5, 4, 10**9) == 1


def test_chunks_do_not_change_windows(spark):
    seq = "".join(random.Random(4).choice("ACGT") for _ in range(1000))
    files = [[("a", seq), ("b", seq[:7]), ("c", seq[:8])]]
    for span, overlap in ((8, 7), (8, 3), (10, 0), (64, 9), (4096, 256)):
        got = sorted((r.seq_id, r.pos, r.kmer) for r in windows.windows(corpus_of(spark, files, span, overlap), 8).collect())
        assert got == [(s, p, t[p : p + 8]) for s, t in enumerate((seq, seq[:7], seq[:8])) for p in range(len(t) - 7)]
    with pytest.raises(ValueError):
        windows.windows(corpus_of(spark, files, 8, 3), 10)


def test_cutting_is_linear(spark):
    import time

    took = []
    for size in (1 << 20, 1 << 23):
        df = spark.range(1).selectExpr("0 file_id", "id seq_id", f"repeat('ACGTTGCA', {size >> 3}) seq")
        best = 1e9
        for _ in range(2):
            began = time.time()
            assert stored.cut(df, ["file_id", "seq_id"]).selectExpr("sum(length(bases))").first()[0] > size
            best = min(best, time.time() - began)
        took.append(best)
    assert took[1] < 12 * took[0] + 1  # eight times the bases


def test_a_hot_kmer_is_dealt_to_many_tasks(spark):
    """Of a corpus that is mostly poly-A, no task joins most windows."""
    from pyspark.sql import functions as F

    corpus = corpus_of(spark, [[("a", "A" * 6000 + "".join(random.Random(5).choice("ACGT") for _ in range(2000)))]], 512, 16)
    plain, dealt = corpus.frequency(8), fr._exact(corpus, 8, True, False, None, share=100, least=100, parts=64)
    assert collected(dealt) == collected(plain)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = [r["count"] for r in fr._exact(corpus, 8, True, False, None, share=100, least=100, parts=64).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) == 4 and max(tasks) < 0.5 * sum(tasks)


def test_mismatches_of_packed_kmers(spark):
    rng = random.Random(9)
    for k in (1, 3, 31, 32, 75):
        rows = []
        for _ in range(200):
            a = [rng.choice("ACGTN") for _ in range(k)]
            b = [rng.choice("ACGTN") if rng.random() < 0.3 else x for x in a]
            rows.append(("".join(a), "".join(b)))
        from pyspark.sql import functions as F

        got = spark.createDataFrame(rows, "a string, b string").select("a", "b", mismatches(packed(F.col("a"), k), packed(F.col("b"), k), k).alias("m")).collect()
        assert all(r.m == brute.mm(r.a, r.b) for r in got)


def test_saturation_and_values(spark):
    df = spark.createDataFrame([(0, 0, i, f) for i, f in enumerate([0, 1, 3, 255, 256, 65535, 70000])], "file_id int, seq_id int, pos long, freq long")
    values = {v: [r.value for r in fr.with_value(df, v).orderBy("pos").collect()] for v in fr.MAX}
    assert values["freq8"] == [0, 1, 3, 255, 255, 255, 255] and values["freq16"] == [0, 1, 3, 255, 256, 65535, 65535]
    assert values["mappability"] == [struct.unpack("f", struct.pack("f", 1 / min(f, 65535) if f else 0))[0] for f in [0, 1, 3, 255, 256, 65535, 70000]]
    assert [r.text for r in sinks.printed(df, "mappability").orderBy("pos").collect()][-1] == "1.5259e-05"
    with pytest.raises(ValueError):
        fr.with_value(df, "freq32")


def test_raw(spark):
    files, k, e, both, ep, intervals = CASES["files"]
    corpus, want = corpus_of(spark, files), brute.frequency(*CASES["files"][:5])
    for value, kind in (("mappability", "f"), ("freq8", "B"), ("freq16", "H")):
        rows = sinks.raw(corpus.frequency(k, e, both, ep), corpus.directory, value, stretch=5).orderBy("file_id", "seq_id", "start").collect()
        for f, seqs in enumerate(brute.dense(files, want)):
            flat = [v for s in seqs for v in s]
            expect = [struct.unpack("f", struct.pack("f", 1 / v))[0] if v else 0 for v in flat] if value == "mappability" else [min(v, fr.MAX[value]) for v in flat]
            assert list(struct.unpack(f"<{len(flat)}{kind}", b"".join(bytes(r.payload) for r in rows if r.file_id == f))) == expect


def test_runs_across_stretches(spark):
    rows = spark.range(60_000, 140_000).selectExpr("0 file_id", "0 seq_id", "id pos", "if(id < 100000, 7, if(id = 120000, 0, 9)) value")
    assert sorted(tuple(r)[2:] for r in runs(rows).collect()) == [(60000, 100000, 7), (100000, 120000, 9), (120001, 140000, 9)]


def test_value_before_across_stretches(spark):
    rows = spark.createDataFrame([(0, 0, 5, 1), (0, 0, 70_000, 2), (0, 0, 70_001, 3), (0, 0, 400_000, 4), (0, 1, 9, 5)], "file_id int, seq_id long, start long, span long")
    assert [r.before for r in value_before(rows, "span", "before").orderBy("seq_id", "start").collect()] == [None, 1, 2, 3, None]


def test_errors_and_statistics(spark):
    corpus = corpus_of(spark, SHORT)
    for bad in (lambda: corpus.frequency(4, 5), lambda: corpus.frequency(0), lambda: corpus.frequency(4, -1), lambda: match.pairs(None, None, 2, 2)):
        with pytest.raises(ValueError):
            bad()
    for interval in (("s2", 4, 5), ("s2", 0, 5), ("s2", 3, 2), ("s2", -1, 2)):
        for ask in (corpus.frequency, corpus.locate, corpus.mappability):
            with pytest.raises(ValueError):
                ask(4, selection=table(spark, [interval]))
    assert tuple(corpus.statistics().first()) == (5, 16, 40 + 5, False)
    assert [r.before for r in corpus.cumulative().orderBy("seq_id").collect()] == [0, 16, 20, 23, 39]
    assert corpus.mappability(4).count() == 40
    assert corpus.mappability(4, selection=table(spark, [("other", 0, 1)])).count() == 0
    assert [tuple(r) for r in corpus_of(spark, UNIQUE).per_file().orderBy("file_id").collect()] == [(0, "genome0.fa", 3, 33), (1, "genome1.fa", 1, 12), (2, "genome2.fa", 2, 30)]
    assert [(r.file_id, round(r.fraction, 4)) for r in windows.selected_fraction(corpus_of(spark, UNIQUE).directory, table(spark, SOME)).orderBy("file_id").collect()] == [(0, round(16 / 33, 4)), (2, round(4 / 30, 4))]
