"""Reading sequences and intervals, and writing and reading everything again."""

import pytest

from kmerscape.operators import sinks
from kmerscape.sources import fasta, stored
from kmerscape.sources.corpus import Corpus
from kmerscape.streaming.arrivals import arriving_frequency, canonical_counts

from . import brute
from .test_kmers import FILES, SOME, UNIQUE, collected, corpus_of, table


def rows_of(corpus):
    """Names, lengths and whole sequences."""
    directory, chunks = corpus if isinstance(corpus, tuple) else (corpus.directory, corpus.chunks)
    seqs = {}
    for r in chunks.orderBy("file_id", "seq_id", "chunk_start").collect():
        seqs[r.file_id, r.seq_id] = seqs.get((r.file_id, r.seq_id), "")[: r.chunk_start] + r.bases
    return sorted((r.file_id, r.file_name, r.seq_id, r.seq_name, r.seq_len, seqs[r.file_id, r.seq_id]) for r in directory.collect())


def test_one_file(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text(">one first\nACGT\nacgu\n>empty\n>two second\r\nNRYX-\r\nAC\r\n>three\nA")
    assert rows_of(fasta.read(spark, str(p))) == [(0, "a.fa", 0, "one", 8, "ACGTACGT"), (0, "a.fa", 1, "two", 7, "NNNNNAC"), (0, "a.fa", 2, "three", 1, "A")]
    p.write_text(">x 1\nAC\n>x 2\nGT\n")
    assert [r[3] for r in rows_of(fasta.read(spark, str(p)))] == ["x 1", "x 2"]


def test_many_records_keep_their_order(spark, tmp_path):
    p = tmp_path / "many.fna"
    p.write_text("".join(f">r{i}\n{'ACGT' * (i % 7 + 1)}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = rows_of(fasta.read(spark, str(p)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r[2], r[3], r[5]) for r in got] == [(i, f"r{i}", "ACGT" * (i % 7 + 1)) for i in range(3000)]


def test_directory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.fasta").write_text(">q\nAC\n")
    (tmp_path / "sub/a.fa").write_text(">p\nGG\n")
    (tmp_path / "sub/c.fastq").write_text("@r1 x\nACGT\n+\nIIII\n@r2\nGG\n+\n@I\n")
    (tmp_path / "no.txt").write_text(">z\nAC\n")
    (tmp_path / "none.fa").write_text(">z\n")
    with pytest.warns(UserWarning, match=r"none\.fa"):
        got = rows_of(fasta.read(spark, str(tmp_path), directory=True))
    assert got == [(0, "a.fa", 0, "p", 2, "GG"), (1, "b.fasta", 0, "q", 2, "AC"), (2, "c.fastq", 0, "r1", 4, "ACGT"), (2, "c.fastq", 1, "r2", 2, "GG")]
    (tmp_path / "a.fa").write_text(">p\nGG\n")
    with pytest.raises(ValueError, match="same name"):
        fasta.read(spark, str(tmp_path), directory=True)


def test_fastq(spark, tmp_path):
    """Blank lines lose no record, empty reads are left out, and what is no record raises an error."""
    p = tmp_path / "r.fastq"
    good = ["@r1 a\nACGT\n+\n@III\n", "@r2\nGGN\n+r2\n+II\n", "@r3\nT\n+\n@\n"]
    want = [(0, "r.fastq", 0, "r1", 4, "ACGT"), (0, "r.fastq", 1, "r2", 3, "GGN"), (0, "r.fastq", 2, "r3", 1, "T")]
    for text in ("".join(good), "\n".join(good), "\n\n" + "\r\n".join(good) + "\n\n\n", "".join(good).rstrip("\n"), good[0] + "@none\n\n+\n\n" + good[1] + good[2]):
        p.write_text(text)
        assert rows_of(fasta.read(spark, str(p))) == want, text
    for text in ("@r1\nACGT\n+\nIII\n", "r1\nACGT\n+\nIIII\n", "@r1\nACGT\n-\nIIII\n", "@r1\nACGT\n+\n"):
        p.write_text(text)
        with pytest.raises(Exception, match="not a FASTQ record"):
            rows_of(fasta.read(spark, str(p)))
    p.write_text("".join(f"@r{i}\n{'ACGT' * (i % 5 + 1)}\n+\n{'IIII' * (i % 5 + 1)}\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = rows_of(fasta.read(spark, str(p)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r[2], r[3], r[5]) for r in got] == [(i, f"r{i}", "ACGT" * (i % 5 + 1)) for i in range(2000)]


def test_no_sequences(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ValueError):
        fasta.read(spark, str(tmp_path), directory=True)
    (tmp_path / "a.fa").write_text("")
    with pytest.raises(ValueError):
        fasta.read(spark, str(tmp_path / "a.fa"))


def test_bed(spark, tmp_path):
    p = tmp_path / "s.bed"
    p.write_text("# c\ntrack x\nseq0\t0\t3\tname\t0\nseq 1\t5\t9\r\n\n")
    assert [tuple(r) for r in fasta.read_bed(spark, str(p)).collect()] == [("seq0", 0, 3), ("seq 1", 5, 9)]


def test_save_load_and_write(spark, tmp_path):
    made = corpus_of(spark, FILES)
    made.save(str(tmp_path / "c"))
    with pytest.raises(Exception, match="already exists"):
        made.save(str(tmp_path / "c"))
    corpus = Corpus.load(spark, str(tmp_path / "c"))
    assert rows_of(corpus) == rows_of(made)
    assert corpus.meta().first().asDict() == {"alphabet": "ACGT", "is_directory": True, "n_seq": 6, "max_len": 18, "total_len": 81, "span": 4096, "overlap": 256}
    spark.createDataFrame([("ACGT",)], "alphabet string").write.mode("overwrite").parquet(str(tmp_path / "c/meta"))
    assert Corpus.load(spark, str(tmp_path / "c")).span == 4096  # a key that is absent has its default
    out = tmp_path / "out"
    corpus.write(str(out), 4, value="freq16", formats=("raw", "txt", "wig", "bedgraph", "bed", "csv"))
    want = brute.frequency(FILES, 4, 0)
    for kind in ("txt", "wig", "bedgraph", "bed"):
        for f, text in enumerate(brute.files_of(FILES, want, ["0", "1", "2"], "freq16", kind).values()):
            parts = sorted((out / f"genome{f}.kmers.{kind}").glob("part-*"))
            assert "".join(p.read_text() for p in parts) == text
    assert b"".join(sinks.raw_bytes(spark, str(out / "genome1.kmers.freq16"))) == b"".join(v.to_bytes(2, "little") for v in brute.dense(FILES, want)[1][0])
    assert "".join(p.read_text() for p in sorted((out / "genome2.kmers.chrom.sizes").glob("part-*"))) == "s1\t18\ns2\t12\n"
    first = sorted((out / "genome0.kmers.csv").glob("part-*"))[0].read_text().split("\n")[0]
    assert first == '"k-mer";"+ strand genome0.fa";"+ strand genome1.fa";"+ strand genome2.fa";"- strand genome0.fa";"- strand genome1.fa";"- strand genome2.fa"'
    assert not list(out.glob(".*"))
    for bad in ({"formats": ()}, {"formats": ("gff",)}, {"prefix": "x"}):
        with pytest.raises(ValueError):
            corpus.write(str(out), 4, **bad)
    with pytest.raises(FileExistsError):
        corpus.write(str(out), 4, formats=("bed",))


def test_prefix_of_a_single_file(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nACGTACGT\n")
    Corpus.from_fasta(spark, str(tmp_path / "a.fa")).write(str(tmp_path / "out"), 3, formats=("bed",), prefix="mine")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["mine.kmers.bed"]


def test_files_without_a_selected_interval_have_no_output(spark, tmp_path):
    corpus_of(spark, UNIQUE).write(str(tmp_path), 4, formats=("txt",), exclude_pseudo=True, selection=table(spark, SOME))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["genome0.kmers.txt", "genome2.kmers.txt"]


def test_from_table(spark, tmp_path):
    rows = spark.createDataFrame([("b", 5, "acgtu"), ("a", 7, "xx"), ("a", 8, None), ("a", 9, ""), (None, 3, "gg")], "src string, id long, body string")
    made = Corpus.from_table(rows, "src", "body", "id")
    want = [(0, "", 3, "3", 2, "GG"), (1, "a", 7, "7", 2, "NN"), (2, "b", 5, "5", 5, "ACGTT")]
    assert rows_of(made) == want
    made.save(str(tmp_path / "c"))
    assert rows_of(Corpus.load(spark, str(tmp_path / "c"))) == want


def test_arriving_sequences(spark, tmp_path):
    counts = canonical_counts(corpus_of(spark, FILES), 4)
    corpus_of(spark, FILES).chunks.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(stored.CHUNKS).parquet(str(tmp_path / "in"))
    q = arriving_frequency(stream, counts, 4).writeStream.format("memory").queryName("arrived").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert collected(spark.table("arrived")) == brute.frequency(FILES, 4, 0)
    finally:
        q.stop()
