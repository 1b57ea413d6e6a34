"""URL filter, quality classifier and pipeline."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kmerscape.llm import flat, op2_url_filter, op7_quality

from .conftest import SCHEMA, prose

URLS = [
    "https://a.example.org/es/1", "http://EXAMPLE.org/en/12?x=1", "http://example.org/en/2", "http://badexample.org/es/1", "https://org/x", "https://x.com/fr/2#t", "https://com/de/", "http://x.com/de", "HTTP://WWW.Ä.Com?q=/fr/", "https://shop.com", "https://u@h.org:80/es/://x",
    "no scheme", "", None, "://", "://org/", "http://x.org", "mailto://y.net/a/b", "http://example.org/es/\nx", "a://b://c.org/es/", "http://example.org.evil.net/es/1",
]


def by_hand(url):
    m = re.search(r"://", url or "")
    if not m:
        return "", "", None, None
    rest = url[m.end() :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda x: x[0].lower(), host)
    fits = [(len(t), t, s) for s, t in op2_url_filter.RULES for h, p in [t.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def pages_and_labels(spark):
    pages = [(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0]), (None, URLS[1])]
    pages += [(100 + i, f"http://{'cheap.pills' if i % 3 == 0 else 'www.fine'}.net/{'buy' if i % 6 == 0 else 'read'}/{i}") for i in range(120)]
    labels = [(100 + i, 0 if i % 3 == 0 else 1, 0) for i in range(90)] + [(100, 0, 0), (None, 0, 0), (101, None, None)]
    return pages, spark.createDataFrame(pages, "page_id long, url string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_urls(spark):
    pages, df, labels = pages_and_labels(spark)
    got = op2_url_filter.judge(df, labels).collect()
    assert len(got) == len(pages)
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == Counter((i, *by_hand(u)[:3]) for i, u in pages)
    urls = dict(pages)
    for r in got:
        say = by_hand(urls[r.page_id])[3]
        assert r.verdict == (say or ("block" if "pills" in r.host else "allow")), r


def test_urls_without_labels_or_rows(spark):
    _, df, labels = pages_and_labels(spark)
    got = op2_url_filter.judge(df, labels.limit(0))
    assert got.filter("mined is not null").count() == 0 and got.filter("rule is null and verdict = 'block'").count() == 0
    assert op2_url_filter.judge(df.limit(0), labels).count() == 0
    assert op2_url_filter.judge(df.selectExpr("page_id", "url", "1 row", "2 items", "3 token", "4 best"), labels).count() == df.count()


def all_rules(transactions, support, confidence):
    """{(antecedent, verdict): (confidence, support)} by counting every itemset of every transaction."""
    from itertools import combinations

    n, together, alone = len(transactions), Counter(), Counter()
    for items, bad in transactions:
        for size in range(1, len(items) + 1):
            for s in combinations(sorted(items), size):
                alone[s] += 1
                together[s, "block" if bad else "allow"] += 1
    return {k: (c / alone[k[0]], c / n) for k, c in together.items() if c / n >= support and c / alone[k[0]] >= confidence}


@pytest.mark.parametrize("broadcast_rules", [0, 20_000])
def test_verdicts_are_those_of_all_rules(spark, broadcast_rules):
    """No rule is missed, and pruning changes no verdict: against all itemsets, counted one by one."""
    rng = random.Random(3)
    urls = [f"http://{rng.choice(['a', 'b', 'www.c'])}.{rng.choice(['net', 'info'])}/{rng.choice(['buy', 'read', 'x'])}/{rng.choice(['p', 'q/r', '7'])}" + rng.choice(["", "?k=1"]) for _ in range(160)]
    labels = [(i, int(not ("buy" in u and "net" in u) if rng.random() < 0.9 else rng.random() < 0.5), int(rng.random() < 0.05)) for i, u in enumerate(urls) if i % 3]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    host, path = op2_url_filter.host_and_path(df.url)
    items = {r.page_id: set(r["items"]) for r in df.select("page_id", op2_url_filter.tokens(df.url, host, path).alias("items")).collect()}
    transactions = [(items[i], q == 0 or t == 1) for i, q, t in labels]
    rules = all_rules(transactions, 0.02, 0.6)
    sets, n = op2_url_filter.frequent(spark.createDataFrame([(sorted(i), b) for i, b in transactions], "items array<string>, bad boolean"), 0.02)
    mined = {(tuple(r.antecedent), r.verdict): (r.confidence, r.support) for r in op2_url_filter.rules_of(sets, n, 0.02, 0.6).collect()}
    assert mined.keys() == rules.keys() and all(mined[k] == pytest.approx(rules[k]) for k in rules)
    left = {(tuple(r.antecedent), r.verdict) for r in op2_url_filter.mine(spark.createDataFrame([(sorted(i), b) for i, b in transactions], "items array<string>, bad boolean"), 0.02, 0.6).collect()}
    assert left == {(a, v) for (a, v), (c, _) in rules.items() if not any(set(x) < set(a) and w == v and d >= c for (x, w), (d, _) in rules.items())}
    for r in op2_url_filter.judge(df, known, rules=(), support=0.02, confidence=0.6, broadcast_rules=broadcast_rules).collect():
        fits = [(*rules[k], k[1] == "block", k[1]) for k in rules if set(k[0]) <= items[r.page_id]]
        assert (r.verdict, r.mined) == ((max(fits)[3], pytest.approx(max(fits)[0])) if fits else ("allow", None))


def test_url_columns_that_clash(spark):
    _, df, labels = pages_and_labels(spark)
    names = ["host", "path", "rank", "token", "say", "mined", "rule"]
    more = df.selectExpr("*", *[f"'{n}' {n}" for n in names])
    plain, got = (sorted(map(str, op2_url_filter.judge(x, labels).collect())) for x in (df, more))
    assert got == plain


def corpus(n):
    rng = random.Random(8)
    for i in range(n):
        t = prose(5000 + i, rng.randrange(5, 120))
        bad = i % 4 == 0
        if bad:
            t = rng.choice([lambda t: " ".join(w + "###" for w in t.split(" ")), lambda t: t.upper() + "!!", lambda t: (t.split(" ")[0] + " ") * 60])(t)
        yield i, t, "en", "s", len(t), int(not bad)


def test_quality(spark, no_docs):
    import zlib

    data = list(corpus(600))
    docs = spark.createDataFrame([x[:5] for x in data] + [(9000, "", None, None, 0), (9001, None, None, None, None), (None, "x y", None, None, 3)], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(x[0], x[5], 0) for x in data] + [(3, 0, 0), (None, 1, 0), (4, None, None), (77777, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in op7_quality.classify(docs, labels).collect()}
    assert len(got) == 603
    for d, r in got.items():
        assert r.held_out == (d is not None and zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(got[x[0]].predicted, x[5]) for x in data if got[x[0]].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95
    kept = op7_quality.keep(docs, labels)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, r in got.items() if r.predicted)
    assert op7_quality.classify(docs, labels.limit(0)).filter("score != 0.5").count() == 0
    assert op7_quality.classify(no_docs, labels).count() == 0


def test_held_out_labels_are_not_learnt(spark):
    data = list(corpus(200))
    docs = spark.createDataFrame([x[:5] for x in data], SCHEMA)
    labels = spark.createDataFrame([(x[0], x[5], 0) for x in data], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(op7_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, op7_quality.classify(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_few_labels_of_a_kind_are_enough():
    """Of a kind of bad documents a handful is labelled, fewer than vote; unlike neighbours must not outweigh them."""
    import zlib

    data = list(corpus(60))
    x, y = op7_quality.features(*flat.flat(pa.array([d[1] for d in data]))), np.array([d[5] for d in data])
    learnt = np.array([zlib.crc32(str(d[0]).encode()) % 5 != 0 for d in data])
    model = op7_quality.fit(x[learnt], y[learnt].astype(np.float32))
    assert ((op7_quality.score(model, x) >= op7_quality.THRESHOLD) == y).all()
    for n in (1, 2, 3):
        small = op7_quality.fit(x[:n], y[:n].astype(np.float32))
        assert np.isfinite(small.vectors).all() and ((0 <= op7_quality.score(small, x)) & (op7_quality.score(small, x) <= 1)).all()


def test_neighbours_are_exact():
    rng = np.random.default_rng(0)
    texts = [x[1] for x in corpus(80)]
    x = op7_quality.features(*flat.flat(pa.array(texts)))
    model = op7_quality.fit(x, (rng.random(80) < 0.5).astype(np.float32), rank=10)
    z = x @ model.projection
    for i, s in enumerate(op7_quality.score(model, x)):
        cosines = [float(z[i] @ z[j] / np.linalg.norm(z[i]) / np.linalg.norm(z[j])) for j in range(80)]
        near = sorted(range(80), key=lambda j: -cosines[j])[: op7_quality.NEIGHBOURS]
        weights = [np.exp(op7_quality.SHARPNESS * (cosines[j] - 1)) for j in near]
        assert s == pytest.approx(sum(w * model.labels[j] for w, j in zip(weights, near)) / sum(weights), abs=1e-3)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    from kmerscape.llm import op4_exact_dedup, op9_packing

    from .test_ngram_join import brute as near
    from .test_substring_dedup import brute_words

    data = [x[:5] for x in corpus(60)]
    passage, clean = prose(1, 80), [x for i, x in enumerate(data) if i % 4]
    extra = [(100, clean[0][1]), (101, clean[1][1]), (102, clean[2][1] + " tail"), (103, prose(2, 60) + " " + passage), (104, passage + " " + prose(3, 70)), (105, None), (106, "")]
    docs = spark.createDataFrame(data + [(i, t, None, None, len(t or "")) for i, t in extra], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(x[0], x[5], 0) for x in corpus(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "substring dedup", "packing"]
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{i}"))
        now = spark.read.parquet(str(tmp_path / f"stage{i}"))
        seen.append(now)
        assert i == 4 or now.schema == docs.schema
    kept = [{r.doc_id: r.text for r in s.collect()} for s in seen[:4]]
    assert {d for d in kept[0] if d < 60} == {d for d in range(60) if d % 4}
    texts = {}
    for d, t in kept[0].items():
        texts[t or ""] = max(d, texts.get(t or "", -1))
    assert set(kept[1]) == set(texts.values())
    assert set(kept[2]) == {d for d, c, _ in near(sorted(kept[1].items())) if d == c}
    want = {d: (n, s) for d, _, n, s in brute_words(sorted(kept[2].items()), 35)}
    import hashlib

    assert all((hashlib.sha256(t.encode()).hexdigest() == want[d][1]) if want[d][0] else t == kept[2][d] for d, t in kept[3].items()) and set(kept[3]) == set(want)
    assert any(n for n, _ in want.values())
    pieces = Counter((r.doc_id, r.start, r.ids_crc32) for r in seen[4].collect())
    assert pieces == Counter((r.doc_id, r.start, r.ids_crc32) for r in op9_packing.pack(seen[3]).collect())
    assert op4_exact_dedup.mark(seen[3]).filter("not kept").count() == 0
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in whole.collect()) == pieces


def test_pipeline_on_hard_rows(spark, tmp_path, no_docs):
    """Null and repeated doc_ids, null and empty texts, columns with the operators' own names, and an empty table."""
    import corpus_pipeline

    from .test_ngram_join import brute as near
    from .test_substring_dedup import brute_words

    names = ["page", "words", "id", "key", "body", "marks", "h", "row", "sha"]
    long = prose(31, 30_000)
    table = [(None, long), (None, long), (3, prose(32, 90)), (3, prose(32, 90)), (4, prose(32, 90)), (5, None), (6, ""), (7, prose(33, 40) + " " + prose(34, 50)), (8, prose(34, 50) + " " + prose(35, 40))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), *names) for d, t in table], SCHEMA + ", " + ", ".join(f"`{n}` string" for n in names))
    for name, rows in (("some", docs), ("none", docs.limit(0))):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "some/documents.parquet")), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, now, str(tmp_path / "some")).write.parquet(str(tmp_path / f"stage{i}"))
        now = spark.read.parquet(str(tmp_path / f"stage{i}"))
        assert now.schema == docs.schema
        seen.append([(r.doc_id, r.text) for r in now.collect()])
    assert len(seen[0]) == len(table)  # without labels nothing is rejected
    exact = {t or "": max((d for d, u in table if (u or "") == (t or "") and d is not None), default=None) for _, t in table}
    assert Counter(d for d, _ in seen[1]) == Counter(exact.values())
    assert Counter(d for d, _ in seen[2]) == Counter(d for d, c, _ in near(seen[1]) if d == c)
    want = {d: n for d, _, n, _ in brute_words(seen[2], 35)}
    assert all((t == dict(seen[2])[d]) == (want[d] == 0) for d, t in seen[3]) and sum(want.values()) == 100
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_quality_of_repeated_and_long_rows_and_clashing_columns(spark):
    """A labelled id that many rows repeat reaches the driver as often as the sample allows; other columns stay."""
    data = list(corpus(120))
    names = ["h", "score", "__id", "__y", "x", "id", "y"]
    rows = [(x[0], x[1], *names) for x in data] + [(1, data[1][1], *names)] * 300 + [(500, prose(41, 40_000), *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    labels = spark.createDataFrame([(x[0], x[5], 0) for x in data], "doc_id long, quality int, toxic int")
    assert len(op7_quality.train(docs, labels, sample=50).labels) == 50
    got = op7_quality.classify(docs, labels)
    assert got.count() == len(rows) and got.filter("doc_id = 1").select("score").distinct().count() == 1
    kept = op7_quality.keep(docs, labels)
    assert kept.schema == docs.schema and kept.filter("doc_id = 500").count() == 1
