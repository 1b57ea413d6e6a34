"""Small tables with the cases that every operator must take: nulls, empty and long texts, ties, repeated rows, no rows."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioustrnlé") for _ in range(2 + rng.randrange(vocabulary) % 7)) for _ in range(n))


def texts():
    base = prose(1, 400)
    words = base.split(" ")
    shared = prose(2, 60)
    out = [
        base, base, base + " end", " ".join(words[:200] + ["changed"] + words[201:]), " ".join(words[:100] + words[350:]), "", None, " \n\t ", "x", "a b c d", "a  b\nc\td",
        prose(3, 50) + "\n" + shared + "\n" + prose(4, 50), prose(5, 70) + " " + shared, shared, shared.upper(), "a " * 300, "aaaa" * 200, "aaaa" * 200 + "b", prose(6, 6000), "don't 's '' 9th   x　y ▁z  ▁", "日本語 ß 😀😀 \x00\x01 é" * 3,
        "Hello   world\r\n\r\n  x", "!!" * 50 + " A!! B!!", "<|endoftext|> a<|endoftext|>b", *[prose(10 + i, 30 + 7 * i) for i in range(8)],
    ]
    return out


def rows():
    out = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts())]
    return [*out, (None, base_null(), None, None, None), out[0], out[3]]


def base_null():
    return prose(77, 120)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def unique_docs(spark):
    """Without null or repeated doc_ids."""
    return spark.createDataFrame([r for r in rows()[: len(texts())]], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(unique_docs):
    """Columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    names = ["h", "sid", "a", "n", "marks", "row", "id", "page", "cells", "bucket", "__text2", "score", "class_id", "tkey", "start"]
    return unique_docs.select("*", *[F.lit(i).alias(x) for i, x in enumerate(names)])
