"""Quality classifier: nearest-neighbour voting among labelled documents in a latent semantic space.

Features are counts of hashed byte triplets of the whole text, as square roots, and two shares that no count of triplets
tells, as it forgets their order: words equal to the one before, and distinct words. A share is a point between two of BINS
bins, so that the latent space sees it as it sees triplets (the README has figures without either).
A bounded sample of labelled documents (``sample``, those of the smallest hash of doc_id, by a top-k of the labels) gives a truncated
singular value decomposition; the labelled documents' latent vectors are broadcast. Their size is bounded by sample x
rank. The first axis is what all texts share; it would bring the cosines of unlike texts near those of like ones and is left
out. Every document's cosines with all labelled vectors are computed exactly, block by block, and the ``neighbours``
nearest vote with weight exp(sharpness x (cosine - 1)). Nothing but the text enters a score.

Defined cases: null counts as empty; texts without a triplet have no direction and get the sample's share of label 1;
null doc_id is not held out; of repeated labels of a document the largest counts; without labels every score is 0.5;
repeated rows get equal scores; a text of any length is one vector; other columns are never read, and keep() leaves them as
they are; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .flat import flat, mix, release, slices, tidied, word_hashes, words
from .op4_exact_dedup import text_of
from .shared import bounded

TRIPLETS = 2048
SHARES, BINS, SHARE_WEIGHT = 2, 8, 0.5
FEATURES = TRIPLETS + SHARES * BINS
RANK = 48
#: Bound of the labelled sample: its features take SAMPLE x FEATURES x 4 bytes on the driver (32 MB) while it is fitted.
SAMPLE = 4096
NEIGHBOURS = 15
SHARPNESS = 8.0
THRESHOLD = 0.3
#: Documents of one product, and bytes of their texts.
ROWS, SLICE = 1024, 1 << 20


class Model(NamedTuple):
    projection: np.ndarray  # FEATURES x rank
    vectors: np.ndarray  # labelled, unit length
    labels: np.ndarray
    prior: float


def shares(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """n x SHARES: equal neighbours and distinct words; square roots, to tell small shares."""
    n = len(offsets) - 1
    first, end, bounds = words(data, offsets)
    hashes, home = word_hashes(data, first, end), doc[first]
    count = np.maximum(np.diff(bounds), 1)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (home[1:] == home[:-1])
    keys = hashes ^ mix(home.astype(np.uint64))
    order = np.argsort(keys)
    own = keys[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = own[1:] != own[:-1]
    return np.sqrt(np.stack([np.bincount(home[same], minlength=n) / count, np.bincount(home[order][fresh], minlength=n) / count], axis=1))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n x FEATURES float32 of length 1 (0 without a triplet)."""
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES), np.float32)
    if len(data) > 2:
        doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
        wide = data.astype(np.uint32)
        h = wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D)
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(21)
        inside = doc[2:] == doc[:-2]
        counts = np.bincount(doc[:-2][inside] * TRIPLETS + h[inside], minlength=n * TRIPLETS).reshape(n, TRIPLETS)
        total = np.maximum(counts.sum(axis=1), 1)
        out[:, :TRIPLETS] = np.sqrt(counts / total[:, None])
        at = shares(data, offsets, doc).clip(0, 1) * (BINS - 1)
        low = np.minimum(at.astype(np.int64), BINS - 2)
        column, row = TRIPLETS + np.arange(SHARES) * BINS + low, np.arange(n)[:, None]
        out[row, column], out[row, column + 1] = SHARE_WEIGHT * (low + 1 - at), SHARE_WEIGHT * (at - low)
        out[counts.sum(axis=1) == 0] = 0
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(x: np.ndarray, y: np.ndarray, rank: int = RANK) -> Model:
    """The latent space, without its first axis, by subspace iteration from a fixed start."""
    if not len(y):
        return Model(np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), 0.5)
    basis = np.random.default_rng(7).standard_normal((x.shape[1], min(rank + 8, len(x), x.shape[1])))
    for _ in range(6):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, right = np.linalg.svd(x @ basis, full_matrices=False)
    projection = (basis @ right.T)[:, 1 : rank + 1].astype(np.float32)
    return Model(projection, unit(x @ projection).astype(np.float32), y.astype(np.float32), float(y.mean()))


def score(model: Model, x: np.ndarray, neighbours: int = NEIGHBOURS, sharpness: float = SHARPNESS) -> np.ndarray:
    out = np.full(len(x), model.prior)
    k = min(neighbours, len(model.labels))
    if k:
        some = np.flatnonzero(x.any(axis=1))
        cosines = unit(x[some] @ model.projection) @ model.vectors.T
        near = np.argpartition(cosines, -k, axis=1)[:, -k:] if k < cosines.shape[1] else np.broadcast_to(np.arange(k), cosines.shape)
        weight = np.exp(sharpness * (np.take_along_axis(cosines, near, axis=1).astype(np.float64) - 1))
        out[some] = np.clip((weight * model.labels[near]).sum(axis=1) / weight.sum(axis=1), 0, 1)
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Model:
    """A model of at most ``sample`` labelled documents that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("__y")).filter("__id is not null and __y is not null").filter(~held_out(F.col("__id")))
    chosen = known.groupBy("__id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(sample)

    def numbers(batches):
        for part in slices(batches, limit=SLICE, rows=ROWS):
            x = features(*flat(part.column(2)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "y", "x"])

    rows = docs.select(F.col(doc_id).cast("long").alias("__id"), text_of(text).alias("__text")).join(F.broadcast(chosen), "__id").select("__id", "__y", F.col("__text").alias("text"))
    # the limit is in the plan: a document id that many rows repeat doesn't reach the driver more than ``sample`` times
    found = rows.mapInArrow(tidied(numbers), "id long, y int, x binary").orderBy("id", "x").limit(sample).toPandas()
    x = np.frombuffer(b"".join(found["x"]), np.float32).reshape(-1, FEATURES)
    return fit(x, found["y"].to_numpy(np.float32))


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    shared = bounded(spark).sparkContext.broadcast(tuple(model))

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        own, out = Model(*shared.value), [np.zeros(0)]
        for part in slices([pa.RecordBatch.from_arrays([texts], ["text"])], limit=SLICE, rows=ROWS):
            out.append(score(own, features(*flat(part.column(0)))))
        release()
        return pa.array(np.concatenate(out))

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(docs, labels, sample, doc_id, text)
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), score_column(docs.sparkSession, model, text_of(text)).alias("score"))
    return ids.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns, that the classifier doesn't reject."""
    model = train(docs, labels, sample, doc_id, text)
    return docs.filter(score_column(docs.sparkSession, model, text_of(text)) >= threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
