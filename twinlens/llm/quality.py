"""Quality classification by nearest-neighbour voting over latent-semantic vectors.

A text's terms are its hashed character n-grams, pairs of neighbouring character classes, and bins of its repetition; their weighted
counts are projected by a truncated singular value decomposition that is fitted on a bounded
sample of labelled rows. The sample's vectors are broadcast, every document's exact cosines with them are computed in
blocks, and the nearest neighbours vote with weights that grow with their similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sample import labelled_sample

#: Labelled rows of each class that are sampled at most, latent dimensions, and neighbours that vote.
SAMPLE, DIMENSIONS, NEIGHBOURS = 2048, 48, 25
#: How fast a neighbour's weight falls with its distance from the nearest cosine.
TEMPERATURE = 0.02

#: Character classes: lower case, upper case, other letters' bytes, digits, and each other ASCII character.
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[128:] = 3
_CLASS[ord("0") : ord("9") + 1] = 4
_rest = [b for b in range(9, 127) if not _CLASS[b] and (b >= 32 or b in (9, 10, 13))]
_CLASS[_rest] = np.arange(5, 5 + len(_rest))
N_CLASSES = int(_CLASS.max()) + 1
BINS = 8
#: Bytes of an n-gram, buckets that n-grams are hashed to (a power of 2), and their weight beside the pairs of classes.
NGRAM, BUCKETS, NGRAM_WEIGHT = 4, 2048, 0.5
_STYLE = N_CLASSES * N_CLASSES
N_TERMS = _STYLE + 4 * BINS + BUCKETS
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _bins(share: float) -> np.ndarray:
    """A share as a soft one-hot vector of bins, so that close shares are close."""
    out = np.zeros(BINS)
    at = min(max(share, 0.0), 1.0) * (BINS - 1)
    low = int(at)
    out[low] = 1 - (at - low)
    if low + 1 < BINS:
        out[low + 1] = at - low
    return out


def terms(text: bytes) -> np.ndarray:
    """Term weights of a whole text: square roots of the shares of class pairs and of hashed n-grams with A-Z lowered, and bins of repetition."""
    out = np.zeros(N_TERMS, dtype=np.float32)
    plain = np.frombuffer(text, dtype=np.uint8)
    classes = _CLASS[plain]
    if len(classes) > 1:
        pairs = np.bincount(classes[:-1] * N_CLASSES + classes[1:], minlength=_STYLE)
        out[:_STYLE] = np.sqrt(pairs / (len(classes) - 1))
    n = len(plain) - NGRAM + 1
    if n > 0:
        byte = _LOWER[plain]
        code = byte[:n]
        for k in range(1, NGRAM):
            code = code * np.uint32(257) + byte[k : n + k]
        bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(33 - BUCKETS.bit_length())
        out[-BUCKETS:] = np.sqrt(np.bincount(bucket, minlength=BUCKETS) / n) * NGRAM_WEIGHT
    words = text.split()
    if words:
        n = len(words)
        same = sum(map(bytes.__eq__, words[:-1], words[1:])) / max(n - 1, 1)
        lines = [line for line in text.split(b"\n") if line.strip()]
        shares = (same, len(set(words)) / n, len(set(lines)) / max(len(lines), 1), 1 / (1 + n / 50))
        out[_STYLE : _STYLE + 4 * BINS] = np.concatenate([_bins(s) for s in shares]) * 0.5
    return out


@dataclass
class Votes:
    """What is broadcast: the projection and the sample's vectors, a bounded number of rows."""

    weights: np.ndarray  # terms
    projection: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # sample x dimensions, unit length
    labels: np.ndarray
    class_weights: np.ndarray  # of each row of the sample
    prior: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.weights) @ self.projection
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray, block: int = 256) -> np.ndarray:
        """Share of the votes for label 1, for each row of terms."""
        if not len(self.labels):
            return np.full(len(x), self.prior)
        out = np.empty(len(x))
        for at in range(0, len(x), block):
            cosines = self.latent(x[at : at + block]) @ self.vectors.T
            k = min(NEIGHBOURS, cosines.shape[1])
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            top = np.take_along_axis(cosines, near, axis=1)
            weight = np.exp((top - top.max(axis=1, keepdims=True)) / TEMPERATURE) * self.class_weights[near]
            out[at : at + block] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return out


def _text_terms(documents: DataFrame, extra: list[str]) -> DataFrame:
    """``extra`` columns and the terms as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                packed = pa.array([zlib.compress(terms(t.as_py() or b"").tobytes(), 1) for t in part.column("text")], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in extra), packed], [*extra, "terms"])

    kinds = dict(documents.dtypes)
    return documents.select(*extra, F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in extra) + ", terms binary")


def _singular_vectors(x: np.ndarray, k: int, extra: int = 16, turns: int = 4) -> np.ndarray:
    """The first ``k`` right singular vectors of ``x`` by subspace iteration, which needs no square matrix of the terms."""
    basis = np.random.default_rng(0).standard_normal((x.shape[1], min(k + extra, *x.shape))).astype(np.float32)
    for _ in range(turns):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, inner = np.linalg.svd(x @ basis, full_matrices=False)
    return (basis @ inner.T)[:, :k]


def fit(documents: DataFrame, labels: DataFrame, learn: Column, per_class: int = SAMPLE, dimensions: int = DIMENSIONS) -> Votes:
    """Fit on a sample of ``labels`` (doc_id, quality); without any, every score is 0.5."""
    sample, sizes = labelled_sample(documents, labels, "quality", learn, per_class)
    rows = _text_terms(sample, ["h", "y"]).orderBy("y", "h").collect()
    y = np.array([r["y"] for r in rows], dtype=np.int64)
    if not len(y):
        return Votes(np.ones(N_TERMS), np.zeros((N_TERMS, 1)), np.zeros((0, 1)), np.zeros(0), np.zeros(0), 0.5)
    # single precision, and only terms that occur: the driver holds little
    x = np.empty((len(rows), N_TERMS), dtype=np.float32)
    for i, row in enumerate(rows):
        x[i] = np.frombuffer(zlib.decompress(row["terms"]), dtype=np.float32)
    del rows
    texts_with = np.count_nonzero(x, axis=0)
    weights = np.log((1 + len(x)) / (1 + texts_with)) + 1
    used = np.flatnonzero(texts_with)
    projection = np.zeros((N_TERMS, min(dimensions, len(used), len(x))), dtype=np.float32)
    projection[used] = _singular_vectors(x[:, used] * weights[used].astype(np.float32), projection.shape[1])
    votes = Votes(weights, projection, np.zeros((0, 1)), y, np.zeros(0), 0.5)
    votes.vectors = np.concatenate([votes.latent(x[at : at + 512]) for at in range(0, len(x), 512)])
    # sampled classes count as often as they occur
    share = {c: sizes[c] / max((y == c).sum(), 1) for c in sizes}
    most = max(share.values())
    votes.class_weights = np.array([share[int(c)] / most for c in y])
    return votes


def score(spark: SparkSession, votes: Votes, text: Column) -> Column:
    """The votes' share for label 1, of whole texts; what is broadcast is as large as the sample."""
    shared = spark.sparkContext.broadcast(votes)

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        blocks = (texts.slice(at, 256) for at in range(0, len(texts), 256))
        out = [shared.value.score(np.stack([terms(t.as_py() or b"") for t in block])) for block in blocks]
        return pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

    return scores(text.cast("string").cast("binary"))


def classify(documents: DataFrame, labels: DataFrame, held_out: Column, per_class: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``documents`` (doc_id, text).

    Labels are learnt only from rows for which ``held_out`` (of doc_id) is false. A null or empty text is scored
    like any other; repeated rows are each scored; extra columns are ignored; without labels every score is 0.5.
    """
    votes = fit(documents, labels, ~held_out, per_class)
    scored = documents.select("doc_id", held_out.alias("held_out"), score(documents.sparkSession, votes, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, learn: Column, per_class: int = SAMPLE) -> DataFrame:
    """``documents``, with all their columns, that score 0.5 or more.

    Null and empty texts are scored like any other and stay or go by their score; repeated rows fare alike; columns may have any names and kinds.
    Without labels every score is 0.5 and all rows stay; an empty table gives no rows.
    """
    votes = fit(documents, labels, learn, per_class)
    return documents.where(score(documents.sparkSession, votes, F.col("text")) >= 0.5)
