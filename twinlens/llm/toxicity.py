"""Toxicity by subword bags.

A word is the bag of its character n-grams, hashed to a fixed number of vectors, so misspelt words
share vectors with the words they stem from. A passage's vectors are averaged into a linear softmax; vectors and
softmax are trained jointly in numpy on a bounded sample of labelled texts. A text is as toxic as its most
toxic passage: of toxic texts the passage that scores highest is learnt, of clean texts the ones
that score highest and others.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sample import labelled_sample

#: Labelled rows of each class that are sampled at most, n-gram vectors and their size, bytes of an n-gram, words of a passage.
SAMPLE, BUCKETS, DIMENSIONS, NGRAMS, PASSAGE_WORDS = 2048, 1 << 18, 8, (3, 5, 7, 8), 48
#: A bag counts each n-gram once and is filled up with zero vectors to this size, so that a few words repeated stay as weak as they are.
LEAST_BAG = 256
ROUNDS, EPOCHS, RATE, BATCH, SEED = 4, 3, 2.0, 128, 11
#: A round takes so many steps at least, however small the sample.
LEAST_STEPS = 80
#: Where squared gradients start: the larger, the less one text alone can move the vectors of rare n-grams.
START = 1e-7
#: An n-gram has a vector if it is in so many sampled texts; passages of a clean text that a round learns at most.
LEAST_TEXTS, CLEAN_PASSAGES = 3, 4

#: Bytes of words (letters, digits, bytes of other scripts and the at sign) stand for themselves, others for a space.
_PLAIN = np.full(256, 32, dtype=np.uint32)
_IN_WORDS = [*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), ord("@"), *range(128, 256)]
_PLAIN[_IN_WORDS] = _IN_WORDS
_MIX, _LAST, _SHIFT, _TOP = np.uint32(0x01000193), np.uint32(0x9E3779B1), np.uint32(15), np.uint32(32 - BUCKETS.bit_length() + 1)


def subwords(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of the n-grams of a whole text, the passage that each lies in, and the number of passages.

    N-grams lie in one word each and may take in the space on either side. Passages are nearly equal numbers of
    words; each bucket counts once in a passage.
    """
    byte = _PLAIN[np.frombuffer(b" " + text.lower().encode() + b" ", dtype=np.uint8)]
    word = byte != 32
    begins = word[1:] & ~word[:-1]
    words = int(np.count_nonzero(begins))
    if not words:
        return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int32), 1
    passages = max(1, round(words / PASSAGE_WORDS))
    # the passage of the word that each byte, but for the first, is in or comes after
    place = (np.cumsum(begins) - 1) * passages // words
    place = place.astype(np.int32 if passages * BUCKETS < 1 << 31 else np.int64) * BUCKETS
    code, inner, found = byte[:-1] * _MIX + byte[1:], word[1:-1], []
    for n in range(3, max(NGRAMS) + 1):
        last = len(byte) - n + 1
        if last <= 0:
            break
        code = (code[:last] ^ (code[:last] >> _SHIFT)) * _MIX + byte[n - 1 :]
        if n > 3:
            inner = inner[:last] & word[n - 2 : n - 2 + last]
        if n in NGRAMS:
            # an n-gram's second byte is in a word always
            bucket = ((code * _LAST) >> _TOP).astype(place.dtype)
            found.append((bucket + place[:last])[inner])
    both = np.sort(np.concatenate(found))
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return both % BUCKETS, both // BUCKETS, passages


@dataclass
class Subwords:
    """A fitted model: the softmax's difference of logits for each n-gram vector, and its bias."""

    table: np.ndarray
    bias: float

    def passages(self, text: str) -> np.ndarray:
        """Logit of each passage."""
        ids, at, n = subwords(text)
        return np.bincount(at, weights=self.table[ids], minlength=n) / np.maximum(np.bincount(at, minlength=n), LEAST_BAG) + self.bias

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.passages(text).max(), -40, 40))))


def _train(bags: list[tuple[np.ndarray, int]], y: np.ndarray, rng: np.random.Generator, state: dict) -> None:
    """Adagrad over mini-batches of bags; ``state`` holds vectors, softmax and their squared gradients."""
    vectors, squares, weights, wsquares = state["vectors"], state["squares"], state["weights"], state["wsquares"]
    balance = np.array([len(y) / 2 / max((y == c).sum(), 1) for c in (0, 1)])
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(bags)) if bags else 0)):
        order = rng.permutation(len(bags))
        for s in range(0, len(order), BATCH):
            some = order[s : s + BATCH]
            some = some[[len(bags[i][0]) > 0 for i in some]]
            if not len(some):
                continue
            counts, sizes = np.array([len(bags[i][0]) for i in some]), np.array([bags[i][1] for i in some])
            ids, back = np.unique(np.concatenate([bags[i][0] for i in some]), return_inverse=True)
            of = np.repeat(np.arange(len(some)), counts)
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            hidden = np.add.reduceat(vectors[ids][back], starts, axis=0) / sizes[:, None]
            full = np.concatenate([hidden, np.ones((len(some), 1))], axis=1)
            logits = full @ weights
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p *= balance[y[some]][:, None] / len(some)
            up = (p @ weights[:-1].T) / sizes[:, None]
            grad = np.stack([np.bincount(back, weights=up[of, d], minlength=len(ids)) for d in range(vectors.shape[1])], axis=1)
            squares[ids] += grad**2
            vectors[ids] -= RATE * grad / np.sqrt(squares[ids] + START)
            wgrad = full.T @ p
            wsquares += wgrad**2
            weights -= RATE * wgrad / np.sqrt(wsquares + 1e-10)


def train(texts: list[str], labels: list[int], seed: int = SEED) -> Subwords:
    """Fit on labelled texts. Without both classes every text gets the score of the one there is, or 0.5."""
    y = np.array(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        return Subwords(np.zeros(BUCKETS, dtype=np.float32), (4.0 if labels[0] else -4.0) if labels else 0.0)
    rng = np.random.default_rng(seed)
    state = {
        "vectors": rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32),
        "squares": np.zeros((BUCKETS, DIMENSIONS), dtype=np.float32),
        "weights": np.concatenate([rng.uniform(-0.5, 0.5, (DIMENSIONS, 2)), np.zeros((1, 2))]),
        "wsquares": np.zeros((DIMENSIONS + 1, 2)),
    }
    texts_with, occurs = np.zeros(BUCKETS, dtype=np.int32), np.zeros(BUCKETS, dtype=np.int64)
    for text in texts:
        ids, _, _ = subwords(text)
        counts = np.bincount(ids, minlength=BUCKETS)
        occurs += counts
        texts_with += counts > 0
    common = texts_with >= LEAST_TEXTS
    state["vectors"][~common] = 0
    # the n-grams of all passages lie in one array of known size, so the driver holds them once; a bag's size counts all its n-grams
    flat, end, parts = np.empty(int(occurs[common].sum()), dtype=np.int32), 0, []
    for text in texts:
        ids, at, n = subwords(text)
        ok = common[ids]
        sizes, own = np.bincount(at, minlength=n), np.bincount(at[ok], minlength=n)
        parts.append((own, np.maximum(sizes, LEAST_BAG), sizes > 0))
        begin, end = end, end + int(own.sum())
        flat[begin:end] = ids[ok]
    ends = iter(np.split(flat, np.cumsum(np.concatenate([own for own, _, _ in parts]))[:-1]))
    parts = [[(bag, int(size)) for bag, size, ok in zip(islice(ends, len(own)), sizes, some, strict=True) if ok] for own, sizes, some in parts]

    def model() -> Subwords:
        difference = state["weights"][:, 1] - state["weights"][:, 0]
        return Subwords((state["vectors"] @ difference[:-1]).astype(np.float32), float(difference[-1]))

    for k in range(ROUNDS):
        bags, kinds, now = [], [], model()
        for own, label in zip(parts, y, strict=True):
            if not own:
                continue
            if not k and label:  # a whole toxic text first, as the passage isn't known yet
                ids = np.unique(np.concatenate([p for p, _ in own]))
                chosen = [(ids, max(len(ids), LEAST_BAG))]
            else:
                ranked = sorted(own, key=lambda p: -float(now.table[p[0]].sum() / p[1])) if k else own
                chosen = ranked[:1] if label else ranked[: CLEAN_PASSAGES // 2] + [ranked[i] for i in rng.integers(0, len(ranked), CLEAN_PASSAGES // 2)]
            bags += chosen
            kinds += [int(label)] * len(chosen)
        _train(bags, np.array(kinds), rng, state)
    return model()


def fit(documents: DataFrame, labels: DataFrame, learn: Column, per_class: int = SAMPLE) -> Subwords:
    """Fit on a sample of at most ``per_class`` rows of each class of ``labels`` (doc_id, toxic)."""
    sample, _ = labelled_sample(documents, labels, "toxic", learn, per_class)
    rows = sample.orderBy("y", "h").collect()
    return train([r["text"] for r in rows], [r["y"] for r in rows])


def score(spark: SparkSession, model: Subwords, text: Column) -> Column:
    """Scores of whole texts; the model's size is fixed."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(t.as_py() or "") for t in texts], pa.float64())

    return scores(text.cast("string"))


def classify(documents: DataFrame, labels: DataFrame, held_out: Column, per_class: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``documents`` (doc_id, text).

    Labels are learnt only from rows for which ``held_out`` (of doc_id) is false. A null or empty text has no passages
    and gets the bias alone; repeated rows are each scored; extra columns are ignored; without labels every score is 0.5.
    """
    model = fit(documents, labels, ~held_out, per_class)
    scored = documents.select("doc_id", held_out.alias("held_out"), score(documents.sparkSession, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(documents: DataFrame, labels: DataFrame, learn: Column, per_class: int = SAMPLE) -> DataFrame:
    """``documents``, with all their columns, without those that score 0.5 or more.

    Null and wordless texts get the bias alone and stay unless the model finds such texts toxic; repeated rows fare alike; columns may have any names
    and kinds. Without labels nothing is known to be toxic and all rows stay; an empty table gives no rows.
    """
    model = fit(documents, labels, learn, per_class)
    if not model.bias and not model.table.any():
        return documents
    return documents.where(score(documents.sparkSession, model, F.col("text")) < 0.5)
