"""Scoring by a probabilistic suffix tree over words.

A context of one to DEPTH words is a candidate if it occurs LEAST times or more in the training texts, at every size of the corpus, and is
retained if its next-word distribution diverges enough from its parent's (the context without its oldest word; the root is the smoothed
distribution of single words). A retained context's distribution interpolates its counts with its parent's
distribution, and each word is scored in the state of the longest retained suffix of what precedes it.

The tree grows with the corpus and is never in one place. Texts are cut into chunks of about CHUNK words. A chunk asks for what it needs: it sends
the hashes of its different words or word sequences, with their counts in it, to the tasks that own their ranges of hashes, and gets the counts over all
training texts back, in the same order. So it goes length by length; sequences that hold a rarer one aren't asked for. Likewise the chunks send each
context's share of the divergence and get back whether it is retained. A frequent context is one row of each chunk, however often it occurs.

Words and sequences are told apart by 64-bit hashes: among n different ones about n ** 2 / 2 ** 65 pairs are expected to be confused.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path

#: Least count of a context and of an entry.
LEAST = 2
#: Words of the longest contexts.
DEPTH = 3
#: Least log-likelihood gain of a retained context for each of its entries (and one more), and weight of the parent's distribution.
CUTOFF, PARENT_WEIGHT = 2.0, 2.0
#: Additive smoothing of single words.
ADD = 0.1
#: Words of a chunk (a longer text is one chunk), chunks of a bucket, and words of the corpus to a range of hashes (as a power of two).
CHUNK, BUCKET_CHUNKS, RANGE_BITS = 1 << 20, 2, 21
END = b""  # the end token; no word is empty
#: What a chunk asks for: counts of sequences of a length, or whether contexts of a length are retained.
COUNT, RETAIN = 0, 1
_ASKED = "kind int, length int, part int, chunk long, keys binary, numbers binary, sums binary"
_TOLD = "kind int, length int, part int, chunk long, told binary, distinct long"


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text with A-Z lowered, then the end token."""
    words = (text or b"").lower().split()
    words.append(END)
    return words


def _pack_numbers(numbers: np.ndarray) -> bytes:
    """Whole numbers, most of them small: their count, a byte for each, and eight bytes for each that is 255 or more."""
    return np.uint64(len(numbers)).tobytes() + np.minimum(numbers, 255).astype(np.uint8).tobytes() + numbers[numbers >= 255].astype("<i8").tobytes()


def _unpack_numbers(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, "<u8", 1)[0])
    out = np.frombuffer(blob, np.uint8, n, 8).astype(np.int64)
    out[out == 255] = np.frombuffer(blob, "<i8", -1, 8 + n)
    return out


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted different hashes as differences, in as many planes of bytes as the largest one needs."""
    base = keys[0]
    steps = np.diff(keys, prepend=base)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return base.tobytes() + bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpack_keys(blob: bytes) -> np.ndarray:
    base, width = np.frombuffer(blob, "<u8", 1)[0], blob[8]
    planes = np.frombuffer(blob, np.uint8, -1, 9).reshape(width, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :width] = planes.T
    return base + np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a context's hash and a word's."""
    x = context * np.uint64(0x9E3779B97F4A7C15) + word
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the keys in order, equal ones as they come, and the keys in that order.

    Sorts the keys' leading bits together with their places, which takes half the time, unless these bits don't tell all different keys apart.
    """
    if not len(keys):
        return np.zeros(0, np.int64), keys
    low = np.uint64(len(keys).bit_length())
    least, most = keys.min(), keys.max()
    # keys of one range begin with the same bits
    mixed = keys << np.uint64(64 - int(least ^ most).bit_length() if least < most else 0)
    mixed >>= low
    mixed <<= low
    mixed |= np.arange(len(keys), dtype=np.uint64)
    mixed.sort()
    mixed &= (np.uint64(1) << low) - np.uint64(1)
    order = mixed.view(np.int64)
    ranked = keys[order]
    if (ranked[1:] < ranked[:-1]).any():
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
    return order, ranked


def _different(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order, one place of each, and each place's number among them."""
    order, ranked = _order(keys)
    new = np.append(True, ranked[1:] != ranked[:-1])[: len(keys)]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return ranked[new], order[new], number


def cut_chunks(documents: DataFrame, held_out: Column, buckets: int, chunk_words: int = CHUNK) -> DataFrame:
    """Chunks of texts, a written table in buckets by ``chunk``: doc_ids, held_out and n_tokens of its texts, its different words' hashes, the end
    token's first, and every word's number among these, all texts' one after another (as planes of bytes, which compress well)."""
    kind = dict(documents.dtypes)["doc_id"]
    schema = f"chunk long, doc_ids array<{kind}>, held array<boolean>, n_tokens array<long>, hashes binary, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, number, texts, held, docs = TaskContext.get().partitionId() << 33, {END: 0}, [], [], []

        def out() -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
            ids = np.concatenate(texts).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()
            lists = [pa.array([x], pa.list_(t)) for x, t in ((held, pa.bool_()), ([len(t) for t in texts], pa.int64()))]
            doc_ids = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), pa.concat_arrays(docs))
            return pa.RecordBatch.from_arrays([pa.array([chunk]), doc_ids, *lists, pa.array([hashes.tobytes()], pa.binary()), pa.array([ids], pa.binary())], ["chunk", "doc_ids", "held", "n_tokens", "hashes", "ids"])

        size = 0
        for batch in batches:
            for i, (text, out_of) in enumerate(zip(batch.column("text"), batch.column("held"), strict=True)):
                words = tokens(text.as_py())
                for word in words:
                    if word not in number:
                        number[word] = len(number)
                texts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                held.append(out_of.as_py())
                docs.append(batch.column("doc_id").slice(i, 1))
                size += len(words)
                if size >= chunk_words:
                    yield out()
                    chunk, number, texts, held, docs, size = chunk + 1, {END: 0}, [], [], [], 0
        if texts:
            yield out()

    rows = documents.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held"), F.col("text").cast("string").cast("binary").alias("text"))
    spark, path = documents.sparkSession, new_path(documents.sparkSession, "lm-chunks")
    table = f"lm_chunks_{uuid.uuid4().hex}"
    rows.mapInArrow(run, schema).write.bucketBy(buckets, "chunk").options(path=path, compression="zstd").saveAsTable(table)
    return spark.table(table)


class Chunk:
    """One chunk's texts with what it has been told so far."""

    def __init__(self, row: dict, total: int, distinct: int, rounds: int):
        self.rounds = rounds
        self.lengths = np.array(row["n_tokens"], np.int64)
        self.training = np.repeat(~np.array(row["held"], bool), self.lengths)
        self.ids = np.frombuffer(row["ids"], np.uint8).reshape(4, -1).T.copy().view("<i4").ravel().astype(np.int64)
        self.hashes = np.frombuffer(row["hashes"], "<u8")
        self.denominator = total + ADD * (distinct + 1)
        parts: dict[tuple[int, int], list] = {}
        for t in row["told"] or []:
            parts.setdefault((t["kind"], t["length"]), []).append((t["part"], t["told"]))
        self.answers = {k: np.concatenate([_unpack_numbers(blob) for _, blob in sorted(p)]) for k, p in parts.items()}

    def told(self, kind: int, length: int) -> np.ndarray | None:
        """Answers in the order of the keys asked for; None before they are given. Contexts of a length are asked about a round after its counts."""
        return self.answers.get((kind, length), np.zeros(0, np.int64)) if self.rounds > length + (kind == RETAIN) else None

    def walk(self, depth: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """What it asks for next: kind, length, sorted hashes, numbers and sums. At the end it has ``root`` and ``state``, each word's probabilities."""
        keys, _, number = _different(self.hashes)
        place, none = number[self.ids], np.array([], float)
        told = self.told(COUNT, 0)
        if told is None:
            yield COUNT, 0, keys, np.bincount(place[self.training], minlength=len(keys)), none
            return
        count = told >> 1
        self.known = (count > 0)[place]
        self.root = self.state = ((count + ADD) / self.denominator)[place]
        # of each text's first word the context is an end token; no longer context ends in one
        before = np.append(number[0], place[:-1])
        first = np.append(before == number[0], True)
        frequent = (count >= LEAST)[place]
        spots = np.flatnonzero((count >= LEAST)[before])  # positions whose context is frequent, and these contexts' places among the keys
        context = before[spots]
        for length in range(1, depth + 1):
            entry = frequent[spots]  # where the sequence without its oldest word is frequent, too
            here = spots[entry]
            longer, sample, number = _different(_mixed(keys[context[entry]], self.hashes[self.ids[here]]))
            told = self.told(COUNT, length)
            if told is None:
                yield COUNT, length, longer, np.bincount(number[self.training[here]], minlength=len(longer)), none
                return
            n = told >> 1
            kept = np.bincount(context, minlength=len(keys))
            asking = np.flatnonzero(kept)
            often = (n >= LEAST)[number]
            here_often, number = here[often], number[often]
            verdicts = self.told(RETAIN, length)
            if verdicts is None:
                yield RETAIN, length, keys[asking], *self._shares(asking, count, context[entry][sample], self.state[here[sample]], told)
            else:
                kept[asking] = verdicts
                some = kept[context] > 0
                rows, at = spots[some], context[some]
                own = np.zeros(len(place))
                own[here_often] = n[number]
                rest, total = np.maximum(count[at] - (kept[at] - 1), 0), count[at]
                self.state = self.state.copy() if self.state is self.root else self.state
                self.state[rows] = ((rest + PARENT_WEIGHT) * self.state[rows] + own[rows]) / (total + PARENT_WEIGHT)
            frequent = np.zeros(len(place), bool)
            frequent[here_often] = True
            inside = ~first[here_often + 1]
            spots, context, keys, count = here_often[inside] + 1, number[inside], longer, n

    def _shares(self, asking: np.ndarray, totals: np.ndarray, context: np.ndarray, parent: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The divergence test's sums over those entries that this chunk counts in: entries, their counts, their contexts' totals; gains and parents' probabilities."""
        mine = np.flatnonzero((told & 1 == 1) & (told >> 1 >= LEAST))
        n, at, p = told[mine] >> 1, context[mine], parent[mine]
        entries, kept, gain, expected = (np.bincount(at, w, len(totals))[asking] for w in (None, n, n * np.log(n / totals[at] / p), p))
        some = entries > 0
        return np.concatenate([entries, kept[some].astype(np.int64), totals[asking][some]]), np.concatenate([gain[some], expected[some]])


def _reduce(table: pa.Table) -> pa.Table:
    """Counts, or verdicts on contexts, of one range of hashes for every chunk that asks. Of the chunks that ask for a key, one is told to count its entry in."""
    kind, length, part = (table.column(c)[0].as_py() for c in ("kind", "length", "part"))
    asked = [_unpack_keys(k.as_py()) for k in table.column("keys")]
    numbers = [_unpack_numbers(x.as_py()) for x in table.column("numbers")]
    keys = np.concatenate(asked)
    order, ranked = _order(keys)
    starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    sizes = np.diff(np.append(starts, len(keys)))
    distinct = 0
    if kind == COUNT:
        n = np.add.reduceat(np.concatenate(numbers)[order], starts)
        distinct = int((n > 0).sum())
        answer = np.repeat(2 * n, sizes)
        answer[starts] += 1
    else:
        columns = np.zeros((5, len(keys)))
        at = 0
        for k, x, s in zip(asked, numbers, table.column("sums"), strict=True):
            some = at + np.flatnonzero(x[: len(k)])
            columns[0, at : at + len(k)] = x[: len(k)]
            columns[1:3, some] = x[len(k) :].reshape(2, -1)
            columns[3:, some] = np.frombuffer(s.as_py(), "<f8").reshape(2, -1)
            at += len(k)
        entries, kept, _, gain, expected = (np.add.reduceat(c[order], starts) for c in columns)
        total = np.maximum.reduceat(columns[2][order], starts)
        rest = np.maximum(total - kept, 0.0)
        gain = gain + np.where(rest > 0, rest * np.log(np.maximum(rest, 1e-300) / np.maximum(total, 1) / np.maximum(1 - expected, 1e-12)), 0.0)
        answer = np.repeat(np.where((entries > 0) & (gain >= CUTOFF * (entries + 1)), kept + 1, 0).astype(np.int64), sizes)
    told = np.empty(len(keys), np.int64)
    told[order] = answer
    ends = list(accumulate(map(len, asked)))
    blobs = [_pack_numbers(told[end - len(k) : end]) for k, end in zip(asked, ends, strict=True)]
    same = lambda x: pa.array([x] * len(asked), pa.int32())
    return pa.table([same(kind), same(length), same(part), table.column("chunk"), pa.array(blobs, pa.binary()), pa.array([distinct] + [0] * (len(asked) - 1))], ["kind", "length", "part", "chunk", "told", "distinct"])


def _joined(chunks: DataFrame, told: list[DataFrame]) -> DataFrame:
    """Every chunk with what it has been told so far. The chunks stay where their buckets are; only what they are told moves."""
    if not told:
        return chunks.withColumn("told", F.lit(None).cast("array<struct<kind int, length int, part int, told binary>>"))
    rows = told[0]
    for more in told[1:]:
        rows = rows.unionByName(more)
    return chunks.join(rows.groupBy("chunk").agg(F.collect_list(F.struct("kind", "length", "part", "told")).alias("told")), "chunk", "left")


def ask(chunks: DataFrame, told: list[DataFrame], total: int, distinct: int, depth: int, bits: int) -> DataFrame:
    """One round: what all chunks ask for next, and what they are told, a written table."""
    rounds = len(told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - bits)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                for kind, length, keys, numbers, sums in Chunk(row, total, distinct, rounds).walk(depth):
                    if not len(keys):
                        continue
                    parts = (keys >> shift).astype(np.int64)
                    starts = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])[: len(keys)]).tolist()
                    rows, extra = [], numbers[len(keys) :].reshape(2, -1) if kind == RETAIN else None
                    some = np.cumsum(np.append(0, numbers[: len(keys)] > 0))
                    for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
                        own, more = numbers[a:b], b""
                        if extra is not None:
                            x, y = some[a], some[b]
                            own = np.concatenate([own, *extra[:, x:y]])
                            more = np.concatenate([*sums.reshape(2, -1)[:, x:y]]).tobytes()
                        rows.append((kind, length, int(parts[a]), row["chunk"], _pack_keys(keys[a:b]), _pack_numbers(own), more))
                    if rows:
                        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                        yield pa.RecordBatch.from_arrays(columns, ["kind", "length", "part", "chunk", "keys", "numbers", "sums"])

    asked = _joined(chunks, told).select("chunk", "held", "n_tokens", "hashes", "ids", "told").mapInArrow(run, _ASKED)
    path = new_path(chunks.sparkSession, "lm-told")
    asked.groupBy("kind", "length", "part").applyInArrow(_reduce, _TOLD).write.parquet(path, compression="zstd")
    return chunks.sparkSession.read.schema(_TOLD).parquet(path)


def score_chunks(chunks: DataFrame, told: list[DataFrame], total: int, distinct: int, depth: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score and score of every text of the chunks, once they have been told all."""
    kind, rounds = dict(chunks.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">"), len(told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                chunk = Chunk(part.select(["held", "n_tokens", "hashes", "ids", "told"]).to_pylist()[0], total, distinct, rounds)
                for _ in chunk.walk(depth):
                    raise RuntimeError("a chunk wasn't told all that it asked for")
                starts = np.cumsum(chunk.lengths) - chunk.lengths
                known, base, state = (np.add.reduceat(x, starts) for x in (chunk.known.astype(np.int64), np.log10(chunk.root), np.log10(chunk.state)))
                columns = [*(part.column(c).flatten() for c in ("doc_ids", "held", "n_tokens")), pa.array(known), pa.array(base), pa.array(state)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    rows = _joined(chunks, told)
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")


@contextmanager
def _dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Drop each job's shuffle files once its result is written, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def _ranges(words: int) -> int:
    """Bits of a hash that tell its range, so that a range has a bounded share of the corpus' words."""
    return max(1, (words >> RANGE_BITS).bit_length())


def score_corpus(documents: DataFrame, held_out: Column, depth: int = DEPTH, chunk_words: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``documents``.

    The tree is fitted on the rows for which ``held_out`` (of doc_id) is false. A null or empty text is its end token alone. Rows that
    repeat an id are scored each. Without training rows every probability is 1 and the scores are 0. Extra columns are ignored.
    """
    spark = documents.sparkSession
    size = documents.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("b"), F.count("*").alias("n")).first()
    # a word takes two bytes or more of its text, most of them about six
    words = int(size["b"] or 0) // 6 + int(size["n"])
    buckets = min(max(1, words // (chunk_words * BUCKET_CHUNKS)) + spark.sparkContext.defaultParallelism, 100_000)
    with _dropping_shuffles(spark):
        chunks = cut_chunks(documents, held_out, buckets, chunk_words)
        total = F.sum(F.aggregate(F.zip_with("held", "n_tokens", lambda h, n: F.when(h, 0).otherwise(n)), F.lit(0).cast("long"), lambda a, b: a + b))
        total, distinct, told = int(chunks.agg(total).first()[0] or 0), 0, []
        for _ in range(depth + 2):
            told.append(ask(chunks, told, total, distinct, depth, _ranges(words)))
            if len(told) == 1:
                distinct = int(told[0].agg(F.sum("distinct")).first()[0] or 0)
    scored = score_chunks(chunks, told, total, distinct, depth)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
