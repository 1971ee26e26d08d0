"""Packing of tokenized documents into sequences of bounded length.

Shortest-pack-first over the histogram of lengths: lengths are placed longest first, each into the
patterns of packs that are shortest so far, and only counts are updated. The patterns' slots are then joined to the pieces by
their rank among the pieces of one length. The histogram has as many rows as a sequence has tokens at
most, so what the driver holds is bounded whatever the corpus.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize

SEQUENCE_TOKENS, END_ID = 2048, 1
#: Parts of the pieces of one length that are ranked apart: so many at least, and so many pieces in each of them on average.
RANK_BUCKETS, BUCKET_PIECES = 64, 250_000


def public_vocabulary() -> str:
    """Path of the public byte-level BPE tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids of whole texts by a byte-level BPE tokenizer file, as little-endian unsigned 32-bit bytes.

    The ids are those that ``tokenizers`` gives without added special tokens; a special token's string in a text is its id. The text
    between them is encoded by ``tiktoken`` with the vocabulary of the file, in less time.
    """

    def __init__(self, vocabulary: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            file = json.load(f)
        added = {t["content"]: t["id"] for t in file["added_tokens"]}
        byte = _byte_alphabet()
        # a merged token's id is 256 and its merge's rank
        ranks = {bytes(byte[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in added}
        bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._encode = bpe.encode_ordinary
        self._special = {content: array("I", [i]).tobytes() for content, i in added.items()}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None

    def _ids(self, text: str) -> bytes:
        return array("I", self._encode(text)).tobytes()

    def __call__(self, text: str) -> bytes:
        if self._split and any(content in text for content in self._special):
            return b"".join(self._special.get(part) or self._ids(part) for part in self._split(text) if part)
        return self._ids(text)

    @classmethod
    def cached(cls, vocabulary: str) -> Encoder:
        if vocabulary not in _encoders:
            _encoders[vocabulary] = cls(vocabulary)
        return _encoders[vocabulary]


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])


def cut_documents(documents: DataFrame, vocabulary: str | None = None, sequence_tokens: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``sequence_tokens`` ids: doc_id, start, length, ids (little-endian uint32), doc_tokens.

    A document's ids are those of its whole text, then ``end_id``; a null or empty text has the end alone. Repeated
    rows and ids are separate documents; extra columns are ignored; no documents, no pieces.
    """
    vocabulary = vocabulary or public_vocabulary()
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.cached(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encode(text or "") + end
                    n = len(ids) // 4
                    rows += [(doc, s, min(sequence_tokens, n - s), ids[4 * s : 4 * (s + sequence_tokens)], n) for s in range(0, n, sequence_tokens)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, number, offset, first sequence): the pieces of a length with these ranks lie at this offset in consecutive sequences.

    Lengths are placed longest first, each piece into the shortest pack there is if it fits, else into a new one. Packs that are as
    long are runs of sequences: a length goes to as many of them at once as it has pieces, so only counts are updated.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # first sequence and number of packs, by their length
    used: list[int] = []  # a heap of these lengths
    opened = 0

    def put(size: int, first: int, n: int) -> None:
        if n and size < capacity:
            if size not in runs:
                runs[size] = []
                heapq.heappush(used, size)
            runs[size].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left and used and used[0] + length <= capacity:
            size = used[0]
            first, n = runs[size].pop()
            take = min(n, left)
            slots.append((length, rank, take, size, first))
            left, rank = left - take, rank + take
            put(size, first + take, n - take)
            if not runs[size]:
                del runs[size]
                heapq.heappop(used)
            put(size + length, first, take)
        # new packs, each filled with the length before the next one opens
        fits = capacity // length
        full, rest = divmod(left, fits)
        for k in range(fits):
            packs = full + (k < rest)
            if packs:
                slots.append((length, rank, packs, k * length, opened))
                rank += packs
        put(fits * length, opened, full)
        put(rest * length, opened + full, int(rest > 0))
        opened += full + (rest > 0)
    return slots


def place_pieces(pieces: DataFrame, sequence_tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """``pieces`` with sequence_id and offset; needs doc_id, start and length, keeps every other column.

    Pieces of a length are ranked in buckets by a hash of doc_id and start, so that a length that holds most pieces
    is no single group; there are more buckets the more pieces there are. The order is by all columns, so pieces of one rank are alike
    and a task that runs again gives the same ranks. ``pieces`` is read twice: give a written table.
    """
    spark = pieces.sparkSession
    bucket, within, place, before = (fresh(pieces, c) for c in ("bucket", "within", "place", "before"))
    buckets = max(RANK_BUCKETS, -(-pieces.count() // BUCKET_PIECES))
    bucketed = pieces.withColumn(bucket, F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    counts = materialize(bucketed.groupBy("length", bucket).agg(F.count("*").alias("n")), "packing-counts")
    # as many rows as a sequence has tokens at most
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(shortest_pack_first(histogram, sequence_tokens) or [(0, 0, 0, 0, 0)], "slot_length long, first_rank long, packs long, slot_offset long, first_sequence long")
    earlier = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", bucket, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    plain = [c for c, kind in pieces.dtypes if not kind.startswith(("map", "struct", "array", "variant"))]
    order = Window.partitionBy("length", bucket).orderBy("doc_id", "start", *(f"`{c}`" for c in plain))
    ranked = bucketed.withColumn(within, F.row_number().over(order) - 1).join(offsets, ["length", bucket]).withColumn(place, F.col(within) + F.col(before))
    # a few slots for each of the sequence_tokens lengths, whatever the number of pieces
    s = F.broadcast(slots.select(F.struct(*slots.columns).alias(slot := fresh(ranked, "slot"))))
    at = lambda c: F.col(f"{slot}.{c}")
    met = ranked.join(s, (F.col("length") == at("slot_length")) & (F.col(place) >= at("first_rank")) & (F.col(place) < at("first_rank") + at("packs")), "left")
    sequence = F.when(F.col(slot).isNull(), F.raise_error(F.lit("a piece has no slot")).cast("long")).otherwise(at("first_sequence") + F.col(place) - at("first_rank"))
    return met.select(*(F.col(f"`{c}`") for c in pieces.columns), sequence.alias("sequence_id"), at("slot_offset").alias("offset"))


def pack_documents(documents: DataFrame, vocabulary: str | None = None, sequence_tokens: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Cut and place ``documents`` (doc_id, text): doc_id, start, length, ids, doc_tokens, sequence_id, offset; cases as in :func:`cut_documents`."""
    pieces = materialize(cut_documents(documents, vocabulary, sequence_tokens, end_id), "packing-pieces")
    return place_pieces(pieces, sequence_tokens)


def packed_digests(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """As :func:`pack_documents`, with the ids' CRC-32 in place of the ids, which then aren't stored."""
    pieces = cut_documents(documents, vocabulary).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return place_pieces(materialize(pieces, "packing-digests"))
