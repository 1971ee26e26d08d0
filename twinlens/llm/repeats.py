"""Removal of passages that occur in earlier documents, decided by suffix arrays.

Texts are bytes. A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id. Only strings that may repeat are sorted:

1. A string's anchor is the least of the hashes of its runs of GRAM bytes, so equal strings have equal anchors at the same place. Neighbouring strings that share an anchor are one context,
   about 18 strings in 67 bytes. Texts lie in chunks; each asks the owners of ranges of hashes which of its anchors occur in other documents, too.
2. For those the chunks name their different contexts by 64 bits of their own beside the anchor's. A context that is the only one of its anchor has no string to be told from any other, so its
   owner answers with its smallest document. Of any other it picks one chunk to send its bytes.
3. Contexts that share an anchor meet, each once. Their suffix array (:mod:`suffixes`) puts equal strings side by side, which gives each string the smallest document that it
   starts in. Every chunk is told these for its contexts, as few runs of strings, and marks the bytes that go.

Nothing is gathered by a key without a bound: a chunk asks for an anchor, or names a context, once. An anchor that occurs over MANY times names its contexts to the owners of the
contexts' hashes instead, and one with more than that, or over CROWD different contexts, is left to its strings: each chunk names a string once, by two hashes of 64 bits, to the owner of
the first, who tells its smallest document. So what one task gets for one key grows with the number of chunks at most, by some 24 bytes each. Chunks stay where their buckets are; only what they
ask and are told moves.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path, scratch
from .lm import _different, _dropping_shuffles, _order, _pack_keys, _pack_numbers, _unpack_keys, _unpack_numbers
from .suffixes import BYTES, END, GAP, _ranges, suffix_arrays

#: Bytes of a string that counts as repeated.
LENGTH = 50
#: Bytes of a chunk (a longer text is one chunk), chunks of a bucket, and anchors of the corpus to a range of hashes (as a power of two).
CHUNK, BUCKET_CHUNKS, RANGE_BITS = 6 << 20, 2, 20
#: Occurrences of an anchor, and different contexts of one, beyond which strings are looked up one by one.
MANY, CROWD = 1 << 20, 128
#: Strings whose anchors are found at once, and symbols whose suffixes are sorted at once, unless one anchor has more.
STEP, SORTED = 1 << 19, 1 << 20
#: Bytes of questions that leave a chunk together, unless one has more; a chunk asks every range, so single ones would be as many batches as chunks times ranges.
SENT = 1 << 20
#: What chunks ask for: which anchors are shared, which contexts to send, and the smallest documents of the contexts' strings and of single strings.
SHARED, SENDERS, CONTEXTS, STRINGS = range(4)
#: What becomes of a context: it is its anchor's only one, this chunk sends it, its strings go one by one, another chunk sends it.
ALONE, SEND, SPLIT, AWAIT = range(4)
_ASKED = "kind int, part long, chunk long, keys binary, own binary, docs binary, many binary, sizes binary, texts binary"
_TYPES = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6]
_TOLD = "kind int, part long, chunk long, told binary"


def _cut(documents: DataFrame, buckets: int, chunk_bytes: int) -> DataFrame:
    """Chunks of texts, a written table in buckets by ``chunk``: doc_ids, sizes and text of its documents, one after another."""
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, ids, texts, size = TaskContext.get().partitionId() << 33, [], [], 0

        def out() -> pa.RecordBatch:
            lists = [pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), pa.concat_arrays(ids)), pa.array([[len(t) for t in texts]], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([chunk]), *lists, pa.array([b"".join(texts)], pa.binary())], ["chunk", "doc_ids", "sizes", "text"])

        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                ids.append(batch.column("doc_id").slice(i, 1))
                texts.append(text.as_py())
                size += len(texts[-1]) + 64
                if size >= chunk_bytes:
                    yield out()
                    chunk, ids, texts, size = chunk + 1, [], [], 0
        if texts:
            yield out()

    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    spark, name = documents.sparkSession, f"repeats_{uuid.uuid4().hex}"
    written = rows.mapInArrow(run, f"chunk long, doc_ids array<{kind}>, sizes array<long>, text binary").write.bucketBy(buckets, "chunk")
    written.options(path=new_path(spark, "repeats-chunks"), compression="zstd", **{"parquet.compression.codec.zstd.level": "6"}).saveAsTable(name)
    table = spark.table(name)
    table.schema  # noqa: B018  resolved before its name goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return table


def _words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a whole number."""
    out = np.empty(max(len(text) - 7, 0), "<u8")
    for k in range(min(8, len(out))):
        out[k::8] = np.frombuffer(text, "<u8", (len(text) - k) // 8, k)
    return out


def _context_hashes(text: np.ndarray, first: np.ndarray, sizes: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """64 bits of each stretch of at least 8 bytes, its size and its seed: word after word, the last one ending with the stretch."""
    words, steps = _words(text), (sizes + 7) // 8
    order = np.argsort(-steps, kind="stable")  # those with most words first, so that those left are the first ones
    start, last, steps = first[order], (first + sizes - 8)[order], steps[order]
    h = (seed[order].astype(np.uint64) << np.uint64(32)) ^ sizes[order].astype(np.uint64)
    for k in range(int(steps[0]) if len(steps) else 0):
        n = int(np.searchsorted(-steps, -k))  # rows with over k words
        one = words[np.minimum(start[:n] + 8 * k, last[:n])] * np.uint64(0x87C37B91114253D5)
        one ^= one >> np.uint64(31)
        one *= np.uint64(0x4CF5AD432745937F)
        mixed = (h[:n] ^ one) * np.uint64(0x9FB21C651E98DF25)
        mixed ^= mixed >> np.uint64(28)
        h[:n] = mixed * np.uint64(0xFF51AFD7ED558CCD)
        h[:n] ^= h[:n] >> np.uint64(33)
    out = np.empty(len(h), np.uint64)
    out[order] = h
    return out


def anchors(text: np.ndarray, valid: np.ndarray, length: int) -> list[np.ndarray]:
    """Contexts of the strings that start at ``valid`` places: their anchors' hashes, first starts, numbers of strings, and the anchors' places after the first start."""
    gram = max(8, min(16, length // 3))
    width, mask = length - gram + 1, np.uint64((1 << (STEP + length).bit_length()) - 1)
    found: list[list[np.ndarray]] = [[], [], [], []]
    for start in range(0, max(len(text) - length + 1, 0), STEP):
        end = min(start + STEP, len(text) - length + 1)
        at = np.flatnonzero(valid[start:end])
        if not len(at):
            continue
        words = _words(text[start : end + length - 1])
        hashes = words[: len(words) - gram + 8] * np.uint64(0x9E3779B97F4A7C15)
        hashes += words[gram - 8 :]
        hashes *= np.uint64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> np.uint64(32)
        least = hashes & ~mask
        least |= np.arange(len(hashes), dtype=np.uint64)  # of equal ones the first
        done = 1
        while done < width:  # least of the next 2, 4, 8, ... places
            step = min(done, width - done)
            least = np.minimum(least[:-step], least[step:])
            done += step
        anchor = (least[at] & mask).astype(np.int64)
        new = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        first = at[new]
        # the least hashes begin with zeros: multiplied, they are spread over all ranges
        spread = hashes[anchor[new]] * np.uint64(0x9E3779B97F4A7C15)
        for column, more in zip(found, (spread, start + first, np.diff(np.append(new, len(at))), anchor[new] - first), strict=True):
            column.append(more)
    return [np.concatenate(c) if c else np.zeros(0, np.uint64 if not i else np.int64) for i, c in enumerate(found)]


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _planes(numbers: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, which compress well."""
    return numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(blob: bytes, at: int = 0) -> np.ndarray:
    return np.frombuffer(blob, np.uint8, -1, at).reshape(8, -1).T.copy().view("<i8").ravel()


def _pieces(heads: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Start and end of each run of rows."""
    return zip(heads.tolist(), np.append(heads, n)[1:].tolist(), strict=True)


class Chunk:
    """A chunk's texts, with what it has been told so far."""

    def __init__(self, row: dict, length: int, bits: int):
        self.chunk, self.length, self.shift = row["chunk"], length, np.uint64(64 - bits)
        self.bytes, sizes = row["text"], np.array(row["sizes"], np.int64)
        self.text, self.ends = np.frombuffer(self.bytes, np.uint8), np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.ids = np.array([0 if i is None else i for i in row["doc_ids"]], np.int64)
        self.known = np.array([i is not None for i in row["doc_ids"]], bool)
        told: dict[int, list] = {}
        for t in row["told"] or []:
            told.setdefault(t["kind"], []).append((t["part"], t["told"]))
        self.told = {k: [blob for _, blob in sorted(v)] for k, v in told.items()}

    def _contexts(self) -> None:
        valid = np.zeros(len(self.text), bool)
        for start, end, known in zip(self.starts.tolist(), self.ends.tolist(), self.known.tolist(), strict=True):
            if known and end - start >= self.length:
                valid[start : end - self.length + 1] = True
        self.hash, self.first, self.n, self.place = anchors(self.text, valid, self.length)
        self.row = np.searchsorted(self.ends, self.first, side="right")

    def _parts(self, parts: np.ndarray, rows: Callable[[slice], list[bytes]], kind: int) -> Iterator[list]:
        """A row for each part of sorted questions."""
        for a, b in _pieces(_heads(parts), len(parts)):
            yield [kind, int(parts[a]), self.chunk, *rows(slice(a, b))]

    def ask_shared(self) -> Iterator[list]:
        self._contexts()
        order, ranked = _order(self.hash)
        heads = _heads(ranked)
        if len(heads):
            # how many documents of this chunk have it
            others = np.zeros(len(ranked), np.int64)
            others[_heads(ranked, self.row[order])] = 1
            counts, keys = np.add.reduceat(others, heads), ranked[heads]
            yield from self._parts((keys >> self.shift).astype(np.int64), lambda s: [_pack_keys(keys[s]), None, None, _pack_numbers(counts[s]), None, None], SHARED)

    def _pairs(self) -> None:
        """The different contexts of shared anchors, sorted as they are asked for, and each place's number among them."""
        self._contexts()
        _, _, number = _different(self.hash)
        verdict = np.concatenate([np.frombuffer(b, np.uint8) for b in self.told.get(SHARED, [])] or [np.zeros(0, np.uint8)])[number]
        some = np.flatnonzero(verdict)
        self.hash, self.first, self.n, self.place, self.row = (x[some] for x in (self.hash, self.first, self.n, self.place, self.row))
        many = verdict[some] == 2
        own = _context_hashes(self.text, self.first, self.n + self.length - 1, self.place)
        part = (np.where(many, own, self.hash) >> self.shift).astype(np.int64) * 2 + many
        order = np.lexsort((own, self.hash, part))
        heads = _heads(part[order], self.hash[order], own[order])
        self.number = np.empty(len(some), np.int64)
        self.number[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
        self.pick = order[heads]  # an occurrence of each
        self.pair_part, self.pair_hash, self.pair_own, self.pair_many = part[self.pick], self.hash[self.pick], own[self.pick], many[self.pick]
        self.pair_doc = np.minimum.reduceat(self.ids[self.row[order]], heads) if len(heads) else np.zeros(0, np.int64)

    def ask_senders(self) -> Iterator[list]:
        self._pairs()
        columns = lambda s: [_pack_keys(self.pair_hash[s]), self.pair_own[s].tobytes(), _planes(self.pair_doc[s]), None, None, None]
        yield from self._parts(self.pair_part, columns, SENDERS)

    def _verdicts(self) -> None:
        self._pairs()
        codes, least = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
        for blob in self.told.get(SENDERS, []):
            n = int(np.frombuffer(blob, "<u8", 1)[0])
            codes.append(np.frombuffer(blob, np.uint8, n, 8))
            least.append(_from_planes(blob, 8 + n))
        self.verdict, self.alone_least = np.concatenate(codes), np.concatenate(least)
        # strings one by one: their places, and for each different one the smallest document here
        some = np.flatnonzero(self.verdict[self.number] == SPLIT)
        self.string_at = _ranges(self.first[some], self.n[some])
        self.string_row = np.repeat(self.row[some], self.n[some])
        view, length = memoryview(self.bytes), self.length
        digests = b"".join(xxhash.xxh3_128_digest(view[a : a + length]) for a in self.string_at.tolist())
        both = np.frombuffer(digests, "<u8").reshape(-1, 2).T
        order = np.lexsort((both[1], both[0]))
        heads = _heads(*(b[order] for b in both))
        self.string_number = np.empty(len(order), np.int64)
        self.string_number[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
        self.string_pick = order[heads]
        self.string_hash, self.string_own = (b[self.string_pick] for b in both)
        self.string_doc = np.minimum.reduceat(self.ids[self.string_row[order]], heads) if len(heads) else np.zeros(0, np.int64)

    def send(self) -> Iterator[list]:
        self._verdicts()
        asked, more = np.flatnonzero((self.verdict == SEND) | (self.verdict == AWAIT)), self.length - 1
        first, sizes = self.first[self.pick[asked]], np.where(self.verdict[asked] == SEND, self.n[self.pick[asked]] + more, 0)

        def contexts(s: slice) -> list:
            texts = zstandard.compress(self.text[_ranges(first[s], sizes[s])].tobytes(), 1)
            pairs = asked[s]
            return [_pack_keys(self.pair_hash[pairs]), self.pair_own[pairs].tobytes(), _planes(self.pair_doc[pairs]), None, sizes[s].astype("<u2").tobytes(), texts]

        yield from self._parts(self.pair_part[asked], contexts, CONTEXTS)
        strings = lambda s: [_pack_keys(self.string_hash[s]), self.string_own[s].tobytes(), _planes(self.string_doc[s]), None, None, None]
        yield from self._parts((self.string_hash >> self.shift).astype(np.int64), strings, STRINGS)

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start and end (in the chunk's text) of every maximal run of bytes that go."""
        self._verdicts()
        starts, ends, rows = [], [], []
        verdict = self.verdict[self.number]
        least = np.zeros(len(self.verdict), np.int64)
        least[self.verdict == ALONE] = self.alone_least
        gone = np.flatnonzero((verdict == ALONE) & (least[self.number] < self.ids[self.row]))
        starts.append(self.first[gone])
        ends.append((self.first + self.n)[gone] + self.length - 1)
        rows.append(self.row[gone])
        runs, sizes, least = _unpack_runs(self.told.get(CONTEXTS, []))
        if len(runs):
            number = np.cumsum((self.verdict == SEND) | (self.verdict == AWAIT)) - 1
            seen = np.flatnonzero((verdict == SEND) | (verdict == AWAIT))
            pair = number[self.number[seen]]
            head = (np.cumsum(runs) - runs)[pair]
            run = _ranges(head, runs[pair])
            own = np.repeat(seen, runs[pair])
            before = np.cumsum(sizes) - sizes
            start = self.first[own] + before[run] - np.repeat(before[np.minimum(head, len(sizes) - 1)] if len(sizes) else head, runs[pair])
            gone = least[run] < self.ids[self.row[own]]
            starts.append(start[gone])
            ends.append((start + sizes[run] + self.length - 1)[gone])
            rows.append(self.row[own][gone])
        _, _, least = _unpack_runs(self.told.get(STRINGS, []))
        if len(least):
            gone = least[self.string_number] < self.ids[self.string_row]
            starts.append(self.string_at[gone])
            ends.append(self.string_at[gone] + self.length)
            rows.append(self.string_row[gone])
        if not sum(map(len, starts)):
            return (np.zeros(0, np.int64),) * 3
        start, end, row = (np.concatenate(x) for x in (starts, ends, rows))
        order = np.argsort(start, kind="stable")
        start, end, row = start[order], np.maximum.accumulate(end[order]), row[order]
        new = np.flatnonzero(np.append(True, (start[1:] > end[:-1]) | (row[1:] != row[:-1])))
        return row[new], start[new], end[np.append(new[1:], len(end)) - 1]


def _pack_runs(runs: np.ndarray, sizes: np.ndarray, least: np.ndarray) -> bytes:
    """For each context the number of its runs of strings, then the runs' sizes and smallest documents (as planes of bytes, which compress well)."""
    return np.array([len(runs), len(sizes)], "<u8").tobytes() + runs.astype("<u2").tobytes() + sizes.astype("<u2").tobytes() + _planes(least)


def _unpack_runs(blobs: list[bytes]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[], [], []]
    for blob in blobs:
        n, m = np.frombuffer(blob, "<u8", 2).tolist()
        parts[0].append(np.frombuffer(blob, "<u2", n, 16).astype(np.int64))
        parts[1].append(np.frombuffer(blob, "<u2", m, 16 + 2 * n).astype(np.int64))
        parts[2].append(_from_planes(blob, 16 + 2 * (n + m)))
    return [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]


def _answers(table: pa.Table, blobs: list[bytes]) -> pa.Table:
    n = len(blobs)
    return pa.table([pa.array([table.column("kind")[0].as_py()] * n, pa.int32()), pa.array([table.column("part")[0].as_py()] * n, pa.int64()), table.column("chunk"), pa.array(blobs, pa.binary())], ["kind", "part", "chunk", "told"])


def _column(table: pa.Table, name: str, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(b.as_py() or b"", kind) for b in table.column(name)]


def _tell_shared(many: int):
    """Of one range of anchors: 0 for those of one document, 2 for those with many occurrences, 1 for the others."""

    def run(table: pa.Table) -> pa.Table:
        asked = [_unpack_keys(k.as_py()) for k in table.column("keys")]
        order, ranked = _order(np.concatenate(asked))
        counts = np.concatenate([_unpack_numbers(x.as_py()) for x in table.column("many")])[order]
        heads = _heads(ranked)
        total = np.add.reduceat(counts, heads)
        told = np.empty(len(ranked), np.uint8)
        told[order] = np.repeat((total > 1).astype(np.uint8) + (total > many), np.diff(np.append(heads, len(ranked))))
        ends = np.cumsum([len(k) for k in asked])
        return _answers(table, [told[e - len(k) : e].tobytes() for k, e in zip(asked, ends.tolist(), strict=True)])

    return run


def _pairs_asked(table: pa.Table) -> list[list[np.ndarray]]:
    """Of every row the keys, the hashes of their own, and the smallest documents."""
    return [[_unpack_keys(x.as_py()) for x in table.column("keys")], _column(table, "own", "<u8"), [_from_planes(x.as_py()) for x in table.column("docs")]]


def _tell_senders(crowd: int):
    """Of one range of contexts: what becomes of each, and the smallest documents of those that are their anchors' only ones."""

    def run(table: pa.Table) -> pa.Table:
        asked = _pairs_asked(table)
        key, own, doc = map(np.concatenate, asked)
        order = np.lexsort((own, key))
        ranked, other = key[order], own[order]
        heads, keys = _heads(ranked, other), _heads(ranked)
        sizes, spread = np.diff(np.append(heads, len(key))), np.diff(np.append(keys, len(key)))
        contexts = np.repeat(np.diff(np.append(np.searchsorted(heads, keys), len(heads))), spread)
        codes, least = np.empty(len(key), np.uint8), np.empty(len(key), np.int64)
        code = np.full(len(key), AWAIT, np.uint8)
        code[heads] = SEND
        code[contexts == 1] = ALONE
        code[(contexts > crowd) | bool(table.column("part")[0].as_py() & 1)] = SPLIT
        codes[order], least[order] = code, np.repeat(np.minimum.reduceat(doc[order], heads), sizes)
        blobs, end = [], 0
        for k in asked[0]:
            own_codes, own_least = codes[end : end + len(k)], least[end : end + len(k)]
            blobs.append(np.uint64(len(k)).tobytes() + own_codes.tobytes() + _planes(own_least[own_codes == ALONE]))
            end += len(k)
        return _answers(table, blobs)

    return run


def least_documents(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray, key: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For each string of ``length`` bytes of the contexts (sorted by key) the smallest document of an equal string under the same key, context by context.

    The contexts of a key are one text, whose suffix array has equal strings side by side; the suffix arrays of many keys are made at once.
    """
    strings = sizes - length + 1
    first_string = np.cumsum(strings) - strings
    out = np.empty(int(strings.sum()), np.int64)
    heads = _heads(key)
    tails = np.append(heads[1:], len(key))
    symbols = np.add.reduceat(sizes + 1, heads) if len(heads) else heads
    order = np.argsort(symbols, kind="stable")  # texts of like size together
    batch = np.cumsum(symbols[order]) // SORTED
    for a, b in _pieces(_heads(batch), len(order)):
        groups = order[a:b]
        members = _ranges(heads[groups], tails[groups] - heads[groups])
        size = sizes[members]
        at = np.cumsum(size + 1) - size - 1  # where each context starts in the batch
        raw = np.zeros(int((size + 1).sum()) + 8, np.uint8)
        text = np.full(len(raw) - 8, GAP, np.int64)
        where = _ranges(at, size)
        raw[where] = buffer[_ranges(starts[members], size)]
        text[where] = raw[where].astype(np.int64) + BYTES
        ends = np.cumsum(symbols[groups])
        text[ends - 1] = END
        array = suffix_arrays(text, ends - symbols[groups])
        begins = np.full(len(text), -1, np.int64)  # the number of the string that begins there
        begins[_ranges(at, strings[members])] = _ranges(first_string[members], strings[members])
        array = array[begins[array] >= 0]
        words = _words(raw)
        same = np.ones(max(len(array) - 1, 0), bool)
        for offset in [*range(0, length - 7, 8), length - 8]:
            w = words[array + offset]
            same &= w[1:] == w[:-1]
        group = np.searchsorted(ends, array, side="right")
        same &= group[1:] == group[:-1]
        new = np.flatnonzero(np.append(True, ~same))[: len(array)]
        docs = np.zeros(len(text), np.int64)
        docs[_ranges(at, strings[members])] = np.repeat(doc[members], strings[members])
        docs = docs[array]
        least = np.minimum.reduceat(docs, new) if len(new) else docs
        out[begins[array]] = np.repeat(least, np.diff(np.append(new, len(array))))
    return out


def _tell_least(length: int):
    """Of one range of contexts, or of single strings: the smallest documents of their strings, for every chunk that asks."""

    def run(table: pa.Table) -> pa.Table:
        asked = _pairs_asked(table)
        key, own, doc = map(np.concatenate, asked)
        strings_alone = table.column("kind")[0].as_py() == STRINGS
        size = np.zeros(len(key), np.int64) if strings_alone else np.concatenate(_column(table, "sizes", "<u2")).astype(np.int64)
        order = np.lexsort((-size, own, key))  # what was sent comes first among equals
        heads = _heads(key[order], own[order])
        number = np.empty(len(order), np.int64)
        number[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
        first = np.minimum.reduceat(doc[order], heads)
        if strings_alone:  # told apart by both hashes
            starts, runs, run_least = np.arange(len(heads)), np.ones(len(heads), np.int64), first
            run_sizes = runs
        else:
            buffer = np.frombuffer(b"".join(zstandard.decompress(x.as_py()) for x in table.column("texts")), np.uint8)
            text = order[heads]  # the bytes of each context come from one chunk
            least = least_documents(buffer, (np.cumsum(size) - size)[text], size[text], key[text], first, length)
            strings = size[text] - length + 1
            run_heads = _heads(np.repeat(np.arange(len(text)), strings), least)
            run_sizes, run_least = np.diff(np.append(run_heads, len(least))), least[run_heads]
            ends = np.searchsorted(run_heads, np.cumsum(strings))
            runs = np.diff(ends, prepend=0)
            starts = ends - runs
        blobs, at = [], 0
        for k in asked[0]:
            context = number[at : at + len(k)]
            at += len(k)
            every = _ranges(starts[context], runs[context])
            blobs.append(_pack_runs(runs[context], run_sizes[every], run_least[every]))
        return _answers(table, blobs)

    return run


def _together(rows: Iterator[list], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of SENT bytes."""
    kept, size = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), types, strict=True)], names)

    for row in rows:
        kept.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if size >= SENT:
            yield out()
            kept, size = [], 0
    if kept:
        yield out()


class _Rounds:
    """The chunks of a corpus and what they have been told."""

    def __init__(self, documents: DataFrame, length: int, chunk_bytes: int):
        self.spark, self.length, self.told = documents.sparkSession, length, []
        size = int(documents.agg(F.sum(F.octet_length(F.col("text").cast("string")) + 64)).first()[0] or 0)
        self.bits = max(1, (size // 18 >> RANGE_BITS).bit_length())
        buckets = min(max(1, size // (chunk_bytes * BUCKET_CHUNKS)) + self.spark.sparkContext.defaultParallelism, 100_000)
        self.chunks = _cut(documents, buckets, chunk_bytes)

    def _joined(self) -> DataFrame:
        """Every chunk with what it has been told so far. The chunks stay where their buckets are; only what they are told moves."""
        if not self.told:
            return self.chunks.withColumn("told", F.lit(None).cast("array<struct<kind int, part long, told binary>>"))
        rows = self.told[0]
        for more in self.told[1:]:
            rows = rows.unionByName(more)
        return self.chunks.join(rows.groupBy("chunk").agg(F.collect_list(F.struct("kind", "part", "told")).alias("told")), "chunk", "left")

    def each(self, method: Callable[[Chunk], Iterator[list]], schema: str, types: list[pa.DataType]) -> DataFrame:
        """The rows that a method gives for every chunk."""
        length, bits, names = self.length, self.bits, [c.split()[0] for c in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield from _together(method(Chunk(batch.slice(i, 1).to_pylist()[0], length, bits)), names, types)

        return self._joined().select("chunk", "doc_ids", "sizes", "text", "told").mapInArrow(run, schema)

    def ask(self, method: Callable[[Chunk], Iterator[list]]) -> DataFrame:
        return self.each(method, _ASKED, _TYPES)

    def tell(self, asked: DataFrame, answer: Callable[[pa.Table], pa.Table]) -> None:
        path = new_path(self.spark, "repeats-told")
        asked.groupBy("kind", "part").applyInArrow(answer, _TOLD).write.parquet(path, compression="zstd")
        self.told.append(self.spark.read.schema(_TOLD).parquet(path))


def _judged(documents: DataFrame, length: int, chunk_bytes: int, columns: str, row: Callable[[bytes, list[tuple[int, int]]], list], types: list[pa.DataType]) -> DataFrame:
    """doc_id and what ``row`` makes of each document's bytes and the spans of them that go, as a written table."""
    if not 16 <= length <= 1 << 14:
        raise ValueError("strings have 16 to 16,384 bytes")
    spark, kind = documents.sparkSession, dict(documents.dtypes)["doc_id"]
    names = ["doc_id", *(c.split()[0] for c in columns.split(", "))]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = Chunk(batch.slice(i, 1).to_pylist()[0], length, bits)
                spans: dict[int, list[tuple[int, int]]] = {}
                for r, a, b in zip(*(x.tolist() for x in chunk.spans()), strict=True):
                    start = int(chunk.starts[r])
                    spans.setdefault(r, []).append((a - start, b - start))
                out = [row(chunk.bytes[a:b], spans.get(r, [])) for r, (a, b) in enumerate(zip(chunk.starts.tolist(), chunk.ends.tolist(), strict=True))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids").slice(i, 1).flatten(), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names)

    with scratch(spark) as folders, _dropping_shuffles(spark):
        rounds = _Rounds(documents, length, chunk_bytes)
        bits = rounds.bits
        rounds.tell(rounds.ask(Chunk.ask_shared), _tell_shared(MANY))
        rounds.tell(rounds.ask(Chunk.ask_senders), _tell_senders(CROWD))
        rounds.tell(rounds.ask(Chunk.send), _tell_least(length))
        judged = rounds._joined().select("chunk", "doc_ids", "sizes", "text", "told").mapInArrow(judge, f"doc_id {kind}, {columns}")
        result = materialize(judged, "repeats")
        folders.remove(result.written_to)
    return result


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in spans)]
    return b"".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(text)], strict=True))


def remove_repeats(documents: DataFrame, length: int = LENGTH, chunk_bytes: int = CHUNK) -> DataFrame:
    """doc_id, kept (the bytes that stay) and spans (start and end, in bytes, of each maximal run that goes) of every row of ``documents`` (doc_id, text).

    A byte goes if a string of ``length`` bytes around it also starts in a document with a smaller doc_id (an integer); strings lie in one document and are judged on the input. Null and empty texts
    have no bytes. Rows with a null doc_id take no part: nothing goes from them or because of them. Rows that share a doc_id don't affect each other. No rows, no rows; extra columns are ignored.
    """
    row = lambda text, spans: [_kept(text, spans), [{"start": a, "end": b} for a, b in spans]]
    return _judged(documents, length, chunk_bytes, "kept binary, spans array<struct<start:long,end:long>>", row, [pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))])


def repeat_digests(documents: DataFrame, length: int = LENGTH, chunk_bytes: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of what :func:`remove_repeats` does to every row."""

    def row(text: bytes, spans: list[tuple[int, int]]) -> list:
        return [len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_kept(text, spans)).hexdigest()]

    return _judged(documents, length, chunk_bytes, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", row, [pa.int64(), pa.int64(), pa.int64(), pa.string()])
