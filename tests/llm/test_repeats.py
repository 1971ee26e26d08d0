"""Suffix arrays against sorting, and removal of repeated passages against all windows of all documents."""

import hashlib
import random

import numpy as np
import pytest

from twinlens.llm import repeats
from twinlens.llm.suffixes import suffix_arrays
from twinlens.sources.stored import shared_dir

DOCS = "doc_id long, text string, chunk long, told string"


def plain(rows, length=50):
    """n_bytes, removed spans and what is kept of every row, by all windows."""
    first = {}
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    for i, t in texts:
        if i is not None:
            for p in range(len(t) - length + 1):
                w = t[p : p + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        if i is not None:
            for p in range(len(t) - length + 1):
                if first[t[p : p + length]] < i:
                    gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), bytes(gone).count(b"\0\1") + (gone[:1] == b"\1"), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def judged(spark, rows, **parameters):
    got = repeats.repeat_digests(spark.createDataFrame(rows, DOCS), **parameters).collect()
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=repr)


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for _ in range(60):
        texts = [np.append(rng.integers(1, rng.integers(2, 6), rng.integers(0, 40)), 0) for _ in range(20)]
        starts = np.cumsum([0] + [len(t) for t in texts[:-1]])
        got = suffix_arrays(np.concatenate(texts), starts)
        for t, s in zip(texts, starts):
            assert (got[s : s + len(t)] - s).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["lorem", "Ipsum", "dolor", "тест", "\U0001f600", "a", "the", "of", "sit amet"]
    text = lambda k: " ".join(rng.choice(words) + (str(rng.randrange(1000)) if rng.random() < 0.4 else "") for _ in range(k))
    passages = [text(rng.randrange(4, 40)) for _ in range(8)] + ["=" * 80, "ab" * 60, "x" * 49, "y" * 50, "z" * 51]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else text(rng.randrange(1, 30)) for _ in range(rng.randrange(6))]
        rows.append((i, rng.choice([" ", "\n", ""]).join(parts), 1, "x"))
    copies = [(100 + k, rows[k * 3][1], 1, "x") for k in range(10)]
    near = [(200 + k, rows[7][1][: 5 * k] + "#" + rows[7][1][5 * k :], 1, "x") for k in range(50)]
    rows += copies + near + [(300, None, 1, "x"), (301, "", 1, "x"), (302, passages[0], 1, "x"), (302, passages[0], 1, "x"), (None, passages[0] * 3, 1, "x"), (None, passages[0] * 3, 1, "x"), (-5, passages[1] + passages[2], 1, "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("chunk", "many", "crowd"), [(1 << 20, 1 << 20, 32), (3000, 1 << 20, 2), (3000, 5, 32), (500, 1, 1)])
def test_equals_all_windows(spark, monkeypatch, chunk, many, crowd):
    monkeypatch.setattr(repeats, "MANY", many)
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "RANGE_BITS", 10)
    rows = corpus(chunk + many)
    assert judged(spark, rows, chunk_bytes=chunk) == plain(rows)


def test_other_lengths_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "STEP", 1000)
    monkeypatch.setattr(repeats, "SORTED", 500)
    rows = corpus(9)
    assert judged(spark, rows, length=20) == plain(rows, 20)
    long = "".join(random.Random(1).choice("abcdefgh ") for _ in range(30_000))
    rows = [(2, long, 1, "x"), (1, long[5_000:25_000], 1, "x"), (3, long[100:160] + "?" + long[-49:], 1, "x")]
    assert judged(spark, rows) == plain(rows)


def test_kept_bytes_and_spans(spark):
    line = "This line is in both of the documents, and it has over fifty bytes. "
    rows = [(1, line + "first", 1, "x"), (2, "second " + line, 1, "x")]
    got = {r["doc_id"]: (bytes(r["kept"]), [tuple(s) for s in r["spans"]]) for r in repeats.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: ((line + "first").encode(), []), 2: (b"second ", [(7, 7 + len(line))])}
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []


def test_cleans_up(spark):
    import os

    folder = shared_dir(spark).removeprefix("file://")
    before, tables = set(os.listdir(folder)), spark.catalog.listTables()
    result = repeats.repeat_digests(spark.createDataFrame(corpus(3), DOCS))
    assert result.count() == 127
    assert len(set(os.listdir(folder)) - before) == 1 and spark.catalog.listTables() == tables


def test_questions_of_a_chunk_leave_it_together(monkeypatch):
    monkeypatch.setattr(repeats, "SENT", 1000)
    names, types = [c.split()[0] for c in repeats._ASKED.split(", ")], repeats._TYPES
    rows = [[0, part, 7, bytes([part % 256]) * (5000 if part == 300 else 10), None, None, None, None, None] for part in range(600)]
    batches = list(repeats._together(iter(rows), names, types))
    assert [list(r.values()) for b in batches for r in b.to_pylist()] == rows and 4 < len(batches) < 10
    assert list(repeats._together(iter([]), names, types)) == []


def test_context_hashes_tell_stretches_seeds_and_sizes_apart():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 4000, dtype=np.uint8)
    text[2000:] = text[:2000]
    first, size = np.arange(0, 1900), rng.integers(8, 80, 1900)
    seed = rng.integers(0, 40, 1900)
    one = repeats._context_hashes(text, first, size, seed)
    assert (repeats._context_hashes(text, first + 2000, size, seed) == one).all()
    known = {(text[a : a + n].tobytes(), s) for a, n, s in zip(first.tolist(), size.tolist(), seed.tolist(), strict=True)}
    assert len(set(one.tolist())) == len(known)
    assert not (repeats._context_hashes(text, first, size, seed + 1) == one).any() and not (repeats._context_hashes(text, first, size - 1, seed)[size > 8] == one[size > 8]).any()
    assert len(repeats._context_hashes(text, first[:0], size[:0], seed[:0])) == 0
