"""Near-duplicate vectors by sorted projection passes.

In every pass vectors are ordered lexicographically by the concatenated signs of random projections,
each is compared with a bounded number of followers, and pairs that reach the cosine are united across
the passes. Rounds of further passes with wider windows follow until one unites nothing new. Inside the components found, all links are then counted exactly, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, connected_components, discard, materialize
from .forest import Forest

COSINE, PASSES, BITS, FOLLOWERS, SEED = 0.93, 16, 32, 64, 7
#: Passes of each later round, and how many times as many followers as its predecessor it compares, up to MOST_FOLLOWERS.
MORE_PASSES, WIDER, MOST_FOLLOWERS = 4, 4, 4096
#: Passes that share one shuffle: so many copies of each vector at a time.
PASSES_AT_ONCE = 4
#: Vectors of one component that a task compares at once; larger components are split into pairs of blocks, small ones into up to SPREAD blocks of SMALL_BLOCK.
BLOCK, SMALL_BLOCK, SPREAD = 2048, 256, 8


def _units(vectors: pa.Array) -> np.ndarray:
    """Rows of unit length, in double precision; all lists have the same length."""
    flat = np.asarray(vectors.flatten(), dtype=np.float64).reshape(len(vectors), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by ``keys``; only the last group is held back."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = (pa.concat_tables([held, table]) if held is not None else table).combine_chunks()
        if not table.num_rows:
            continue
        cols = [table.column(k).to_numpy() for k in keys]
        last = np.all([c == c[-1] for c in cols], axis=0)
        start = 0 if last.all() else len(last) - int(np.argmin(last[::-1]))
        held = table.slice(start)
        if start:
            yield table.slice(0, start).combine_chunks()
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    cols = np.stack([table.column(k).to_numpy() for k in keys], axis=1)
    return np.append(np.flatnonzero(np.append(True, np.any(cols[1:] != cols[:-1], axis=1))), len(cols))


def _hashes(passes: int, bits: int, seed: list[int]):
    """Adds ``keys``: for every pass, the signs of ``bits`` random projections as an integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            sizes = np.asarray(batch.column("embedding").value_lengths())
            out = np.empty((batch.num_rows, passes), dtype=np.int64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                if size not in planes:
                    planes[size] = np.random.default_rng([*seed, int(size)]).standard_normal((int(size), passes * bits))
                signs = (_units(batch.column("embedding").take(pa.array(rows))) @ planes[size] > 0).reshape(len(rows), passes, bits)
                out[rows] = signs @ weights
            keys = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), passes).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], [*batch.schema.names, "keys"])

    return run


def _neighbours(cosine: float, followers: int):
    """Links between each row and its followers, as a forest; rows come sorted by pass, label and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = Forest(), None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (pa.concat_tables([held, table]) if held is not None else table).combine_chunks()
            kept = 0 if held is None else held.num_rows
            ends = _starts(table, ["pass", "label", "size"])
            key = table.column("key").to_numpy()
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                if b <= kept or b - a < 2:
                    continue
                unit, ids = _units(table.column("embedding").slice(a, b - a).combine_chunks()), key[a:b]
                for at in range(0, b - a, 256):  # a block of rows against itself and what follows
                    rows, near = slice(at, at + 256), slice(at, at + 256 + followers)
                    dots = unit[rows] @ unit[near].T
                    i, j = np.nonzero(dots >= cosine)
                    gap = j - i
                    ok = (gap > 0) & (gap <= followers)
                    found.add(ids[rows][i[ok]], ids[near][j[ok]])
            held = table.slice(max(0, table.num_rows - followers))
        a, b = found.links()
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _count_links(cosine: float):
    """Exact links of each vector with the others of its group (or with the group's other block), counting repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["root", "lo", "hi"]):
            ends = _starts(table, ["root", "lo", "hi"])
            key, n, lo, hi, block = (table.column(c).to_numpy() for c in ("key", "n", "lo", "hi", "block"))
            out = np.zeros(len(key), dtype=np.int64)
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                unit = _units(table.column("embedding").slice(a, b - a).combine_chunks())
                linked = unit @ unit.T >= cosine
                np.fill_diagonal(linked, False)
                if lo[a] != hi[a]:
                    linked &= block[a:b, None] != block[None, a:b]
                out[a:b] = linked @ n[a:b]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(out)], ["key", "links"])

    return run


def _passes(table: DataFrame, cosine: float, passes: int, followers: int, bits: int, seed: list[int]) -> DataFrame:
    """Links (a, b) that ``passes`` passes over ``table`` (key, label, embedding, size) meet, as forests."""
    narrow = table.select("key", "label", "embedding", "size")
    schema = f"key long, label long, embedding {dict(table.dtypes)['embedding']}, size int, keys array<long>"
    one = narrow.mapInArrow(_hashes(passes, bits, seed), schema).select("label", "size", "key", "embedding", F.posexplode("keys").alias("pass", "hash"))
    ordered = one.repartitionByRange("pass", "label", "size", "hash", "key").sortWithinPartitions("pass", "label", "size", "hash", "key")
    return ordered.select("pass", "label", "size", "key", "embedding").mapInArrow(_neighbours(cosine, followers), "a long, b long")


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE, passes: int = PASSES, followers: int = FOLLOWERS, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding, label).

    Only vectors of equal, non-null label and equal length are compared. Null, empty or zero vectors, and those that hold null or
    non-finite components, link with nothing: no links, their own component, kept. Equal vectors
    are compared once and counted as often as they occur, so a repeated row counts as a further vector. Extra columns are
    ignored; no rows, no rows.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    fit = F.expr("label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    valid = F.coalesce(fit, F.lit(False))
    distinct = rows.where(valid).groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    keyed = distinct.select(F.monotonically_increasing_id().alias("key"), F.col("label").cast("long").alias("label"), "embedding", F.size("embedding").alias("size"), "first", "n")
    table = materialize(keyed, "vectors")
    most = table.groupBy("label", "size").count().agg(F.max("count")).first()[0] or 0
    found, joined, turn = None, -1, 0
    while True:
        todo = passes if not turn else MORE_PASSES
        parts = [materialize(_passes(table, cosine, min(PASSES_AT_ONCE, todo - k), followers, bits, [seed, turn, k]), "vectors-links") for k in range(0, todo, PASSES_AT_ONCE)]
        links = reduce(DataFrame.unionByName, parts if found is None else [*parts, found.select(F.col("key").alias("a"), F.col("root").alias("b"))])
        old, found = found, materialize(connected_components(links, "vectors").withColumnsRenamed({"id": "key", "component_id": "root"}), "vectors-found")
        discard(*parts, *([old] if old is not None else []))
        unions = found.where("key <> root").count()  # each id but a root was united with another
        if unions == joined or most <= followers + 1:  # one pass compares all of a label
            break
        joined, turn, followers = unions, turn + 1, max(followers, min(followers * WIDER, MOST_FOLLOWERS))
    members = table.select("key", "embedding", "n", "first").join(found, "key")
    members = materialize(members, "vectors-members")
    number = F.greatest(F.ceil(F.count("*") / BLOCK), F.least(F.lit(SPREAD), F.ceil(F.count("*") / SMALL_BLOCK)))
    blocks = materialize(members.groupBy("root").agg(number.cast("int").alias("blocks"), F.min("first").alias("component_id")), "vectors-blocks")
    # a large component's rows all have one root: its block counts are broadcast if they are few, else Spark splits the skewed partition
    blocks = F.broadcast(blocks) if blocks.count() <= BROADCAST_ROWS else blocks
    met = members.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    met = met.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("root", F.least("block", "j").alias("lo"), F.greatest("block", "j").alias("hi"), "block", "key", "n", "embedding")
    dealt = met.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")
    counted = dealt.mapInArrow(_count_links(cosine), "key long, links long").groupBy("key").agg(F.sum("links").alias("links"))
    named = table.select("key", "label", "embedding", "n", "first").join(counted, "key", "left")
    named = named.join(members.select("key", "root").join(blocks, "root").select("key", "component_id"), "key", "left")
    named = materialize(named.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id")), "vectors-named")
    linked = rows.where(valid).withColumn("label", F.col("label").cast("long")).join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
