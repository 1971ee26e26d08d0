"""Pieces that several operators share: shared storage, words, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import BROADCAST_ROWS, discard, fresh, materialize, new_path, remove, scratch, shared_dir

__all__ = ["BROADCAST_ROWS", "connected_components", "crc_mod", "discard", "fresh", "materialize", "new_path", "remove", "row_key", "scratch", "shared_dir", "with_keys"]


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def row_key(documents: DataFrame) -> Column:
    """A hash of a row's id and text: rows alike in both share it."""
    return F.xxhash64(F.col("doc_id").cast("string"), F.lit("\x00"), F.col("text").cast("string"))


def with_keys(documents: DataFrame, keys: DataFrame, how: str, on: str) -> DataFrame:
    """Semi or anti join of ``documents`` with the written table ``keys`` (one long column ``on``), broadcast only if its size allows."""
    small = keys.count() <= BROADCAST_ROWS
    return documents.join(F.broadcast(keys) if small else keys, on, how)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest reachable id of every id that occurs in ``edges`` (columns ``a`` and ``b``, longs).

    Every id hooks to its smallest neighbour, chains of hooks are shortened by
    joining the hooks with themselves, and the edges are rewritten to the hooks' ends until none is
    left. All of it is joins and partial aggregates on written tables; nothing is gathered per group.
    Loops, repeated edges and edges with a null end are ignored. Returns ``id`` and ``component_id``;
    ids that are in no edge are absent.
    """
    # parquet carries one table of hooks a round, composed at the end
    left = materialize(_proper(edges), f"{name}-edges")
    hooks: list[DataFrame] = []
    while not left.isEmpty():
        hook = materialize(left.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to")), f"{name}-hooks")
        # many hooks have one target: a small table of hooks is broadcast, a large one is joined by a shuffle whose skewed partitions Spark splits
        small = hook.count() <= BROADCAST_ROWS
        spread = lambda table, small=small: F.broadcast(table) if small else table
        chained = True
        while chained:  # until no hook's target hooks itself
            old = hook
            for _ in range(2):
                up = spread(hook.select(F.col("id").alias("to"), F.col("to").alias("further")))
                hook = hook.join(up, "to", "left").select("id", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("chained"))
            hook = materialize(hook, f"{name}-hooks")
            discard(old)
            chained = not hook.where("chained").isEmpty()
        hooks.append(hook.select("id", "to"))
        moved = left
        for end in ("a", "b"):
            moved = moved.join(spread(hooks[-1].withColumnRenamed("id", end)), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        old, left = left, materialize(_proper(moved), f"{name}-edges")
        discard(old)
    if not hooks:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    # no end hooks in its own round, so an id hooks in one round only and the rounds' tables hold disjoint ids; a later round moves the ends of earlier ones
    ends = hooks[-1].select("id", F.col("to").alias("component_id"))
    for hook in reversed(hooks[:-1]):
        later = ends.withColumnRenamed("id", "to")
        moved = hook.join(later, "to", "left").select("id", F.coalesce("component_id", "to").alias("component_id"))
        ends = materialize(moved.unionByName(ends), f"{name}-ends")
    roots = ends.select(F.col("component_id").alias("id"), "component_id").distinct()
    return ends.unionByName(roots)


def _proper(edges: DataFrame) -> DataFrame:
    """Edges from the smaller to the larger id, each once."""
    a, b = F.least("a", "b"), F.greatest("a", "b")
    return edges.where("a is not null and b is not null and a <> b").select(a.alias("a"), b.alias("b")).distinct()
