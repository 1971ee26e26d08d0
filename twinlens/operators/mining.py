"""Hard negatives for triplets, from the narrowest bucket that has one to a random one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import draw, nested_keys
from ..sources.stored import BROADCAST_ROWS, discard, materialize
from .folds import ranks_in_buckets

LEVELS = ("same_base", "param2", "param1", "subcategory", "category", "random")


_NAMES = ("category_name", "subcategory_name", "param1", "param2")


def prepare_keys(listings: DataFrame) -> DataFrame:
    """``listings`` with the buckets that they are in, from ``_bucket_param2`` to ``_bucket_category``: a listing is in several pairs, so its keys are worked out before it is paired."""
    return listings.withColumns({f"_bucket_{n}": k for n, k in nested_keys(*(F.col(c) for c in _NAMES)).items()})


def _keys(pairs: DataFrame, side: str) -> list[Column]:
    """Bucket of each level but the last for one side of a pair; keys of :func:`prepare_keys` are taken as they are."""
    if f"_{side}_bucket_category" in pairs.columns:
        nested = {n: F.col(f"_{side}_bucket_{n}") for n in LEVELS[1:5]}
    else:
        nested = nested_keys(*(F.col(f"{side}_{c}") for c in _NAMES))
    return [F.col("base_item_id").cast("string"), *(nested[n] for n in LEVELS[1:5])]


def _narrow(keys: DataFrame) -> DataFrame:
    """A written table of one key column, broadcast only if its size allows."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def mine_triplets(pairs: DataFrame, n_negatives: int = 1, seed: int = 42, *, stored: bool = False) -> DataFrame:
    """anchor_pair, draw, level and neg_pair: for each positive pair a negative pair whose candidate is drawn from the
    first level at which the anchor's bucket holds one.

    ``pairs`` has pair_id, base_item_id, is_double and the category attributes of both sides, or the keys of :func:`prepare_keys`; its keys are stored once, unless these are ``stored`` already. The
    levels are a cascade: each is only asked by the anchors that the ones before left over, and only ranks the buckets that are
    asked; the random level ranks the whole pool only if anchors are left. Fails if a class is missing.
    """
    columns = [k.alias(f"{side[0]}{i}") for side in ("base", "cand") for i, k in enumerate(_keys(pairs, side))]
    keyed = pairs.where("is_double in (0, 1)").select("pair_id", F.col("is_double").cast("int").alias("y"), *columns)
    keyed = keyed if stored else materialize(keyed, "mining-keys")
    sizes = {r["y"]: r["n"] for r in keyed.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0, 1}:
        raise ValueError("mining needs pairs of both classes")
    left, left_n, found = keyed.where("y = 1").select(F.col("pair_id").alias("anchor_pair"), *(f"b{i}" for i in range(5))), sizes[1], []

    def drawn(asked: DataFrame, level: int, n: Column) -> DataFrame:
        each = asked.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_negatives - 1))))
        place = draw(F.col("anchor_pair").cast("string"), (F.col("draw") + seed).cast("string"), F.lit(str(level))) % n
        return each.select("anchor_pair", "draw", F.lit(level).alias("level"), "bucket", place.alias("place"))

    for level in range(5):
        if not left_n:
            break
        # candidates' buckets, but for the first level: that of the same base
        pool = keyed.where("y = 0").select(F.col("pair_id").alias("neg_pair"), F.col(f"{'c' if level else 'b'}{level}").alias("bucket"))
        wanted = materialize(left.select(F.col(f"b{level}").alias("bucket")).distinct(), "mining-wanted")
        counts = materialize(pool.join(_narrow(wanted), "bucket", "left_semi").groupBy("bucket").agg(F.count("*").alias("n")), "mining-counts")
        ranked = ranks_in_buckets(pool.join(_narrow(counts.select("bucket")), "bucket", "left_semi"), "bucket", "neg_pair")
        met = left.withColumn("bucket", F.col(f"b{level}")).join(_narrow(counts), "bucket", "left")
        got = drawn(met.where("n is not null"), level, F.col("n")).join(ranked.select("bucket", "place", "neg_pair"), ["bucket", "place"])
        found.append(materialize(got.select("anchor_pair", "draw", "level", "neg_pair"), "mining-found"))
        left = materialize(met.where("n is null").select("anchor_pair", *(f"b{i}" for i in range(5))), "mining-left")
        left_n = left.count()
        discard(wanted, counts)
    if left_n:
        pool = keyed.where("y = 0").select(F.col("pair_id").alias("neg_pair"), F.lit("").alias("bucket"))
        ranked = ranks_in_buckets(pool, "bucket", "neg_pair")
        asked = drawn(left.withColumn("bucket", F.lit("")), 5, F.lit(sizes[0]))
        found.append(asked.join(ranked.select("place", "neg_pair"), "place").select("anchor_pair", "draw", "level", "neg_pair"))
    return reduce(DataFrame.unionByName, found)


def level_counts(triplets: DataFrame) -> DataFrame:
    """level, name, n and share for every level, those without triplets included."""
    names = F.array(*(F.lit(x) for x in LEVELS))
    levels = triplets.sparkSession.range(len(LEVELS)).select(F.col("id").cast("int").alias("level"))
    counts = triplets.groupBy("level").agg(F.count("*").alias("n"))
    all_ = F.broadcast(counts.agg(F.sum("n").alias("total")))  # one row
    out = levels.join(F.broadcast(counts), "level", "left").join(all_)
    n = F.coalesce("n", F.lit(0))
    return out.select("level", F.get(names, F.col("level")).alias("name"), n.alias("n"), (n / F.greatest(F.coalesce("total", F.lit(0)), F.lit(1))).alias("share"))


def contrastive_loss(distance: Column, y: Column, margin: float = 1.0) -> Column:
    """Mean contrastive loss, an aggregate."""
    return F.avg(y * distance * distance + (1 - y) * F.pow(F.greatest(F.lit(margin) - distance, F.lit(0.0)), 2))


def triplet_loss(positive: Column, negative: Column, margin: float = 0.3) -> Column:
    """Mean triplet margin loss, an aggregate."""
    return F.avg(F.greatest(positive - negative + F.lit(margin), F.lit(0.0)))


def triplet_vectors(triplets: DataFrame, pairs: DataFrame, vectors: DataFrame, key: str, base: str, cand: str) -> DataFrame:
    """anchor_pair, draw and the vectors of each triplet's three sides (anchor, positive, negative): the anchor pair's base and candidate, and the
    negative pair's candidate. ``vectors`` has ``key`` and embedding; triplets with an unknown side are left out."""
    ids = pairs.select("pair_id", base, cand)
    met = triplets.join(ids.select(F.col("pair_id").alias("anchor_pair"), F.col(base).alias("_a"), F.col(cand).alias("_p")), "anchor_pair")
    met = met.join(ids.select(F.col("pair_id").alias("neg_pair"), F.col(cand).alias("_n")), "neg_pair").select("anchor_pair", "draw", "_a", "_p", "_n")
    for side, name in (("_a", "anchor"), ("_p", "positive"), ("_n", "negative")):
        met = met.join(vectors.select(F.col(key).alias(side), F.col("embedding").alias(name)), side)
    return met.select("anchor_pair", "draw", "anchor", "positive", "negative")
