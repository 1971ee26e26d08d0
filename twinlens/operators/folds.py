"""Leak-free folds, leakage, samples and class weights."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.attributes import draw
from ..sources.stored import BROADCAST_ROWS, fresh, materialize
from .lookup import HEAVY_SHARE, lookup

#: The null group's name among groups as text.
_NULL = "\x00"


def hash_fold(group: Column, n_splits: int, seed: int) -> Column:
    """Fold of a group by a seeded hash."""
    return (draw(group.cast("string"), F.lit(str(seed))) % n_splits).cast("int")


def place_equal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of one size go to each fold, if one after another goes to the lightest fold (of equal ones the first); ``loads`` are updated.

    Fold i takes its j-th group at load ``loads[i] + j * size``, so the groups go to the ``count`` smallest of these. The level up to which all are taken is found by bisection,
    in a number of steps that doesn't depend on ``count``.
    """
    below = lambda level: [max(0, -(-(level - load) // size)) for load in loads]  # noqa: E731  groups that are placed at loads below the level
    low, high = min(loads), max(loads) + size * count + 1
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if sum(below(middle)) <= count else (low, middle)
    taken = below(low)
    for i, load in enumerate(loads):  # what is left goes to folds that are exactly at this level
        if sum(taken) < count and load + taken[i] * size == low:
            taken[i] += 1
    for i, n in enumerate(taken):
        loads[i] += n * size
    return taken


def place_histogram(histogram: dict[int, int], n_splits: int) -> dict[int, list[int]]:
    """For each group size how many of its groups (``histogram``) each fold takes: longest processing time first, over counts instead of groups."""
    loads = [0] * n_splits
    return {size: place_equal(loads, size, histogram[size]) for size in sorted(histogram, reverse=True)}


def _bounds(counts: list[int]) -> list[int]:
    """Ends of the folds' places among the groups of a size, but for the last one's."""
    return list(accumulate(counts))[:-1]


def _sized(df: DataFrame, group: str, seed: int) -> DataFrame:
    """Each group's text ``_g``, its rows ``n`` and a seeded key for its place among groups of its size, as a narrow written table."""
    return _seeded(df.groupBy(F.coalesce(F.col(group).cast("string"), F.lit(_NULL)).alias("_g")).agg(F.count("*").alias("n")), seed)


def _seeded(sizes: DataFrame, seed: int) -> DataFrame:
    return materialize(sizes.select("_g", "n", F.concat(F.lit(f"{seed}:"), "_g").alias("_seeded")), "fold-groups")


def _few(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table with a row for each different group size; n rows have sqrt(2 n) different sizes at most."""
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table


def assign_folds(sizes: DataFrame, n_splits: int, bucket: str = "n") -> DataFrame:
    """``sizes`` (a written table from :func:`_sized`) with ``place`` and ``fold``; only the counts of equal sizes come to the driver."""
    histogram = {r["n"]: r["k"] for r in sizes.groupBy("n").agg(F.count("*").alias("k")).collect()}
    rows = [(size, _bounds(counts)) for size, counts in place_histogram(histogram, n_splits).items()]
    ranked = ranks_in_buckets(sizes, bucket, "_seeded").join(_few(sizes.sparkSession, rows, "n long, bounds array<long>"), "n")
    return ranked.withColumn("fold", F.size(F.filter("bounds", lambda b: b <= F.col("place")))).drop("bounds", "size")


def _to_rows(df: DataFrame, group: str, table: DataFrame, values: dict[str, str]) -> DataFrame:
    """``df`` with ``values`` of its group in ``table`` (a written table of all groups, with their rows ``n``)."""
    key = fresh(df, "_group")
    tagged = df.withColumn(key, F.coalesce(F.col(group).cast("string"), F.lit(_NULL))).drop(*values)  # new values replace old ones
    total = table.agg(F.sum("n")).first()[0] or 0
    # fewer than HEAVY_SHARE groups
    heavy = [r["_g"] for r in table.where(F.col("n") * HEAVY_SHARE > total).select("_g").collect()] if table.count() > BROADCAST_ROWS else []
    if heavy:
        return lookup(tagged, table, "_g", key, values, heavy).drop(key)
    side = table.select(F.col("_g").alias(key), *(F.col(c).alias(n) for n, c in values.items()))
    return tagged.join(F.broadcast(side) if table.count() <= BROADCAST_ROWS else side, key, "left").drop(key)


def group_folds(df: DataFrame, group: str, n_splits: int = 5, seed: int = 42, *, hashed: bool = False) -> DataFrame:
    """``df`` with ``fold``: a group lies in one fold, folds have nearly equal row counts.

    Groups are placed by size, largest first, each on the lightest fold. The driver sees how many groups have each size, and decides how many of them each fold takes;
    groups are joined to these by their rank among groups of their size, which a seeded draw orders. So folds differ by one largest group at most, for
    any number of groups. With ``hashed`` each group is dealt by a seeded hash alone. A null group is a group. ``df`` is read twice, the first time only its groups.
    """
    if hashed:
        return df.withColumn("fold", hash_fold(F.coalesce(F.col(group).cast("string"), F.lit(_NULL)), n_splits, seed))
    placed = materialize(assign_folds(_sized(df, group, seed), n_splits).select("_g", "n", "fold"), "folds")
    return _to_rows(df, group, placed, {"fold": "fold"})


def held_out_folds(df: DataFrame, group: str, n_splits: int = 5, inner: int = 4, seed: int = 42, inner_seed: int = 43) -> DataFrame:
    """One row for each group, as a written table: _g, n, its ``fold`` by :func:`group_folds`, and ``inner``: its fold if the groups of fold 0 are held out and the others dealt anew; null for those of fold 0."""
    outer = materialize(assign_folds(_sized(df, group, seed), n_splits).select("_g", "n", "fold"), "folds")
    dealt = assign_folds(_seeded(outer.where("fold <> 0"), inner_seed), inner).select("_g", F.col("fold").alias("inner"))
    return materialize(outer.join(dealt, "_g", "left"), "folds-held-out")


def to_rows(df: DataFrame, group: str, table: DataFrame, values: dict[str, str]) -> DataFrame:
    """``df`` with ``values`` (new name: column) of its group in ``table``, from :func:`held_out_folds`; null for a group that isn't in it."""
    return _to_rows(df, group, table, values)


def stratified_folds(df: DataFrame, key: str, y: str, n_splits: int = 5, seed: int = 42) -> DataFrame:
    """Row-level folds dealt by hash within each label, for comparison with group folds."""
    return df.withColumn("fold", (draw(F.col(key).cast("string"), F.coalesce(F.col(y).cast("string"), F.lit("")), F.lit(str(seed))) % n_splits).cast("int"))


def nested_matrix(df: DataFrame, group: str, n_splits: int = 5, inner: int = 3, seed: int = 42) -> DataFrame:
    """One row for each group, as a written table: _g, n, its outer ``fold``, and ``inner``: its inner fold where each outer fold is held out, null at its own.

    Outer folds are those of :func:`group_folds`. Where one is held out, the other groups of a size are placed anew: in the order of their outer folds and places
    in these, so that the groups are ranked once, whatever fold is held out.
    """
    outer = materialize(assign_folds(_sized(df, group, seed), n_splits).select("_g", "n", "fold", F.concat(F.lit(f"{seed + 1}:"), "_g").alias("_seeded")), "folds-outer")
    outer = outer.withColumn("cell", F.concat_ws(":", "n", "fold"))
    cells: dict[int, list[int]] = {}
    for r in outer.groupBy("n", "fold").agg(F.count("*").alias("k")).collect():  # group sizes times outer folds
        cells.setdefault(r["n"], [0] * n_splits)[r["fold"]] = r["k"]
    held_out = [place_histogram({n: sum(k) - k[o] for n, k in cells.items() if sum(k) > k[o]}, inner) for o in range(n_splits)]
    rows = []
    for n, counts in cells.items():
        for fold in range(n_splits):
            bounds, before = [], []
            for o in range(n_splits):
                bounds.append(_bounds(held_out[o][n]) if o != fold and n in held_out[o] else None)
                before.append(sum(counts[f] for f in range(fold) if f != o))
            rows.append((n, fold, before, bounds))
    ranked = ranks_in_buckets(outer, "cell", "_seeded").join(_few(df.sparkSession, rows, "n long, fold int, before array<long>, bounds array<array<long>>"), ["n", "fold"])
    inside = F.zip_with("before", "bounds", lambda start, ends: F.when(ends.isNotNull(), F.size(F.filter(ends, lambda b: b <= start + F.col("place")))))
    return materialize(ranked.select("_g", "n", "fold", inside.alias("inner")), "folds-nested")


def nested_folds(df: DataFrame, group: str, n_splits: int = 5, inner: int = 3, seed: int = 42) -> DataFrame:
    """``outer`` and ``fold``: inner folds of the training rows of each outer fold; columns of ``df`` repeat once per outer fold they train.

    The rows are read twice: once for the sizes of their groups and once with their group's row of :func:`nested_matrix`, from which all outer folds are expanded.
    """
    rows = _to_rows(df, group, nested_matrix(df, group, n_splits, inner, seed), {"_inner": "inner"})
    return rows.select(*(c for c in df.columns if c not in ("outer", "fold")), F.posexplode("_inner").alias("outer", "fold")).where("fold is not null")


def leakage(df: DataFrame, fold: str, ids: tuple[str, ...] = ("base_item_id", "cand_item_id")) -> DataFrame:
    """For each fold: overlap_ratio, n_valid_items and n_leaked_items, ids of the fold that other folds hold too. Null ids don't count."""
    each = df.select(F.col(fold).alias("fold"), F.explode(F.array(*ids)).alias("id")).where("id is not null").distinct()
    # an id leaks from every fold that it is in, if it is in several
    spread = each.groupBy("id").agg(F.count("*").alias("folds"))
    counts = each.join(spread, "id").groupBy("fold").agg(F.count("*").alias("n_valid_items"), F.count_if(F.col("folds") > 1).alias("n_leaked_items"))
    return counts.select("fold", (F.col("n_leaked_items") / F.col("n_valid_items")).alias("overlap_ratio"), "n_valid_items", "n_leaked_items")


def leakage_between(train: DataFrame, valid: DataFrame, ids: tuple[str, ...] = ("base_item_id", "cand_item_id")) -> DataFrame:
    """One row: how many of the ids in ``valid`` are in ``train``; zeros if there are none."""
    stack = lambda d: d.select(F.explode(F.array(*ids)).alias("id")).where("id is not null").distinct()
    met = stack(valid).withColumn("v", F.lit(1)).join(stack(train).withColumn("t", F.lit(1)), "id", "left")
    out = met.agg(F.count("*").alias("n_valid_items"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_leaked_items"))
    return out.select((F.col("n_leaked_items") / F.greatest("n_valid_items", F.lit(1))).alias("overlap_ratio"), "n_valid_items", "n_leaked_items")


#: Rows that are sorted in one place at most for a sample.
SORTED_ROWS = 100_000
_DRAW_BITS = 60


def exact_sample(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """``k`` rows without replacement, the same in every run: those of the smallest draws.

    A large sample is found by the draws' highest 16 bits, of which the counts are collected: whole ranges of draws, and the first rows of one more.
    """
    value = draw(F.col(key).cast("string"), F.lit(str(seed)))
    rest, taken = df, None
    if k > SORTED_ROWS:
        high = F.shiftright(value, _DRAW_BITS - 16)
        cut = 0
        # 2 ** 16 rows at most
        for row in sorted(df.groupBy(high.alias("high")).agg(F.count("*").alias("n")).collect()):
            if row["n"] > k:
                break
            cut, k = row["high"] + 1, k - row["n"]
        taken, rest = df.where(high < cut), df.where(high == cut)
    rest = rest.orderBy(value, key).limit(k)
    return rest if taken is None else taken.unionByName(rest)


def subsample_negatives(df: DataFrame, key: str, y: str, ratio: int | None, seed: int = 42) -> DataFrame:
    """All positives and ``ratio`` times as many negatives (all for None)."""
    positives, negatives = df.where(F.col(y) == 1), df.where(F.col(y) == 0)
    if ratio is None:
        return positives.unionByName(negatives)
    return positives.unionByName(exact_sample(negatives, key, positives.count() * ratio, seed))


def class_weight(df: DataFrame, y: str, *keys: str) -> DataFrame:
    """Negatives over positives for each key, with one positive at least."""
    neg, pos = F.count_if(F.col(y) == 0), F.count_if(F.col(y) == 1)
    return df.groupBy(*keys).agg((neg / F.greatest(pos, F.lit(1))).alias("weight"))


#: Rows of a bucket that are ranked together, on average at most.
RANKED_ROWS = 200_000


def ranks_in_buckets(pool: DataFrame, bucket: str, key: str, rows: int = RANKED_ROWS) -> DataFrame:
    """``pool`` (a stored table) with ``place`` from 0 and ``size`` within its bucket; the order is by a draw of ``key``, then ``key``.

    If a bucket is larger than ``rows``, buckets are ranked in parts by the draws' highest bits and the parts' counts added up, so that one which holds
    most rows is no single group.
    """
    drawn = pool.withColumn("_draw", draw(F.col(key).cast("string")))
    largest = pool.groupBy(bucket).count().agg(F.max("count")).first()[0] or 0
    bits = max(-(-largest // rows) - 1, 0).bit_length()
    if not bits:
        order = Window.partitionBy(bucket).orderBy("_draw", key)
        ranked = drawn.withColumns({"place": (F.row_number().over(order) - 1).cast("long"), "size": F.count("*").over(Window.partitionBy(bucket))})
        return ranked.drop("_draw")
    parted = drawn.withColumn("_part", F.shiftright("_draw", _DRAW_BITS - bits))
    counts = parted.groupBy(bucket, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(bucket).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.select(F.col(bucket).alias("_b"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(bucket)).alias("size"))
    ranked = parted.withColumn("_in", F.row_number().over(Window.partitionBy(bucket, "_part").orderBy("_draw", key)) - 1)
    joined = ranked.join(sums, ranked[bucket].eqNullSafe(F.col("_b")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("place", F.col("_in") + F.col("_before")).drop("_draw", "_part", "_b", "_p", "_before", "_in")


def balanced_batches(df: DataFrame, key: str, y: str, batches: int, batch_size: int, seed: int = 42) -> DataFrame:
    """batch, slot, y and the key of a row drawn for each slot, with replacement: half of a batch are positives."""
    half = batch_size // 2
    slots = df.sparkSession.range(batches * batch_size).select((F.col("id") / batch_size).cast("int").alias("batch"), (F.col("id") % batch_size).cast("int").alias("slot"))
    slots = slots.withColumn("bucket", (F.col("slot") < half).cast("int"))
    pool = materialize(df.where(F.col(y).isin(0, 1)).select(F.col(key).alias("key"), F.col(y).cast("int").alias("bucket")), "batch-pool")
    ranked = ranks_in_buckets(pool, "bucket", "key")
    sizes = F.broadcast(ranked.groupBy("bucket").agg(F.max("size").alias("n")))  # two rows
    wanted = slots.join(sizes, "bucket").withColumn("place", draw(F.lit(str(seed)), F.col("batch").cast("string"), F.col("slot").cast("string")) % F.col("n"))
    return wanted.join(ranked.select("bucket", "place", "key"), ["bucket", "place"]).select("batch", "slot", F.col("bucket").alias("y"), F.col("key").alias(key))
