"""Exact ranking metrics and rank blending without a global sort on one task.

Rows are first added up by score. A score's bucket is the number of bounds below it, so it never depends on where a
row happens to lie; running sums are taken within buckets and moved by the totals of the buckets before. The sums by
score are states that can be kept for each part of the rows and merged when parts are added.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import BROADCAST_ROWS, fresh, materialize

#: Distinct scores, or rows of one group, that are put in order together, on average at most.
ORDERED_ROWS = 200_000


def _in_ranges(of: DataFrame, score: str, parts: int, out: str) -> DataFrame:
    """The stored ``of`` with ``out``: which of ``parts`` nearly equal ranges of its scores a row's score lies in.

    A row finds its range by binary search. Null lies in the first range and NaN, the largest score, behind the last one.
    """
    cuts = []
    if parts > 1:
        found = of.agg(F.percentile_approx(score, [i / parts for i in range(1, parts)], max(10_000, 4 * parts))).first()[0]
        cuts = sorted({b + 0.0 for b in found or () if math.isfinite(b)})
    if not cuts:
        return of.withColumn(out, F.lit(0))
    at, place = fresh(of, "_at"), fresh(of, "_place")
    placed = of.withColumn(at, F.coalesce(F.col(score).cast("double"), F.lit(-math.inf)) + 0.0)
    placed = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=at, outputCol=place, handleInvalid="keep").transform(placed)
    return placed.withColumn(out, F.col(place).cast("int")).drop(at, place)


def score_states(scored: DataFrame, score: str, y: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, score, n and p: how many rows and positives have each score. Null scores are left out.

    States of parts add up, so they can be kept with the parts; what :func:`merge_states` makes of them serves all that the rows would.
    """
    positives = F.sum(F.col(y).cast("long")) if y else F.lit(0).cast("long")
    by = (*keys, F.col(score).cast("double").alias("score"))
    return scored.where(F.col(score).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(positives, F.lit(0)).alias("p"))


def merge_states(states: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """States by ``keys`` and score of the states of any parts, or by fewer keys."""
    return states.groupBy(*keys, "score").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))


def running_states(states: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``states``, one row for each of ``keys`` and score, with the sums over smaller scores (n_below, p_below) and in all (n_all, p_all).

    The states are stored first. Null keys are keys like others.
    """
    g = materialize(states, "scores")
    g = _in_ranges(g, "score", -(-g.count() // ORDERED_ROWS), "bucket")
    inside = Window.partitionBy(*keys, "bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    run = g.withColumns({"rn": F.coalesce(F.sum("n").over(inside), zero), "rp": F.coalesce(F.sum("p").over(inside), zero)})
    # a row for each bucket of each key
    totals = g.groupBy(*keys, "bucket").agg(F.sum("n").alias("bn"), F.sum("p").alias("bp"))
    by = Window.partitionBy(*(keys or (F.lit(0),)))
    before = by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    names = {k: f"_of_{i}" for i, k in enumerate((*keys, "bucket"))}
    offsets = totals.select(
        *(F.col(k).alias(n) for k, n in names.items()),
        F.coalesce(F.sum("bn").over(before), zero).alias("on"),
        F.coalesce(F.sum("bp").over(before), zero).alias("op"),
        F.sum("bn").over(by).alias("n_all"),
        F.sum("bp").over(by).alias("p_all"),
    )
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()))
    return run.join(offsets, same).select(*keys, "score", "n", "p", (F.col("rn") + F.col("on")).alias("n_below"), (F.col("rp") + F.col("op")).alias("p_below"), "n_all", "p_all")


def score_table(scored: DataFrame, score: str, y: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, score, n, p and the rows and positives with smaller scores (n_below, p_below) and in all (n_all, p_all).

    Null scores are left out. ``scored`` is read once.
    """
    return running_states(score_states(scored, score, y, keys), keys)


def auc_of_states(states: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """:func:`auc_metrics` of :func:`score_states`, one row for each of ``keys`` and score."""
    t = running_states(states, keys)
    reached_p, reached_n = F.col("p_all") - F.col("p_below"), F.col("n_all") - F.col("n_below")
    neg_below, neg_tied = F.col("n_below") - F.col("p_below"), F.col("n") - F.col("p")
    sums = t.groupBy(*keys).agg(
        F.sum(F.col("p") * (reached_p / reached_n)).alias("ap"),
        F.sum(F.col("p") * (neg_below + 0.5 * neg_tied)).alias("wins"),
        F.max("n_all").alias("rows"),
        F.max("p_all").alias("positives"),
    )
    pos, neg = F.col("positives"), F.col("rows") - F.col("positives")
    both = (pos > 0) & (neg > 0)
    return sums.select(*keys, "rows", "positives", F.when(both, F.col("ap") / pos).alias("pr_auc"), F.when(both, F.col("wins") / (pos.cast("double") * neg)).alias("roc_auc"))


def auc_metrics(scored: DataFrame, score: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """pr_auc (step-wise, ties share a threshold) and roc_auc for each key; null where a class is missing."""
    return auc_of_states(score_states(scored, score, y, keys), keys)


def auc_levels(scored: DataFrame, score: str, y: str, levels: tuple[tuple[str, ...], ...]) -> DataFrame:
    """:func:`auc_metrics` at several levels at once: ``level`` (its keys' names, joined by commas), all keys (null where they aren't the level's) and the metrics.

    Rows are read once and added up by all keys and score; grouping sets add these states up further, and all levels share the sort that follows.
    """
    keys = tuple(dict.fromkeys(k for level in levels for k in level))
    states = score_states(scored, score, y, keys)
    named = F.concat_ws(",", *(F.when(F.grouping(k) == 0, F.lit(k)) for k in keys)).alias("level")
    sets = states.groupingSets([[*(F.col(k) for k in level), F.col("score")] for level in levels], *keys, "score")
    return auc_of_states(sets.agg(named, F.sum("n").alias("n"), F.sum("p").alias("p")), ("level", *keys))


def compare_splits(folds: DataFrame, honest: str) -> DataFrame:
    """split, pr_auc (the mean over the folds, of :func:`auc_metrics` by split and fold) and ``over_group``, its ratio to that of the split ``honest``."""
    mean = folds.groupBy("split").agg(F.avg("pr_auc").alias("pr_auc"))
    reference = F.broadcast(mean.where(F.col("split") == honest).select(F.col("pr_auc").alias("_honest")))  # one row
    return mean.join(reference).select("split", "pr_auc", (F.col("pr_auc") / F.col("_honest")).alias("over_group"))


def rank_normalize(scored: DataFrame, score: str, out: str, states: DataFrame | None = None) -> DataFrame:
    """``scored`` with ``out``: the mean rank of equal scores over n - 1; 0.5 for a single row; null for a null score.

    Ranks are those among the rows of ``states`` if these are given (one row for each score), and null for scores that they lack.
    """
    t = running_states(score_states(scored, score) if states is None else states)
    rank = F.when(F.col("n_all") == 1, 0.5).otherwise((F.col("n_below") + (F.col("n") - 1) / 2.0) / F.greatest(F.col("n_all") - 1, F.lit(1)))
    ranks = materialize(t.select(F.col("score").alias("_score"), rank.alias(out)), "ranks")
    few = ranks.count() <= BROADCAST_ROWS
    return scored.join(F.broadcast(ranks) if few else ranks, F.col(score).cast("double") == F.col("_score"), "left").drop("_score")


def blend(a: Column, b: Column, weight: float) -> Column:
    """Weighted mean of two normalised ranks; ``weight`` is the first one's."""
    if not 0.0 <= weight <= 1.0:
        raise ValueError("the weight must lie in [0, 1]")
    return F.lit(weight) * a + F.lit(1.0 - weight) * b


def rank_blend(scored: DataFrame, a: str, b: str, weight: float, out: str = "blend") -> DataFrame:
    ranked = rank_normalize(rank_normalize(scored, a, "rank_a"), b, "rank_b")
    return ranked.withColumn(out, blend(F.col("rank_a"), F.col("rank_b"), weight))


def blend_sweep(ranked: DataFrame, y: str, weights: tuple[float, ...]) -> DataFrame:
    """weight and pr_auc of the blends of ``rank_a`` and ``rank_b``; ranks are computed once."""
    each = ranked.select(y, "rank_a", "rank_b", F.explode(F.array(*(F.lit(w) for w in weights))).alias("weight"))
    each = each.withColumn("blend", F.col("weight") * F.col("rank_a") + (F.lit(1.0) - F.col("weight")) * F.col("rank_b"))
    return auc_metrics(each, "blend", y, ("weight",)).select("weight", "pr_auc")


def map_by_group(scored: DataFrame, group: str, y: str, score: str, tie: str, skip_empty: bool = True, rows: int = ORDERED_ROWS) -> DataFrame:
    """group, ap and n_pos; ties of score are ordered by ``tie``. Groups without positives are left out, or have AP 0.

    If a group is larger than ``rows``, groups are ranked in ranges of scores and the ranges' counts added up.
    """
    stored = materialize(scored.select(F.col(group).alias("group"), F.col(y).cast("long").alias("y"), F.col(score).alias("score"), F.col(tie).alias("tie")), "ranked-groups")
    largest = stored.groupBy("group").count().agg(F.max("count")).first()[0] or 0
    stored = _in_ranges(stored, "score", -(-largest // rows), "range").withColumn("range", -F.col("range"))
    order = Window.partitionBy("group", "range").orderBy(F.col("score").desc(), F.col("tie"))
    inside = stored.select("group", "range", "y", F.row_number().over(order).alias("rank"), F.sum("y").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("hits"))
    before = Window.partitionBy("group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored.groupBy("group", "range").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    offsets = counts.select(F.col("group").alias("g"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p"))
    hits = inside.join(offsets, F.col("group").eqNullSafe(F.col("g")) & (F.col("range") == F.col("r")))
    precision = (F.col("hits") + F.col("p")) / (F.col("rank") + F.col("n"))
    ap = hits.groupBy("group").agg(F.sum(F.when(F.col("y") == 1, precision).otherwise(0.0)).alias("s"), F.sum("y").alias("n_pos"))
    ap = ap.select(F.col("group").alias(group), F.when(F.col("n_pos") > 0, F.col("s") / F.greatest("n_pos", F.lit(1))).otherwise(0.0).alias("ap"), "n_pos")
    return ap.where("n_pos > 0") if skip_empty else ap


def mean_average_precision(scored: DataFrame, group: str, y: str, score: str, tie: str, skip_empty: bool = True) -> DataFrame:
    """One row: map, 0 if no group remains."""
    return map_by_group(scored, group, y, score, tie, skip_empty).agg(F.coalesce(F.avg("ap"), F.lit(0.0)).alias("map"))


def best_weight(curve: DataFrame) -> DataFrame:
    return curve.agg(F.max_by("weight", F.struct("pr_auc", -F.col("weight"))).alias("weight"), F.max("pr_auc").alias("pr_auc"))
