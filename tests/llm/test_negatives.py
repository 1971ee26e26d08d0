"""Norm-bucketed negative mining against all scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlens.llm import negatives

ROWS = "vec_id long, embedding array<double>, label int, rank long, score double"


def plain(rows, anchor, n_pos=5, n_neg=3, low=50, high=95):
    fit = [(i, [math.floor(256 * x) for x in v], y) for i, v, y, *_ in rows if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, y) in enumerate(fit):
        if not anchor(i):
            continue
        met = [(-sum(p * q for p, q in zip(v, w)), j, z) for b, (j, w, z) in enumerate(fit) if b != a and len(w) == len(v)]
        for s, j, _ in sorted(m for m in met if m[2] == y)[:n_pos]:
            hard = sorted(m for m in met if m[2] != y and low * -s <= 100 * -m[0] <= high * -s)[:n_neg]
            out += [(i, j, r, k, -s, -t) for r, (t, k, _) in enumerate(hard, 1)]
    return sorted(out)


def mined(spark, rows):
    got = negatives.mine_negatives(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 5 == 0)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect())


@pytest.mark.parametrize(("bucket", "block"), [(2048, 1024), (16, 7)])
def test_equals_all_scores(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(negatives, "BUCKET", bucket)
    monkeypatch.setattr(negatives, "ANCHORS", block)
    monkeypatch.setattr(negatives, "STRIPE", 3)
    rng = np.random.default_rng(1)
    coarse = lambda n: rng.integers(-3, 4, n) / 4  # noqa: E731  many ties
    rows = [(i, [float(x) for x in (coarse(6) if i % 3 else rng.normal(size=6) * rng.choice([0.1, 1, 5]))], int(rng.integers(4)) if i % 11 else None, 1, 0.0) for i in range(240)]
    rows += [(300 + i, [0.5, None, 1.0], 1, 1, 0.0) for i in range(3)] + [(305, [float("nan")] * 6, 1, 1, 0.0), (306, [float("inf")] * 6, 1, 1, 0.0), (307, None, 1, 1, 0.0), (None, [1.0] * 6, 1, 1, 0.0)]
    rows += [(310 + i, [1.0, 0.5], i % 2, 1, 0.0) for i in range(8)] + [(320 + i, [0.0] * 6, i % 3, 1, 0.0) for i in range(6)] + [(330 + i, [], i % 2, 1, 0.0) for i in range(6)]
    rows += rows[:20]  # repeated rows are further rows
    assert mined(spark, rows) == plain(rows, lambda i: i % 5 == 0)


def test_large_numbers_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4) * 10 ** rng.integers(0, 7)).tolist(), i % 2, 1, 0.0) for i in range(60)]
    got = mined(spark, rows)
    assert got == plain(rows, lambda i: i % 5 == 0)
    assert max(abs(r[4]) for r in got) > 2**53
    assert mined(spark, rows + [(70, [1e300] * 4, 0, 1, 0.0)]) == got


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0, 1, 0.0)]) == [] == mined(spark, [(5, [1.0], 0, 1, 0.0)])


def test_short_vectors_are_not_sent(spark):
    """Buckets below what all windows of a block need don't reach its tile."""
    table = spark.createDataFrame([(i, [float(2 ** (i // 8)), 0.0], i % 2, 1, 0.0) for i in range(64)], ROWS)
    rows = table.select(F.col("vec_id").alias("key"), "vec_id", F.col("label").cast("long").alias("label"), F.lit(False).alias("anchor"), "embedding")
    scaled = negatives.materialize(rows.mapInArrow(negatives._scaled(1), negatives._ROWS), "test-rows")
    buckets = negatives.norm_blocks(scaled, 8)
    assert buckets.where("top < 64").count() > 0
    blocks = negatives.norm_blocks(scaled.where("key >= 56"), 8, need=F.lit(64.0), windows=F.array("key", "key", F.lit(2**14)).cast("array<long>"))
    found = negatives.search(blocks, buckets, negatives.Negatives, 3, 50, 95).collect()
    assert {r["score"] for r in found} == {2**13}
