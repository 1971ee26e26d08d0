import numpy as np
import pytest

from twinlens.operators import ranking


def brute(y, s):
    y, s = np.array(y), np.array(s, dtype=float)
    ap = sum((y[s >= t].sum() - y[s > t].sum()) / y.sum() * y[s >= t].mean() for t in np.unique(s))
    pos, neg = s[y == 1], s[y == 0]
    return ap, ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_auc_with_ties(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 500), rng.integers(0, 40, 500)
    df = spark.createDataFrame([(int(a), float(b), int(i % 3)) for i, (a, b) in enumerate(zip(y, s))], "y int, s double, k int")
    r = ranking.auc_metrics(df, "s", "y").first()
    assert (r["pr_auc"], r["roc_auc"]) == pytest.approx(brute(y, s))
    for r in ranking.auc_metrics(df, "s", "y", ("k",)).collect():
        own = np.arange(500) % 3 == r["k"]
        assert (r["pr_auc"], r["roc_auc"]) == pytest.approx(brute(y[own], s[own]))


def test_missing_class_and_empty(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert ranking.auc_metrics(df, "s", "y").first()["roc_auc"] is None
    assert ranking.auc_metrics(df.limit(0), "s", "y").first()["pr_auc"] is None
    assert ranking.rank_normalize(df.limit(0), "s", "r").count() == 0


def test_ranks(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (3.0,), (2.0,)], "s double")
    assert sorted(r["r"] for r in ranking.rank_normalize(df, "s", "r").collect()) == pytest.approx([1 / 6, 1 / 6, 2 / 3, 1])
    assert [r["r"] for r in ranking.rank_normalize(df.limit(1), "s", "r").collect()] == [0.5]
    constant = spark.createDataFrame([(1.0,)] * 5, "s double")
    assert {r["r"] for r in ranking.rank_normalize(constant, "s", "r").collect()} == {0.5}


def test_blend_ends_are_single_rankings(spark):
    df = spark.createDataFrame([(1, 1.0, 9.0), (2, 2.0, 8.0), (3, 3.0, 7.0)], "i int, a double, b double")
    for w, name in ((1.0, "rank_a"), (0.0, "rank_b")):
        assert all(r["blend"] == r[name] for r in ranking.rank_blend(df, "a", "b", w).collect())
    with pytest.raises(ValueError):
        ranking.rank_blend(df, "a", "b", 1.2)


def test_map(spark):
    df = spark.createDataFrame([("g", 1, 3.0, 1), ("g", 0, 2.0, 2), ("g", 1, 1.0, 3), ("h", 0, 1.0, 4), ("k", 1, 1.0, 5), ("k", 0, 1.0, 6)], "g string, y int, s double, t int")
    got = {r["g"]: r["ap"] for r in ranking.map_by_group(df, "g", "y", "s", "t").collect()}
    assert got == pytest.approx({"g": (1 + 2 / 3) / 2, "k": 1.0})
    assert {r["g"]: r["ap"] for r in ranking.map_by_group(df, "g", "y", "s", "t", skip_empty=False).collect()}["h"] == 0
    assert ranking.mean_average_precision(df.limit(0), "g", "y", "s", "t").first()["map"] == 0


def test_no_window_over_all_rows(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ORDERED_ROWS", 50)
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 600), rng.integers(0, 300, 600)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    plan = ranking.score_table(df, "s", "y")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bucket" in plan
    r = ranking.auc_metrics(df, "s", "y").first()
    assert (r["pr_auc"], r["roc_auc"]) == pytest.approx(brute(y, s))


def test_large_groups_are_ranked_in_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [("hot" if i % 3 else f"g{i % 7}", int(rng.integers(0, 2)), float(rng.integers(0, 50)), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, y int, s double, t int")
    whole = {r["g"]: (r["ap"], r["n_pos"]) for r in ranking.map_by_group(df, "g", "y", "s", "t").collect()}
    parts = {r["g"]: (r["ap"], r["n_pos"]) for r in ranking.map_by_group(df, "g", "y", "s", "t", rows=40).collect()}
    assert parts.keys() == whole.keys() and all(parts[g] == pytest.approx(whole[g]) for g in whole)


def test_compare_splits(spark):
    df = spark.createDataFrame([("group", 0, 0.4), ("group", 1, 0.6), ("random", 0, 0.6), ("random", 1, 0.9)], "split string, fold int, pr_auc double")
    got = {r["split"]: (r["pr_auc"], r["over_group"]) for r in ranking.compare_splits(df, "group").collect()}
    assert got["group"] == (0.5, 1) and got["random"] == pytest.approx((0.75, 1.5))


def test_states_of_parts_merge(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 2)), None if i % 50 == 0 else float(rng.integers(0, 60)), i % 4) for i in range(800)]
    df = spark.createDataFrame(rows, "y int, s double, part int")
    whole = ranking.auc_metrics(df, "s", "y").first()
    halves = [ranking.score_states(df.where(f"part % 2 = {h}"), "s", "y", ("part",)) for h in (0, 1)]
    merged = ranking.auc_of_states(ranking.merge_states(halves[0].unionByName(halves[1]))).first()
    assert merged == whole and whole["rows"] == 784
    by = {r["part"]: r["pr_auc"] for r in ranking.auc_of_states(ranking.merge_states(halves[0].unionByName(halves[1]), ("part",)), ("part",)).collect()}
    assert by == pytest.approx({r["part"]: r["pr_auc"] for r in ranking.auc_metrics(df, "s", "y", ("part",)).collect()})
    empty = ranking.auc_of_states(ranking.merge_states(halves[0].limit(0))).first()
    assert empty["pr_auc"] is None
    known = ranking.rank_normalize(df, "s", "r", ranking.score_states(df.where("s < 30"), "s"))
    alone = {(r["s"], r["r"]) for r in ranking.rank_normalize(df.where("s < 30"), "s", "r").collect()}
    assert {(r["s"], r["r"]) for r in known.where("s < 30").collect()} == alone and known.where("s >= 30 and r is not null").count() == 0


def test_levels_equal_single_metrics(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ORDERED_ROWS", 40)
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 2)), float(rng.integers(0, 90)), None if i % 3 == 0 else f"k{i % 3}", i % 2) for i in range(700)]
    df = spark.createDataFrame(rows, "y int, s double, k string, f int")
    got = {(r["level"], r["k"], r["f"]): (r["rows"], r["pr_auc"], r["roc_auc"]) for r in ranking.auc_levels(df, "s", "y", ((), ("k",), ("k", "f"))).collect()}
    want = {}
    for level in ((), ("k",), ("k", "f")):
        for r in ranking.auc_metrics(df, "s", "y", level).collect():
            r = r.asDict()
            want[",".join(level), r.get("k"), r.get("f")] = (r["rows"], r["pr_auc"], r["roc_auc"])
    assert len(got) == 1 + 3 + 6 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_ranges_by_binary_search(spark):
    scores = [None, float("nan"), float("-inf"), float("inf"), 0.0, -0.0, *(float(i) for i in range(200))]
    df = ranking.materialize(spark.createDataFrame([(s,) for s in scores], "s double"), "ranges")
    rows = ranking._in_ranges(df, "s", 8, "b").collect()
    assert {r["b"] for r in rows if r["s"] == 0} == {0} and {r["b"] for r in rows if r["s"] is None} == {0}
    finite = sorted((r["s"], r["b"]) for r in rows if r["s"] is not None and r["s"] == r["s"])
    assert [b for _, b in finite] == sorted(b for _, b in finite) and len({b for _, b in finite}) == 8
    assert all(r["b"] >= finite[-1][1] for r in rows if r["s"] is not None and r["s"] != r["s"])
    # the cost of a row is a search, not a chain of comparisons
    plan = ranking._in_ranges(df, "s", 100, "b")._jdf.queryExecution().executedPlan().toString()
    assert "filter(" not in plan.lower().replace("filters:", "")
