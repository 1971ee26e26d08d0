"""What keeps the work of large tables in proportion: tables stored once, keys shuffled instead of texts, cheap tests before costly ones."""

import __spark_entry__ as entry
import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from twinlens.functions import text as T
from twinlens.jobs import queries
from twinlens.operators import folds, lookup, mining, sides
from twinlens.sources import pairs as P


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_subsample_reads_its_pairs_once(spark, small):
    files = entry.queries()["negative_subsample"](spark, small).inputFiles()
    assert files and all("subsample-pairs-" in f for f in files)


def test_exact_count_of_texts_shuffles_keys(spark):
    df = spark.createDataFrame([("a", "b"), (None, "a"), ("c", None), ("", "b")], "x string, y string")
    counted = lookup.count_unique(df, "x", "y")
    assert counted.first()["texts"] == lookup.unique_texts(df, "x", "y").count() == 4
    keys = [x for x in plan(counted).splitlines() if "Exchange hashpartitioning" in x]
    assert keys and all("text_key" in x for x in keys)


def test_normal_form_looks_up_no_letter_and_matches_ascii_once(spark):
    texts = ["ё" * 3 + "мост 12", "ﬁne", "ＡＢＣ", "plain text", "снег — x", "été", "", None, "½ кот"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    normal = df.select("t", T.normalize(F.col("t")).alias("n"), F.translate(T.normalize(F.col("t"), fold=False), T.FOLD_CYRILLIC, T.FOLD_LATIN).alias("w"))
    assert all(r["n"] == r["w"] for r in normal.collect())
    assert dict(normal.select("t", "n").collect())["ﬁne"] == "fine"
    used = plan(df.select(T.normalize(F.col("t"))))
    assert "translate(" not in used


def test_repair_makes_no_array_of_runs(spark, monkeypatch):
    monkeypatch.setattr(T._Repairs, "KEPT", 2)  # the words found before are dropped now and then
    texts = {
        "Ябл\u006fк\u006f7z\u0430p_ж Ⅷж\u0061": "Яблоко7zap_ж Ⅷжа",  # runs end at digits and at _, not at letter-like numbers
        "n\u0430me n\u0430me, \u0441at's": "name name, cat's",
        "plain": "plain", "": "", None: "", "\u0430" * 70 + "z": "a" * 70 + "z", "  ё\u0061\n": "  ёа\n",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.restore_homoglyphs(F.col("t")).alias("r"))
    assert {r["t"]: r["r"] for r in df.collect()} == texts
    assert "regexp_extract_all" not in plan(df) and "transform(" not in plan(df)


@pytest.mark.parametrize(("name", "prepared"), [("build_features", ("translate(", "regexp_replace(")), ("feature_means_by_label", ("regexp_replace(",)), ("pair_features", ("regexp_replace(",)), ("encoder_text", ("_repair(",))])
def test_texts_are_prepared_before_they_are_paired(spark, small, name, prepared):
    df = entry.queries()[name](spark, small)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        optimized = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    paired = next(i for i, line in enumerate(optimized) if "Join Inner" in line and "block" in line)
    above = "\n".join(optimized[:paired])
    assert not any(f in above for f in prepared) and any(f in "\n".join(optimized[paired:]) for f in prepared)


@pytest.mark.parametrize("name", ["mining_levels", "mine_triplets", "triplet_losses"])
def test_bucket_keys_are_made_before_listings_are_paired(spark, small, monkeypatch, name):
    seen = []
    mine = mining.mine_triplets
    monkeypatch.setattr(mining, "mine_triplets", lambda pairs, *a, **k: seen.append(pairs) or mine(pairs, *a, **k))
    entry.queries()[name](spark, small)
    assert all(c.startswith("_") for c in [k._jc.toString() for s in ("base", "cand") for k in mining._keys(seen[0], s)[1:]])


def test_prepared_bucket_keys_give_the_same_triplets(spark, small):
    plain, prepared = (mining.mine_triplets(P.derived_pairs(spark, small, prepare=p), 2) for p in (None, mining.prepare_keys))
    assert sorted(plain.collect()) == sorted(prepared.collect()) != []


@pytest.mark.parametrize("name", ["photo_features", "photo_signal", "photo_cache", "photo_hashes", "nested_folds", "triplet_losses"])
def test_pairs_are_derived_once(spark, small, monkeypatch, name):
    """Parts are read by no plan but the one that stores what is derived from them."""
    made = []
    monkeypatch.setattr(queries, "derived_pairs", lambda *a, **k: made.append(1) or P.derived_pairs(*a, **k))
    files = entry.queries()[name](spark, small).inputFiles()
    assert len(made) == 1 and not [f for f in files if "part.parquet" in f]


@pytest.mark.parametrize("name", ["random_folds", "losses"])
def test_listings_meet_in_blocks(spark, small, name):
    met = [x for x in plan(entry.queries()[name](spark, small)).splitlines() if "Join" in x and "cluster#" in x]
    assert met and all("block#" in x for x in met)


def test_losses_join_vectors_to_listings(spark, small):
    """A listing is in about eight pairs, so vectors meet listings: pairs are neither stored nor shuffled for them."""
    df = entry.queries()["losses"](spark, small)
    assert not [f for f in df.inputFiles() if "lookup-pairs-" in f]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        optimized = entry.queries()["losses"](spark, small)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    paired = next(i for i, line in enumerate(optimized) if "Join Inner" in line and "block" in line)
    assert not [line for line in optimized[:paired] if "Join" in line]


def test_vectors_of_listings_are_those_looked_up(spark, small):
    keys = ("pair_id", "is_double", "base_vec_id", "cand_vec_id")
    vectors = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding")
    looked = lookup.lookup_both(P.derived_pairs(spark, small).select(*keys), vectors, "vec_id", "base_vec_id", "cand_vec_id", ("embedding",))
    own = P.derived_pairs(spark, small, vectors=True).select(*keys, "_base_embedding", "_cand_embedding")
    assert sorted(map(tuple, own.collect())) == sorted(tuple(r[c] for c in (*keys, "base_embedding", "cand_embedding")) for r in looked.collect()) != []


def above_the_pairs(df):
    """The optimized plan's lines above the join that pairs listings."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return lines[: next(i for i, line in enumerate(lines) if "Join Inner" in line and "block" in line)]


@pytest.fixture
def stored(monkeypatch):
    """What queries store, by name."""
    seen, write = {}, queries.materialize
    monkeypatch.setattr(queries, "materialize", lambda df, name: seen.setdefault(name, df) and write(df, name))
    return seen


def test_stacked_rows_are_not_shuffled(spark, small, stored):
    """Folds, vectors and numbers come with the listings; of descriptions their length alone is joined."""
    rows = queries._differences(spark, small)
    lines = stored["stacked"]._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in above_the_pairs(stored["stacked"]) if "Join" in x] and "length(text" in lines and "AS description" not in lines
    assert not [x for x in plan(rows).splitlines() if "Exchange hashpartitioning" in x] and all("stacked-" in f or "side-statistics-" in f for f in rows.inputFiles())


def test_stacked_rows_are_those_of_side_vectors(spark, small):
    pairs = P.derived_pairs(spark, small).persist()
    split = folds.group_folds(pairs.select("pair_id", "group_id"), "group_id")
    train = split.where("fold <> 0")
    stats = sides.statistics(sides.numbered_sides(pairs.join(train.select("pair_id"), "pair_id", "left_semi")))
    both = sides.pair_vectors(sides.side_vectors(pairs, spark.read.parquet(f"{small}/embeddings.parquet"), stats))
    want = {r["pair_id"]: r["x"] for r in both.select("pair_id", sides.absolute_difference(F.col("base"), F.col("cand")).alias("x")).collect()}
    outer, inner = (dict(f.select("pair_id", "fold").collect()) for f in (split, folds.group_folds(train, "group_id", 4, 43)))
    got = queries._differences(spark, small).collect()
    assert len(got) == len(want) == pairs.count()
    for r in got:
        assert (r["outer"], r["fold"]) == (outer[r["pair_id"]], inner.get(r["pair_id"]))
        assert r["known"] == (want[r["pair_id"]] is not None) and (not r["known"] or r["difference"] == pytest.approx(want[r["pair_id"]]))


def test_towers_encode_listings(spark, small, stored):
    """Pairs are neither stored nor shuffled, and of descriptions their length alone is joined; scores are those of distinct sides looked up for pairs."""
    df = entry.queries()["tower_scores"](spark, small)
    lines = df._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in above_the_pairs(df) if "Join" in x] and "length(text" in lines and "AS description" not in lines and set(stored) == {"side-statistics"}
    weights = (queries._weights(69, 32), np.zeros(32), queries._weights(32, 16), np.zeros(16))
    pairs = P.derived_pairs(spark, small).persist()
    encoded = lookup.apply_tower(sides.distinct_side_vectors(pairs, spark.read.parquet(f"{small}/embeddings.parquet")), "side_key", "vector", weights)
    want = dict(lookup.tower_score(sides.keyed_sides(pairs), encoded, "side_key", "base_side", "cand_side", ("pair_id",)).collect())
    got = dict(df.collect())
    assert got.keys() == want.keys() and all(got[k] == (None if x is None else pytest.approx(x, abs=6e-5)) for k, x in want.items())


def test_long_difference(spark):
    rows = [([1.0, 2.0], [3.5, 1.0]), (None, [1.0]), ([1.0], [1.0, 2.0]), ([], []), ([1.0] * 3, [2.0] * 3), (None, None)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>").select(sides.long_difference("a", "b").alias("x"))
    assert [r["x"] for r in df.collect()] == [[2.5, 1.0], None, None, [], [1.0] * 3, None]


def test_sides_read_pairs_once(spark, small):
    pairs = P.derived_pairs(spark, small).select("pair_id", "base_param1", "cand_param1")
    made = P.sides(pairs, ("param1", "price"))
    assert sorted(map(str, made.collect())) == sorted(str(Row(pair_id=r[0], side=s, param1=r[i])) for r in pairs.collect() for i, s in ((1, "base"), (2, "cand")))
    assert made.columns == ["pair_id", "side", "param1"]
    assert "Union" not in made._jdf.queryExecution().optimizedPlan().toString()
