"""Side vectors, the table of all features, and cross-fitted learners."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from twinlens.functions import text as T
from twinlens.jobs import learn
from twinlens.operators import features, lookup, sides
from twinlens.sources.pairs import derived_pairs, read_table


@pytest.fixture(scope="module")
def pairs(spark, small):
    return derived_pairs(spark, small).persist()


def test_side_vectors(spark, small, pairs):
    numbered = sides.numbered_sides(pairs).persist()
    train = numbered.where("pair_id % 2 = 0")
    stats = sides.statistics(train)
    scaled = sides.standardise(train, stats).toPandas()
    assert len(scaled) == train.count() and np.allclose(scaled[list(sides.NUMBERS)].mean(), 0, atol=1e-9)
    assert np.allclose(scaled[list(sides.NUMBERS)].std(ddof=0), 1, atol=1e-3)
    vectors = {(r["pair_id"], r["side"]): r["vector"] for r in sides.side_vectors(pairs, read_table(spark, small, "embeddings"), stats).collect()}
    assert len(vectors) == 2 * pairs.count()
    row = pairs.first()
    own = [float(x) for x in read_table(spark, small, "embeddings").where(F.col("vec_id") == row["base_vec_id"]).first()["embedding"]]
    other = sides.standardise(numbered, stats).where((F.col("pair_id") == row["pair_id"]) & (F.col("side") == "base")).first()
    assert vectors[row["pair_id"], "base"] == pytest.approx([*own, *(other[n] for n in sides.NUMBERS)])
    both = sides.pair_vectors(sides.side_vectors(pairs, read_table(spark, small, "embeddings"), stats)).where(F.col("pair_id") == row["pair_id"]).first()
    assert both["base"] == vectors[row["pair_id"], "base"] and both["cand"] == vectors[row["pair_id"], "cand"]


def test_all_features(spark, small):
    got = entry.queries()["pair_features"](spark, small)
    assert len(got.columns) == 1 + 58 and got.count() == got.select("pair_id").distinct().count() == derived_pairs(spark, small).count()


def test_tower_of_pairs(spark):
    rng = np.random.default_rng(0)
    w = (rng.normal(size=(3, 4)), rng.normal(size=4), rng.normal(size=(4, 2)), rng.normal(size=2))
    a, b = rng.normal(size=(2, 5, 3))
    rows = [(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b))] + [(9, None, [0.0] * 3)]
    got = {r["i"]: r["tower_sim"] for r in lookup.tower_pairs(spark.createDataFrame(rows, "i int, b array<double>, c array<double>"), "b", "c", w, ("i",)).collect()}

    def plain(v):
        z = np.maximum(v @ w[0] + w[1], 0) @ w[2] + w[3]
        return z / np.linalg.norm(z)

    assert got[9] is None and all(got[i] == pytest.approx(1 / (1 + np.sqrt(((plain(a[i]) - plain(b[i])) ** 2).sum() + 1e-12))) for i in range(5))


@pytest.fixture(scope="module")
def learnable(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        y = int(rng.random() < 0.3)
        v = rng.normal(size=3) + (2 * y if i % 2 else y)
        rows.append((i, i // 4, y, i % 3, [float(x) for x in v], float(v[0]), float(rng.normal())))
    return spark.createDataFrame(rows, "pair_id long, g long, is_double int, fold int, v array<double>, title_a double, price_b double").persist()


def test_stack(spark, learnable):
    odd = spark.createDataFrame([(900, 900, 0, 0, None, 0.0, 0.0)], learnable.schema)
    train, held = learn.stack(learnable.where("pair_id < 300").unionByName(odd), "g", "v", (learnable.where("pair_id >= 300"),))
    rows = {r["pair_id"]: r["stack_sim"] for r in train.collect()}
    assert len(rows) == 301 and rows.pop(900) is None and all(0 <= x <= 1 for x in rows.values())
    score = held.toPandas()
    assert len(score) == 100 and score[score.is_double == 1].stack_sim.mean() > score[score.is_double == 0].stack_sim.mean() + 0.2
    again, = learn.stack(learnable.where("pair_id < 300"), "g", "v")
    assert {r["pair_id"]: r["stack_sim"] for r in again.collect()} == pytest.approx(rows, abs=0.05)


def test_out_of_fold_and_ablation(spark, learnable):
    columns = ["title_a", "price_b"]
    oof, models = learn.out_of_fold(learnable, columns, n_splits=3, trees=4, depth=2)
    scored = oof.toPandas()
    assert len(scored) == 400 and len(models) == 3 and scored[scored.is_double == 1].score.mean() > scored[scored.is_double == 0].score.mean()
    mean = learn.average_prediction(models, learnable, columns).toPandas()
    one = [learn.predict(m, learnable, columns, "p").toPandas().set_index("pair_id").p for m in models]
    assert np.allclose(mean.set_index("pair_id").score.sort_index(), (sum(one) / 3).sort_index())
    assert not [c for c in mean.columns if c.startswith("_")] and len(mean) == 400
    top = learn.importances(models, columns, top=1).collect()
    assert [r["feature"] for r in top] == ["title_a"]
    told = {r["name"]: r for r in learn.ablation(learnable, columns, {"no titles": ("title_",)}, trees=4, depth=2).collect()}
    assert told["all"]["features"] == 2 and told["no titles"]["features"] == 1 and told["all"]["pr_auc"] > told["no titles"]["pr_auc"]
    assert features.drop_groups(learnable, ("title_",)).columns == ["pair_id", "g", "is_double", "fold", "v", "price_b"]


@pytest.mark.parametrize(("name", "learner"), [("ablation", "ablation"), ("importances", "out_of_fold")])
def test_registered_learners_are_whole(spark, small, monkeypatch, name, learner):
    """Five folds, and the trees of the functions' defaults."""
    seen, own = {}, inspect.signature(getattr(learn, learner))

    def learned(*args, **kw):
        seen.update(own.bind(*args, **kw).arguments)
        return args[0], []

    monkeypatch.setattr(learn, learner, learned)
    entry.queries()[name](spark, small)
    assert seen["df"].select("fold").distinct().count() == 5 and seen.get("n_splits", 5) == 5
    trees = inspect.signature(learn.fit_gbt).bind(seen["df"], seen["columns"], **seen.get("kw", {}))
    trees.apply_defaults()
    assert (trees.arguments["trees"], trees.arguments["depth"]) == (20, 4)


def test_vocabulary_maps_each_word_once(spark):
    df = spark.createDataFrame([("Aa b, Aa!",), (None,), ("b 12 c3",)], "t string")
    got = {r["token"]: (r["mapped"], r["n"]) for r in T.vocabulary(df, "t", F.upper).collect()}
    assert got == {"Aa": ("AA", 2), "b": ("B", 2), "c": ("C", 1)}


def test_nfkc_of_what_needs_it(spark):
    import unicodedata

    texts = ["plain", "ünï", "Кириллица й", "ﬁne", "e\u0301", "½", "ＡＢＣ", "한국어", "中文", "²", "\u00a0x", "ſ", "…", "№5", None, ""]
    got = [r["x"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.to_nfkc(F.col("t")).alias("x")).collect()]
    assert got == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]


def test_nothing_stable_changes():
    import re
    import unicodedata

    stable = re.compile(f"[{T._NFKC_STABLE}]")
    kept = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and stable.match(chr(i))]
    assert len(kept) > 20000 and all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in kept)
