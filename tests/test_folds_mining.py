import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlens.operators import folds, lookup, mining, photos
from twinlens.sources.pairs import derived_pairs, last_part, read_pairs, sides
from twinlens.sources import sinks


@pytest.fixture(scope="module")
def pairs(spark, small):
    return derived_pairs(spark, small).persist()


def test_group_folds(pairs):
    folded = folds.group_folds(pairs, "group_id").persist()
    assert folded.groupBy("group_id").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    sizes = [r["count"] for r in folded.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and sum(sizes) == pairs.count()
    largest = pairs.groupBy("group_id").count().agg(F.max("count")).first()[0]
    assert max(sizes) - min(sizes) <= largest
    for r in folds.leakage(folded, "fold").collect():
        assert 0 <= r["overlap_ratio"] <= 1 and r["n_leaked_items"] <= r["n_valid_items"]
    one = folds.leakage_between(folded.where("fold <> 0"), folded.where("fold = 0")).first()
    assert one["n_leaked_items"] == folds.leakage(folded, "fold").where("fold = 0").first()["n_leaked_items"]
    assert folds.leakage_between(folded, folded.limit(0)).first()["overlap_ratio"] == 0


def plain_loads(sizes, k):
    """Each group on the lightest fold, largest first."""
    loads = [0] * k
    for n in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += n
    return loads


def test_places_by_histogram_equal_places_one_by_one():
    rng = np.random.default_rng(5)
    for _ in range(200):
        k = int(rng.integers(1, 7))
        sizes = [int(x) for x in rng.choice([1, 1, 1, 2, 3, 7, 50, 1000], rng.integers(1, 60))]
        histogram = {n: sizes.count(n) for n in sizes}
        placed = folds.place_histogram(histogram, k)
        assert all(sum(placed[n]) == c for n, c in histogram.items())
        assert [sum(n * placed[n][f] for n in placed) for f in range(k)] == plain_loads(sizes, k)
    placed = folds.place_histogram({1: 10**12, 10**9: 3, 7: 10**10}, 5)  # a trillion groups in a moment
    loads = [sum(n * p[f] for n, p in placed.items()) for f in range(5)]
    assert max(loads) - min(loads) <= 1


@pytest.mark.parametrize("narrow", [True, False])
def test_balanced_folds_of_many_groups(spark, monkeypatch, narrow):
    """30,000 groups, one of which holds a third of all rows, and a null one."""
    if not narrow:
        monkeypatch.setattr(folds, "BROADCAST_ROWS", 100)
    df = spark.range(60_000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 1000 = 1 then null else cast(id div 2 as string) end as g")
    folded = folds.group_folds(df, "g", 4).persist()
    assert folded.columns == ["id", "g", "fold"] and folded.select("id").distinct().count() == 60_000
    sizes = [r["count"] for r in df.groupBy("g").count().collect()]
    assert sorted(r["count"] for r in folded.groupBy("fold").count().collect()) == sorted(plain_loads(sizes, 4))
    assert folded.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()
    other = folds.group_folds(df, "g", 4, seed=1)
    assert folded.join(other.withColumnRenamed("fold", "f2"), "id").where("fold <> f2").count() > 1000
    assert folds.group_folds(df.limit(0), "g").count() == 0


def test_samples(pairs):
    assert folds.exact_sample(pairs, "pair_id", 10).count() == 10
    kept = folds.subsample_negatives(pairs, "pair_id", "is_double", 2)
    n = pairs.where("is_double = 1").count()
    assert kept.where("is_double = 1").count() == n and kept.where("is_double = 0").count() == 2 * n
    batches = folds.balanced_batches(pairs, "pair_id", "is_double", 3, 64).groupBy("batch", "y").count().collect()
    assert len(batches) == 6 and all(r["count"] == 32 for r in batches)


def test_large_samples_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(folds, "SORTED_ROWS", 20)
    df = spark.range(500).selectExpr("id", "if(id % 3 = 0, 'rare', 'hot') as bucket").persist()
    order = [r["id"] for r in df.orderBy(folds.draw(F.col("id").cast("string"), F.lit("42")), "id").collect()]
    for k in (5, 200, 499, 600):
        assert sorted(r["id"] for r in folds.exact_sample(df, "id", k).collect()) == sorted(order[:k])
    whole = {r["id"]: (r["place"], r["size"]) for r in folds.ranks_in_buckets(df, "bucket", "id").collect()}
    parts = {r["id"]: (r["place"], r["size"]) for r in folds.ranks_in_buckets(df, "bucket", "id", rows=10).collect()}
    assert parts == whole and sorted(p for i, (p, _) in whole.items() if i % 3) == list(range(333))


def test_nested_folds(pairs):
    nested = folds.nested_folds(pairs.select("pair_id", "group_id"), "group_id").persist()
    outer = folds.group_folds(pairs.select("pair_id", "group_id"), "group_id").persist()
    for k in range(5):
        inside = nested.where(F.col("outer") == k)
        assert {r["pair_id"] for r in inside.select("pair_id").collect()} == {r["pair_id"] for r in outer.where(F.col("fold") != k).collect()}
        assert inside.groupBy("group_id").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty() and inside.select("fold").distinct().count() <= 3
        sizes = [r["count"] for r in inside.groupBy("group_id").count().collect()]
        assert sorted(r["count"] for r in inside.groupBy("fold").count().collect()) == sorted(plain_loads(sizes, 3))


def test_random_negatives(spark):
    """Anchors that no bucket serves get a negative of the whole pool."""
    rows = [(i, i, f"c{i}", int(i < 4)) for i in range(40)]
    names = ("category_name", "subcategory_name", "param1", "param2")
    df = spark.createDataFrame(rows, "pair_id long, base_item_id long, c string, is_double int")
    df = df.select("pair_id", "base_item_id", "is_double", *(F.col("c").alias(f"base_{n}") for n in names), *(F.lit("none").alias(f"cand_{n}") for n in names))
    found = mining.mine_triplets(df, 3).collect()
    assert len(found) == 12 and {r["level"] for r in found} == {5} and all(r["neg_pair"] >= 4 for r in found)


def test_mining(pairs):
    found = mining.mine_triplets(pairs, 2).persist()
    assert found.count() == 2 * pairs.where("is_double = 1").count()
    negative = found.join(pairs.select(F.col("pair_id").alias("neg_pair"), "is_double"), "neg_pair")
    assert negative.where("is_double <> 0").count() == 0
    own = pairs.where("is_double = 0").select("base_item_id").distinct()
    has = found.join(pairs.select(F.col("pair_id").alias("anchor_pair"), "base_item_id"), "anchor_pair").join(own, "base_item_id", "left_semi")
    assert has.where("level <> 0").count() == 0
    assert mining.level_counts(found).agg(F.sum("n")).first()[0] == found.count()
    with pytest.raises(ValueError):
        mining.mine_triplets(pairs.where("is_double = 1"))


def test_lookup(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "k long, embedding array<float>")
    p = spark.createDataFrame([(1, 1, 2), (2, 1, 1), (3, 1, None), (4, 9, 1)], "pair_id long, b long, c long")
    got = {r["pair_id"]: r for r in lookup.embedding_pair_features(p, table, "k", "b", "c", ("pair_id",)).collect()}
    assert got[1]["emb_cosine"] == 0 and got[1]["emb_l2"] == pytest.approx(2**0.5) and got[1]["emb_diff_std"] == 0 and got[2]["emb_cosine"] == 1
    assert got[3]["emb_cosine"] is None and got[4]["emb_l2"] is None
    texts = lookup.unique_texts(spark.createDataFrame([("a", "b"), ("a", None)], "x string, y string"), "x", "y")
    assert texts.count() == 2
    first = lookup.encode_unique(texts.where("text = 'a'"))
    assert lookup.encode_unique(texts, known=first).count() == 1
    w = (np.eye(2), np.zeros(2), np.eye(2), np.zeros(2))
    scores = lookup.tower_score(p, lookup.apply_tower(table, "k", "embedding", w), "k", "b", "c", ("pair_id",))
    assert {r["pair_id"]: r["tower_sim"] for r in scores.collect()}[2] == pytest.approx(1, abs=1e-5)


def test_photos(spark, tmp_path):
    grid = [0, 1] * 36
    df = spark.createDataFrame([("a", bytes(range(72))), ("b", b"bad"), ("c", bytes(reversed(range(72))))], "image_key string, content binary")
    got = {r["image_key"]: r for r in photos.hash_photos(df, lambda c: list(c) if len(c) == 72 else None).collect()}
    assert got["a"]["dhash"] == -1 and got["c"]["dhash"] == 0 and got["b"]["found"] is False
    want = int("".join(str(int(grid[r * 9 + k + 1] > grid[r * 9 + k])) for r in range(8) for k in range(8)), 2)
    value = spark.range(1).select(photos.dhash(F.array(*map(F.lit, grid))).alias("h")).first()["h"]
    assert value % 2**64 == want
    images = spark.createDataFrame([("a", -1, [1.0], True), ("c", 0, [1.0], True), ("x", 5, [1.0], False)], "image_key string, dhash long, embedding array<float>, found boolean")
    p = spark.createDataFrame([(1, "a", "c"), (2, "a", ""), (3, "a", "x"), (4, None, None), (5, "a", "a")], "i int, b string, c string")
    f = {r["i"]: r for r in photos.photo_pair_features(p, images, "b", "c", ("i",)).collect()}
    assert f[1]["image_dhash_distance"] == 1 and f[1]["image_hash_pair_known"] == 1 and f[1]["image_missing"] == 0
    assert f[2]["image_missing"] == 1 and f[2]["image_hash_pair_known"] == 0
    assert f[3]["image_missing"] == 0 and f[3]["image_cosine"] == 0 and f[4]["image_missing"] == 1 and f[5]["image_dhash_equal"] == 1
    (tmp_path / "one").mkdir()
    for name in ("a.jpg", "one/a.png", "c.JPG", "skip.txt"):
        (tmp_path / name).write_bytes(b"x")
    keys = spark.createDataFrame([("a",), ("c",), ("z",)], "image_key string")
    located = photos.locate_photos(spark, [str(tmp_path)], keys)
    assert {r["image_key"] for r in located.collect()} == {"a", "c"} and photos.location_stats(located).first()["n_files"] == 2
    assert [r["image_key"] for r in photos.still_to_encode(keys, images).collect()] == ["z"]


def test_first_root_wins(spark, tmp_path):
    for name in ("two/a.jpg", "one/z/a.jpg", "one/y/a.jpg", "one/y/deep/b.jpg", "one/b.jpg", "two/y/c.jpg", "one/x/y/c.jpg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "image_key string")
    got = {r["image_key"]: r["path"].split(str(tmp_path))[1] for r in photos.locate_photos(spark, [str(tmp_path / "one"), str(tmp_path / "two")], keys).collect()}
    assert got == {"a": "/one/y/a.jpg", "b": "/one/b.jpg", "c": "/two/y/c.jpg"}


def test_encode_table_grows(spark, tmp_path):
    """A second run encodes only what the first one hasn't, and a photo that couldn't be read is tried again."""
    path = str(tmp_path / "encoded")
    assert photos.load_encoded(spark, path) is None
    for name in ("a", "b"):
        (tmp_path / f"{name}.bin").write_bytes(bytes(range(72)) if name == "a" else b"bad")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "image_key string")
    decode = lambda c: list(c) if len(c) == 72 else None
    encode = lambda cs: np.array([[len(c), 1.0] for c in cs])

    def files():
        read = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(str(tmp_path))
        return read.select(F.regexp_extract("path", r"([^/]+)\.bin$", 1).alias("image_key"), "content")

    first = photos.encode_photos(files(), keys, decode, encode)
    assert {r["image_key"]: (r["dhash"], r["embedding"], r["found"]) for r in first.collect()} == {"a": (-1, [72.0, 1.0], True), "b": (None, None, False), "c": (None, None, False)}
    photos.save_encoded(first, path)
    (tmp_path / "b.bin").write_bytes(bytes(reversed(range(72))))
    second = photos.encode_photos(files(), keys, decode, lambda cs: encode(cs) + 1, photos.load_encoded(spark, path))
    assert {r["image_key"]: (r["dhash"], r["embedding"], r["found"]) for r in second.collect()} == {"a": (-1, [72.0, 1.0], True), "b": (0, [73.0, 2.0], True), "c": (None, None, False)}


def test_sources_and_sinks(spark, pairs, tmp_path):
    path = str(tmp_path / "pairs")
    pairs.repartition(3).write.parquet(path)
    back = read_pairs(spark, path)
    assert back.count() == pairs.count() and "pair_id" not in back.columns
    last = last_part(spark.read.parquet(path))
    assert 0 < last.count() < pairs.count()
    assert [f.split("/")[-1] for f in sorted(r["f"] for r in last.select(F.input_file_name().alias("f")).distinct().collect())] == [max(f.split("/")[-1] for f in spark.read.parquet(path).inputFiles())]
    assert sides(pairs).count() == 2 * pairs.count()
    sinks.write_report({"counts": pairs.groupBy("is_double").count(), "all": pairs.agg(F.count("*").alias("n"))}, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1
    sinks.write_predictions(pairs.select(F.col("is_double").alias("y"), F.col("base_item_id").alias("base_id"), F.lit(0.5).alias("model_a")), str(tmp_path / "oof"))
    assert spark.read.parquet(str(tmp_path / "oof")).columns == ["y", "base_id", "model_a"] and spark.read.parquet(str(tmp_path / "oof")).count() == pairs.count()
    sinks.write_submission(pairs.select(F.col("base_item_id").alias("base_id"), F.col("cand_item_id").alias("cand_id"), F.lit(0.5).alias("probability")), str(tmp_path / "sub"))
    assert spark.read.option("header", True).csv(str(tmp_path / "sub")).columns == ["base_id", "cand_id", "probability"]
