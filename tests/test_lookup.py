"""Lookups where one key holds half of all pairs and another half is blank."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlens.operators import lookup


@pytest.fixture
def shuffling(spark):
    """Joins shuffle, partitions aren't merged: what meets in one task is seen."""
    new = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.maxPartitionBytes": "64k"}
    before = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def skewed(spark, n=40_000):
    """Half of the pairs have one base key, half a null candidate key; candidates that have one are popular or rare."""
    return spark.range(0, n, 1, 16).selectExpr("id as pair_id", "case when id % 2 = 0 then 'popular' else concat('k', id % 5000) end as base", "case when id % 4 < 2 then null when id % 4 = 2 then 'popular' else concat('k', id % 7000) end as cand")


def test_heavy_keys(spark):
    df = spark.range(100_000).selectExpr("case when id % 3 = 0 then 5 when id % 3 = 1 then null else id end as a", "cast(id % 100 as string) as b")
    assert lookup.heavy_keys(df, "a") == [5]
    assert sorted(lookup.heavy_keys(df, "b")) == sorted(map(str, range(100)))
    assert lookup.heavy_keys(df.limit(0), "a", "b") == []


def test_no_task_has_most_pairs(shuffling):
    pairs = skewed(shuffling)
    table = shuffling.range(6000).selectExpr("case when id = 0 then 'popular' else concat('k', id) end as key", "id as value").unionByName(shuffling.createDataFrame([(None, -1)], "key string, value long"))
    met = lookup.lookup_both(pairs, table, "key", "base", "cand", ("value",)).withColumn("task", F.spark_partition_id()).persist()
    known = {f"k{i}": i for i in range(1, 6000)} | {"popular": 0}
    for r in met.collect():
        assert r["base_value"] == known.get(r["base"]) and r["cand_value"] == known.get(r["cand"])
    assert met.count() == 40_000 == met.select("pair_id").distinct().count()
    assert max(r["count"] for r in met.groupBy("task").count().collect()) < 40_000 * 0.15
    # the plain join has one task with half of all pairs
    plain = pairs.join(table.withColumnRenamed("key", "base"), "base", "left").withColumn("task", F.spark_partition_id())
    assert max(r["count"] for r in plain.groupBy("task").count().collect()) > 40_000 * 0.45


def test_null_and_heavy_keys_are_not_shuffled(shuffling):
    """Of 40,000 pairs 10,000 have neither side popular or null: the other ones are shuffled for one side at most."""
    pairs = lookup.materialize(skewed(shuffling), "test-pairs")
    table = shuffling.range(6000).selectExpr("concat('k', id) as key", "id as value")
    heavy = lookup.heavy_keys(pairs, "base", "cand")
    assert heavy == ["popular"]
    one = lookup.lookup(pairs, table, "key", "base", {"v": "value"}, heavy)
    # the branch of heavy and null keys has no exchange of pairs
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "UnionLoop" not in plan and plan.count("Join LeftOuter") == 2 and "strategy=broadcast" in plan
    assert one.where("v is null").count() == pairs.where("base = 'popular'").count() and one.where("base = 'popular' and v is not null").isEmpty()


def test_vectors_of_popular_and_missing_keys(spark):
    rng = np.random.default_rng(0)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(50)], "vec_id long, embedding array<double>")
    pairs = spark.range(2000).selectExpr("id as pair_id", "case when id % 2 = 0 then 7 else id % 60 end as a", "case when id % 3 = 0 then null else id % 50 end as b")
    table = {r["vec_id"]: np.array(r["embedding"]) for r in vectors.collect()}
    got = lookup.embedding_pair_features(pairs, vectors, "vec_id", "a", "b", ("pair_id", "a", "b")).collect()
    assert len(got) == 2000
    for r in got:
        x, y = table.get(r["a"]), table.get(r["b"])
        if x is None or y is None:
            assert r["emb_cosine"] is None
        else:
            assert abs(r["emb_cosine"] - x @ y / np.linalg.norm(x) / np.linalg.norm(y)) < 1e-9


def test_count_states_merge(spark):
    df = spark.range(30_000).selectExpr("id % 3 as part", "cast(id % 9000 as string) as a", "case when id % 2 = 0 then null else concat('b', id % 50) end as b")
    states = lookup.materialize(lookup.count_states(df, ("a", "b"), "part"), "test-states")
    both = lookup.merge_counts(states).first()
    assert both["parts"] == 3 and abs(both["estimate"] - 9025) <= 9025 * lookup.SKETCH_BOUND
    assert max(len(r["state"]) for r in states.collect()) < 20_000
    assert sorted(r["part"] for r in lookup.merge_counts(states, "part").collect()) == [0, 1, 2]


def test_distinct_sides_are_encoded_once(spark):
    from twinlens.operators import sides

    columns = ("item_id long", "title string", "description string", "category_name string", "subcategory_name string", "param1 string", "param2 string", "json_params string", "price double", "count_images int", "title_image string", "vec_id long")
    schema = "pair_id long, " + ", ".join(f"{s}_{c}" for s in ("base", "cand") for c in columns)
    item = lambda i: (i, f"title {i % 3}", None if i % 2 else "text", "", "", "", "", "", float(i % 3), i % 2, "", i % 4 if i % 5 else None)
    pairs = spark.createDataFrame([(k, *item(k), *item(k * 7 % 30)) for k in range(60)], schema)
    table = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "vec_id long, embedding array<double>")
    keyed, distinct = sides.keyed_sides(pairs).collect(), {r["side_key"]: r["vector"] for r in sides.distinct_side_vectors(pairs, table).collect()}
    assert len(distinct) < 40 and distinct.keys() == {r[s] for r in keyed for s in ("base_side", "cand_side")}
    whole = {(r["pair_id"], r["side"]): r["vector"] for r in sides.side_vectors(pairs, table).collect()}
    for r in keyed:
        for s in ("base", "cand"):
            assert distinct[r[f"{s}_side"]] == pytest.approx(whole[r["pair_id"], s])
