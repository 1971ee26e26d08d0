"""The store of encodes: appends, the newest row, crashes between write and commit, compaction, joins that leave the base where it is."""

import os

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from twinlens.sources.store import EncodeStore


def rows(spark, ids, run, found=lambda i: True):
    return spark.createDataFrame([(f"k{i}", i * 10 + run, found(i), run) for i in ids], "image_key string, dhash long, found boolean, run int")


def content(store):
    return {r["image_key"]: (r["dhash"], r["found"], r["run"]) for r in store.rows().collect()}


def keys(spark, ids):
    return spark.createDataFrame([(f"k{i}",) for i in ids], "image_key string")


def missing(store, spark, ids):
    return sorted(int(r["image_key"][1:]) for r in store.missing(keys(spark, ids)).collect())


@pytest.fixture
def store(spark, tmp_path):
    return EncodeStore(spark, f"file://{tmp_path}/store", buckets=4)


def test_grows_until_nothing_is_missing(spark, store):
    assert store.rows() is None and store.latest() == (0, []) and missing(store, spark, range(3)) == [0, 1, 2]
    assert store.append(rows(spark, range(100), 1, lambda i: i % 10 > 0)) == 1
    assert missing(store, spark, range(110)) == sorted([*range(0, 100, 10), *range(100, 110)])
    again = missing(store, spark, range(150))
    assert store.append(rows(spark, again, 2, lambda i: i != 20)) == 2
    assert missing(store, spark, range(150)) == [20]
    now = content(store)
    assert len(now) == 150 and now["k10"] == (102, True, 2) and now["k11"] == (111, True, 1) and now["k20"] == (202, False, 2)
    store.append(rows(spark, [5], 3, lambda i: False))  # the newest row counts, also if it isn't found
    assert missing(store, spark, range(150)) == [5, 20]
    assert store.append(rows(spark, [], 4)) == 3
    before = content(store)
    assert store.compact() == 4 and content(store) == before and len(store.latest()[1]) == 1
    assert missing(store, spark, range(151)) == [5, 20, 150]
    assert store.vacuum() == 3 and content(store) == before
    assert not spark.catalog.listTables()


def test_crash_before_commit_leaves_the_old_version(spark, store, monkeypatch):
    store.append(rows(spark, range(10), 1))
    before = content(store)
    with monkeypatch.context() as m:
        m.setattr(EncodeStore, "_publish", lambda *_: (_ for _ in ()).throw(OSError("the driver died")))
        with pytest.raises(OSError):
            store.append(rows(spark, range(20), 2))
    assert content(store) == before and store.latest()[0] == 1
    # a commit that was only begun doesn't count, and its name isn't used again
    stream = store._fs.create(store._folder("commits/0000000002.json"), False)
    stream.write(b'{"parts": [')
    stream.close()
    assert content(store) == before
    assert store.append(rows(spark, [30], 3)) == 3 and len(content(store)) == 11
    assert store.vacuum() == 1


def test_one_of_two_writers_wins(spark, store):
    name = store._next_name()
    part = store._write(rows(spark, [1], 1))
    store.append(rows(spark, [2], 1))
    with pytest.raises(Py4JJavaError):
        store._publish([part], name)
    assert set(content(store)) == {"k2"}


def test_the_base_is_not_shuffled(spark, store):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store.append(rows(spark, range(1000), 1))
        store.append(rows(spark, range(900, 1100), 2))
        assert store.missing(keys(spark, range(1200))).count() == 100
        # of the anti-join the new keys move, of the newest rows nothing does: parts lie in the same buckets
        for df, exchanges in ((store.missing(keys(spark, range(1200))), 1), (store.rows(), 0)):
            plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
            assert plan.count("Bucketed: true") >= 2 and plan.count("Exchange hashpartitioning") == exchanges, plan
        store.append(rows(spark, range(1100, 1110), 3))
        plan = store.missing(keys(spark, range(1200)))._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert plan.count("Bucketed: true") == 3 and plan.count("Exchange hashpartitioning") <= 2, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_parts_are_files_of_the_shared_folder(spark, store, tmp_path):
    store.append(rows(spark, range(50), 1))
    assert sorted(os.listdir(tmp_path / "store")) == ["commits", "parts"]
    other = EncodeStore(spark, f"file://{tmp_path}/store")  # another session finds it by its path alone
    assert len(content(other)) == 50 and other.rows().agg(F.sum("dhash")).first()[0] == sum(i * 10 + 1 for i in range(50))
