import pytest
from pyspark.sql import functions as F

from twinlens.functions import attributes as A
from twinlens.operators import features

SCHEMA = "base_item_id long, cand_item_id long, " + ", ".join(f"{s}_{c} string" for c in ("title", "description", "category_name", "subcategory_name", "param1", "param2", "json_params", "price", "count_images", "title_image") for s in ("base", "cand")) + ", is_same_location boolean, is_same_region boolean"


def pair(spark, **over):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    values = {n: None for n in names} | {"base_item_id": 1, "cand_item_id": 2} | over
    return features.build_features(spark.createDataFrame([tuple(values[n] for n in names)], SCHEMA)).first().asDict()


def test_all_null(spark):
    f = pair(spark)
    assert len(f) == 2 + 47
    assert f["title_both_empty"] == 1 and all(v == 0 for k, v in f.items() if k.startswith("title_") and k not in ("title_both_empty", "title_image_equal"))
    assert f["price_missing"] == 1 and f["price_ratio"] is None and f["images_equal"] == 1 and f["images_max"] == 0
    assert f["same_param1"] == 1 and f["param1_missing"] == 1
    assert f["title_image_equal"] == 1 and f["title_image_both_present"] == 0
    assert f["params_value_match_ratio"] == -1 and f["params_n_base"] == 0 and f["is_same_region"] == 0


def test_text_and_prices(spark):
    f = pair(spark, base_title="abc", cand_title="ABC!", base_price="10", cand_price="2.5", base_description="abc def", cand_description="x")
    assert f["title_exact"] == 1 and f["title_digits_jaccard"] == -1 and f["title_lcp_ratio"] == 1
    assert (f["price_ratio"], f["price_abs_diff"], f["price_min"], f["price_max"], f["price_missing"]) == (0.25, 7.5, 2.5, 10, 0)
    assert f["cross_cand_title_in_base_desc"] == 1 and f["cross_base_title_in_cand_desc"] == 0


@pytest.mark.parametrize("price", ["0", "x", "-3", "1d", "inf", ""])
def test_bad_price(spark, price):
    f = pair(spark, base_price=price, cand_price="10")
    assert f["price_missing"] == 1 and all(f[f"price_{k}"] is None for k in ("ratio", "log_diff", "abs_diff", "min", "max"))


@pytest.mark.parametrize(("b", "c", "want"), [
    ('{"a":1,"b":"x"}', '{"a":1.0,"b":"y"}', (2, 1.0, 0.5, 2, 2)),
    ('{"a":1}', '{"b":1}', (0, 0.0, -1.0, 1, 1)),
    ("[1]", '{"b":1}', (0, 0.0, -1.0, 0, 1)),
    ("{bad", "", (0, 0.0, -1.0, 0, 0)),
    ('{"a":null}', '{"a":null}', (1, 1.0, 1.0, 1, 1)),
    ('{"a":"1"}', '{"a":1}', (1, 1.0, 0.0, 1, 1)),
])
def test_params(spark, b, c, want):
    f = pair(spark, base_json_params=b, cand_json_params=c)
    assert tuple(f[f"params_{k}"] for k in ("n_common_keys", "key_jaccard", "value_match_ratio", "n_base", "n_cand")) == pytest.approx(want)


def test_absent_columns_drop_their_block(spark):
    df = spark.createDataFrame([(1, 2, "a", "a", "", "", "1", "1", 0, 0)], "base_item_id long, cand_item_id long, base_title string, cand_title string, base_description string, cand_description string, base_price string, cand_price string, base_count_images int, cand_count_images int")
    columns = features.build_features(df).columns
    assert "params_n_base" not in columns and "same_param1" not in columns and "is_same_region" not in columns and "title_exact" in columns
    assert not [c for c in features.drop_groups(features.build_features(df), ("title_",)).columns if c.startswith("title_")]


def test_no_python_in_builtin_blocks(spark):
    df = spark.createDataFrame([], SCHEMA)
    plan = features.build_features(df, stable=True)._jdf.queryExecution().executedPlan().toString()
    # the descriptions' n-gram helper alone, once
    assert plan.count("ArrowEvalPython") <= 1 and "Exchange" not in plan


def test_side_numbers_and_keys(spark):
    df = spark.createDataFrame([("10", "2", "ab", None)], "p string, i string, t string, d string")
    values = df.select(A.side_numbers(F.col("p"), F.col("i"), F.col("t"), F.col("d")).alias("v")).first()["v"]
    assert values == pytest.approx([2.397895, 1, 2, 1.098612, 0], abs=1e-6)
    keys = spark.createDataFrame([("a", "bc", "", ""), ("ab", "c", "", "")], "c string, s string, p string, q string").select(A.nested_keys(*map(F.col, "cspq"))["subcategory"].alias("k")).collect()
    assert keys[0]["k"] != keys[1]["k"]
    assert spark.range(1).select(A.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long")).alias("x")).first()["x"] == 64
