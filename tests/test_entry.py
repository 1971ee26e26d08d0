import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from conftest import ROOT

NAMES = ["build_features", "restore_homoglyphs", "auc_per_fold", "rank_blend", "leakage", "mine_triplets", "embedding_features", "photo_features", "ap_by_group", "pair_features", "side_vectors", "triplet_losses", "split_comparison", "nested_keys", "auc_merged_states", "metric_levels"]


def test_entry(spark):
    assert entry.entry(spark).count() == 2


def nulls_first(row):
    return tuple((v is not None, 0 if v is None else v) for v in row)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("part", "documents", "embeddings", "events"):
        con.sql(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    want = con.sql(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, small).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def rows(df):
        return sorted((tuple(None if pd.isna(v) else round(float(v), 5) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v) for v in r) for r in df[columns].astype(object).itertuples(index=False)), key=nulls_first)

    assert rows(got) == rows(want)


@pytest.mark.parametrize("left", ["nothing", "caches", "a folder that can't be imported"])
def test_without_the_training_data_subpackage(tmp_path, left):
    shutil.copytree(ROOT / "twinlens", tmp_path / "twinlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if left != "nothing":
        (tmp_path / "twinlens" / "llm" / "__pycache__").mkdir(parents=True)
        (tmp_path / "corpus_pipeline.py").write_text("import twinlens.llm.common\n")
    if left.startswith("a folder"):
        (tmp_path / "twinlens" / "llm" / "__init__.py").write_text("import a_library_that_is_missing\n")
    code = "import __spark_entry__ as e; n = set(e.queries()); assert 'build_features' in n and not any(x.startswith('op') and x[2].isdigit() for x in n) and 'pipeline' not in n; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
