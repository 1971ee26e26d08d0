import os

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from twinlens.functions import text as T
from twinlens.jobs.queries import LOOKALIKE
from twinlens.operators import photos
from twinlens.sources.pairs import derived_pairs


def test_homoglyphs_of_whole_texts(spark, small):
    """Every character is read, not only the first 200, and the result equals the SQL's over whole texts."""
    got = {r["doc_id"]: r for r in entry.queries()["restore_homoglyphs_whole"](spark, small).collect()}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{small}/documents.parquet')")
    want = con.sql(entry.oracle_sql()["restore_homoglyphs_whole"]).fetchall()
    assert {i: (r["restored"], r["normalized"]) for i, r in got.items()} == {i: (restored, normalized) for i, restored, normalized in want}
    sizes = {i: len(t) for i, t in con.sql("select doc_id, text from documents").fetchall()}
    assert max(sizes.values()) > 200 and all(len(got[i]["restored"]) == n for i, n in sizes.items())
    # a word of mixed alphabets far behind the start is repaired
    from twinlens.functions import text as T

    late = "x" * 300 + " grand"
    assert spark.range(1).select(T.restore_homoglyphs(F.translate(F.lit(late), *LOOKALIKE)).alias("t")).first()["t"].endswith(" grand")


def test_all_features_read_whole_descriptions(spark, small):
    normal = [F.length(T.normalize(F.col(f"{s}_description"))).alias(s) for s in ("base", "cand")]
    want = {r["pair_id"]: (r["base"], r["cand"]) for r in derived_pairs(spark, small).select("pair_id", *normal).collect()}
    got = entry.queries()["pair_features"](spark, small).select("pair_id", "description_len_diff").collect()
    assert {r["pair_id"]: r["description_len_diff"] for r in got} == {k: abs(b - c) for k, (b, c) in want.items()}
    assert max(map(max, want.values())) > 512 and "_description, 1, 512)" not in entry.oracle_sql()["pair_features"]


def test_whole_texts_by_plain_sets(spark, monkeypatch):
    monkeypatch.setattr(T, "KEPT_CHARS", 700)  # sets that were kept are dropped now and then
    long = "слово 12 " * 80
    texts = ["", "ab", long.strip(), (long + "end").strip(), (long + "конец 7").strip(), "x" + long.strip(), "12 7"]
    pairs = [(x, y, ["12", "end"], ["слово"] if i % 2 else []) for i, x in enumerate(texts) for y in texts]
    df = spark.createDataFrame(pairs, "a string, b string, s array<string>, t array<string>").coalesce(1)
    got = df.select("a", "b", "s", "t", T.whole_text_overlap(F.col("a"), F.col("b"), F.lit(4), F.col("s"), F.col("t")).alias("x")).collect()
    assert len(got) == len(pairs)
    for a, b, s, t, x in got:
        ga, gb = ({v[i : i + 4] for i in range(max(len(v) - 3, 1))} - {""} for v in (a, b))
        wa, wb = set(a.split()), set(b.split())
        same = len(os.path.commonprefix([a, b])) / max(len(a), len(b)) if a and b else 0
        assert x["ngram"] == (len(ga & gb) / len(ga | gb) if ga | gb else 0) and x["lcp"] == same
        assert (x["shared"], x["base_words"], x["cand_words"]) == (len(wa & wb), len(wa), len(wb))
        assert (x["base_title"], x["cand_title"]) == (len(wb & set(s)), len(wa & set(t)))


def test_photo_hash_reads_all_bytes(spark):
    head = bytes(range(72))
    files = [("a", head + bytes(7200)), ("b", head + bytes(range(250, 0, -1)) * 29), ("short", b"ab"), ("none", b"")]
    got = {r["image_key"]: r for r in photos.hash_photos(spark.createDataFrame(files, "image_key string, content binary"), photos.byte_grid).collect()}
    assert got["a"]["dhash"] != got["b"]["dhash"] and got["short"]["found"] and not got["none"]["found"]
    for content in (f[1] for f in files[:3]):
        n = len(content)
        cells = [content[i * n // 72 : max((i + 1) * n // 72, i * n // 72 + 1)] for i in range(72)]
        assert photos.byte_grid(content) == [sum(c) * 65536 // len(c) for c in cells]
