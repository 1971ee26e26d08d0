import pytest
from pyspark.sql import functions as F

from twinlens.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("куpткa зимняя ecco", "куртка зимняя ecco"), ("сор", "сор"), ("iPhone дaча", "iPhone дача"), ("", ""), (None, "")])
def test_homoglyphs(spark, raw, want):
    assert one(spark, T.restore_homoglyphs(F.col("t")), t=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("iPhone_11, 256ГБ!", "iphone 11 256гб"), ("  \t ", ""), (None, ""), ("ﬁne ①", "fine 1"), ("КОТ", "kot")])
def test_normalize(spark, raw, want):
    assert one(spark, T.normalize(F.col("t")), t=raw) == want


def test_ngrams(spark):
    assert one(spark, T.char_ngrams(F.col("t"), 3), t="ab") == ["ab"]
    assert sorted(one(spark, T.char_ngrams(F.col("t"), 3), t="abcabc")) == ["abc", "bca", "cab"]
    assert one(spark, T.char_ngrams(F.col("t"), 3), t="") == []


@pytest.mark.parametrize(("a", "b", "want"), [("iphone 11", "iphone 12", 8 / 9), ("", "x", 0.0), ("same", "same", 1.0), ("ab", "abcd", 0.5)])
def test_prefix(spark, a, b, want):
    assert one(spark, T.lcp_ratio(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)
    assert one(spark, T.lcp_ratio(F.col("b"), F.col("a")), a=a, b=b) == pytest.approx(want)


def test_set_similarities_are_symmetric_and_ordered(spark):
    rows = [(a, b) for a in ("", "a b", "a b c", "c d", "a a b") for b in ("", "b", "a b c d", "x")]
    df = spark.createDataFrame(rows, "a string, b string")
    ta, tb = T.token_set(F.col("a")), T.token_set(F.col("b"))
    for r in df.select("a", "b", T.jaccard(ta, tb).alias("j"), T.jaccard(tb, ta).alias("k"), T.containment(ta, tb).alias("c")).collect():
        a, b = set(r["a"].split()), set(r["b"].split())
        assert r["j"] == r["k"] == pytest.approx(len(a & b) / len(a | b) if a | b else 0)
        assert 0 <= r["j"] <= r["c"] <= 1


def test_encoder_text(spark):
    assert one(spark, T.encoder_text(F.col("a"), F.col("b")), a="", b=None) == "."
    assert one(spark, T.encoder_text(F.col("a"), F.col("b")), a="Tea", b="x" * 200) == "Tea. " + "x" * 128


def test_long_overlap_agrees_with_columns(spark):
    df = spark.createDataFrame([("abcdef", "abcxef"), ("", ""), ("ab", "ab"), ("abc", "")], "a string, b string")
    long = T.long_text_overlap(F.col("a"), F.col("b"), F.lit(3))
    plain = T.jaccard(T.char_ngrams(F.col("a"), 3), T.char_ngrams(F.col("b"), 3))
    for r in df.select(long.alias("l"), plain.alias("j"), T.lcp_ratio(F.col("a"), F.col("b")).alias("p")).collect():
        assert (r["l"]["ngram"], r["l"]["lcp"]) == (pytest.approx(r["j"]), pytest.approx(r["p"]))
