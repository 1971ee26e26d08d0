"""Benchmark decontamination with DataFrame functions only.

Items are partitioned by their number of shingles, and each keeps the smallest hashes of its
shingles (a MinHash sketch) in such number that a document which holds the stated share of the item must hold one of them:
of n shingles, any n - ceil(t n) + 1 include a shared one. Documents, however long, are probed
with all their shingles; what meets is verified by exact containment of the shingles themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh, materialize, row_key, with_keys

SHINGLE_WORDS, CONTAINMENT = 5, 0.8
#: Sketches are broadcast in so many parts at most, one after another; beyond that they are joined by a shuffle.
SKETCH_PARTS = 8


def words(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")


def _windows(w: Column, n: int, make) -> Column:
    """``make`` of the start and n, for each window of n words; none where there are fewer words."""
    return F.when(F.size(w) < n, F.array()).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: make(i, n)))


def shingle_hashes(w: Column, *sizes: int) -> Column:
    """Hashes of all windows of the words ``w`` of each of the ``sizes``."""
    each = [_windows(w, n, lambda i, n: F.xxhash64(*(F.get(w, i + (k - 1)) for k in range(n)))) for n in sizes]
    return each[0] if len(each) == 1 else F.concat(*each)


def shingles(w: Column, *sizes: int) -> Column:
    """The distinct windows of the words ``w`` of each of the ``sizes``, as text."""
    each = [_windows(w, n, lambda i, n: F.array_join(F.slice(w, i, n), " ")) for n in sizes]
    return F.array_distinct(each[0] if len(each) == 1 else F.concat(*each))


def _of_size(w: Column, sizes: list[int], make) -> Column:
    """``make`` of the size of an item's shingles: the largest of ``sizes``, or the item's own number of words if that is less."""
    out = make(w, sizes[0])
    for m in sizes[1:]:
        out = F.when(F.size(w) == m, make(w, m)).otherwise(out)
    return out


def sketches(items: DataFrame, containment: float = CONTAINMENT, sizes: list[int] | None = None) -> DataFrame:
    """item_id and hash: the sketch of each item, as long as its size partition (up to a power of 2) demands."""
    hashed = items.select("item_id", F.array_sort(F.array_distinct(_of_size(F.col("words"), sizes or [SHINGLE_WORDS], shingle_hashes))).alias("hashes"))
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("hashes").cast("double"))))
    length = (upper - F.ceil(upper * containment - 1e-9) + 1).cast("int")
    return hashed.where(F.size("hashes") > 0).select("item_id", F.explode(F.slice("hashes", 1, length)).alias("hash"))


def _candidates(probed: DataFrame, probes: DataFrame) -> DataFrame:
    """Distinct (row, item) of the documents' hashes ``probed`` that meet the written table ``probes``."""
    parts = -(-probes.count() // BROADCAST_ROWS)
    if parts > SKETCH_PARTS:
        return materialize(probed.join(probes, "hash").select("row", "item").distinct(), "benchmark-candidates")
    part = F.pmod(F.xxhash64("hash"), F.lit(max(parts, 1)))
    # each part is written before the next one is broadcast
    met = [materialize(probed.join(F.broadcast(probes.where(part == k)), "hash").select("row", "item").distinct(), "benchmark-candidates") for k in range(max(parts, 1))]
    return reduce(DataFrame.unionByName, met).distinct()


def find_items(documents: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, n: int = SHINGLE_WORDS) -> DataFrame:
    """Items of ``benchmark`` (item_id, text) whose shingles lie in a document of ``documents`` (doc_id, text) by the share ``containment`` or more.

    Returns row (see :func:`~twinlens.llm.common.row_key`), doc_id, item_id, n_shingles, n_shared and containment, once for documents that
    are alike in id and text. A shingle is ``n`` words; an item with fewer words is one shingle of all its words and is found wherever
    they stand in a row. Null or wordless texts on either side meet nothing. Items that repeat an id count as their own
    texts each, the best one told. Extra columns are ignored; empty tables give no rows.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    items = materialize(items.select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words"), "benchmark-items")
    # n, and the shorter items' numbers of words, n - 1 of them at most
    sizes = [n, *sorted(r[0] for r in items.where(F.size("words") < n).select(F.size("words")).distinct().collect())]
    probes = materialize(sketches(items.select(F.col("item").alias("item_id"), "words"), containment, sizes).withColumnRenamed("item_id", "item"), "benchmark-sketches")
    docs = documents.select(row_key(documents).alias("row"), "doc_id", "text")
    # the words are named before the lambda uses them, so that a text is split once
    probed = docs.select("row", words(F.col("text")).alias("words")).select("row", F.explode(shingle_hashes(F.col("words"), *sizes)).alias("hash"))
    met = _candidates(probed, probes)
    rows = materialize(met.select("row").distinct(), "benchmark-rows")
    held = with_keys(docs, rows, "left_semi", "row").dropDuplicates(["row"]).select("row", "doc_id", words(F.col("text")).alias("words"))
    held = held.select("row", "doc_id", F.explode(shingles(F.col("words"), *sizes)).alias("shingle"))
    wanted = items.select("item", "item_id", _of_size(F.col("words"), sizes, shingles).alias("all")).select("item", "item_id", F.size("all").alias("n_shingles"), F.explode("all").alias("shingle"))
    shared = held.join(materialize(wanted, "benchmark-shingles"), "shingle").groupBy("row", "doc_id", "item", "item_id", "n_shingles").agg(F.count("*").alias("n_shared"))
    found = shared.join(met, ["row", "item"], "left_semi").withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("containment") >= containment)
    best = found.groupBy("row", "doc_id", "item_id").agg(F.max_by(F.struct("n_shingles", "n_shared", "containment"), F.struct("containment", "n_shingles")).alias("b"))
    return best.select("row", "doc_id", "item_id", F.col("b.n_shingles").cast("long").alias("n_shingles"), "b.n_shared", "b.containment")


def contamination(documents: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, n: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared and containment of what :func:`find_items` finds, the best of a doc_id's rows."""
    found = find_items(documents, benchmark, containment, n)
    best = found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_shingles", "n_shared", "containment"), F.struct("containment", "n_shingles")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_shingles", "b.n_shared", "b.containment")


def decontaminate(documents: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, n: int = SHINGLE_WORDS) -> DataFrame:
    """``documents``, with all their columns, without the rows that hold an item.

    Rows are judged each by its own text, also where ids repeat or are null; rows alike in id and text stay or go together. Null and
    wordless texts stay. Columns may have any names; an empty table gives no rows, an empty ``benchmark`` all of them.
    """
    key = fresh(documents, "row")
    found = materialize(find_items(documents, benchmark, containment, n).select(F.col("row").alias(key)).distinct(), "benchmark-found")
    return with_keys(documents.withColumn(key, row_key(documents)), found, "left_anti", key).drop(key)
