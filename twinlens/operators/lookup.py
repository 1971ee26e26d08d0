"""Encode every distinct value once, look the results up for both sides of a pair."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.stored import materialize


#: A key with more than one of so many rows is heavy, so there are fewer heavy keys than this; the sketch tracks many times as many.
HEAVY_SHARE, TRACKED = 512, 20_000


def heavy_keys(df: DataFrame, *columns: str, share: int = HEAVY_SHARE) -> list:
    """Values that more than one in ``share`` of the rows hold in one of the columns; null isn't one. One pass with a frequency sketch of bounded size."""
    sketches = [F.expr(f"approx_top_k(`{c}`, {share}, {TRACKED})").alias(f"_{i}") for i, c in enumerate(columns)]
    row = df.agg(F.count("*").alias("_n"), *sketches).first()
    # share values of each column at most; what the sketch counts too much makes a key heavy that needn't be
    return list(dict.fromkeys(x["item"] for i in range(len(columns)) for x in row[f"_{i}"] or [] if x["item"] is not None and x["count"] * share > row["_n"]))


def lookup(df: DataFrame, table: DataFrame, key: str, column: str, values: dict[str, str], heavy: list) -> DataFrame:
    """``df`` with ``values`` (new name: column) of the row of ``table`` whose ``key`` is in ``column``; null for null and unknown keys.

    Rows with a ``heavy`` key or none meet a broadcast part of the table, which has a row for each heavy key at most, and stay where they are. The others are
    joined as Spark sees fit. ``df`` is read once for either part: give it stored or cheap.
    """
    side = table.select(F.col(key).alias("_k"), *(F.col(c).alias(n) for n, c in values.items()))
    own = F.col(column)
    few = own.isNull() | own.isin(heavy) if heavy else own.isNull()
    one = df.where(few).join(F.broadcast(side.where(F.col("_k").isin(heavy))), own == F.col("_k"), "left") if heavy else df.where(few).select("*", *(F.lit(None).cast(t).alias(n) for n, t in side.dtypes))
    return one.unionByName(df.where(~few).join(side, own == F.col("_k"), "left")).drop("_k")


def lookup_both(pairs: DataFrame, table: DataFrame, key: str, base: str, cand: str, values: tuple[str, ...], *, stored: bool = False) -> DataFrame:
    """``pairs`` with ``base_{v}`` and ``cand_{v}`` from ``table``, which has a row for each key; unknown and null keys give null. Give a narrow ``pairs``: it is stored, unless it is
    ``stored`` already. ``table`` is read four times: give it stored or cheap.

    Popular keys and null ones make no hot task: see :func:`lookup`. A pair is shuffled for those of its sides whose key is neither.
    """
    pairs = pairs if stored else materialize(pairs, "lookup-pairs")
    heavy = heavy_keys(pairs, base, cand)
    for side, column in (("base", base), ("cand", cand)):
        pairs = lookup(pairs, table, key, column, {f"{side}_{v}": v for v in values}, heavy)
    return pairs


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


@F.arrow_udf(StructType([StructField(n, DoubleType()) for n in ("cosine", "l2", "diff_mean", "diff_max", "diff_std")]))
def vector_features(a: pa.Array, b: pa.Array) -> pa.Array:
    """Cosine, distance and statistics of the absolute difference of unit vectors; null if either is null or lengths differ."""
    out = np.full((5, len(a)), np.nan)
    sizes, other = np.asarray(a.value_lengths().fill_null(-1)), np.asarray(b.value_lengths().fill_null(-2))
    for size in np.unique(sizes[(sizes == other) & (sizes > 0)]):
        rows = np.flatnonzero((sizes == size) & (other == size))
        x, y = (np.asarray(v.take(pa.array(rows)).flatten(), dtype=np.float64).reshape(len(rows), size) for v in (a, b))
        x, y = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8) for v in (x, y))
        d = np.abs(x - y)
        out[:, rows] = [(x * y).sum(axis=1), np.sqrt((d * d).sum(axis=1)), d.mean(axis=1), d.max(axis=1), d.std(axis=1)]
    names = ["cosine", "l2", "diff_mean", "diff_max", "diff_std"]
    return pa.StructArray.from_arrays([pa.array(c, from_pandas=True) for c in out], names)


def embedding_pair_features(pairs: DataFrame, table: DataFrame, key: str, base: str, cand: str, keep: tuple[str, ...], prefix: str = "emb") -> DataFrame:
    """``keep`` and the five features of both sides' vectors in ``table`` (``key``, embedding)."""
    met = lookup_both(pairs.select(*dict.fromkeys([*keep, base, cand])), table.select(key, "embedding"), key, base, cand, ("embedding",))
    f = vector_features(F.col("base_embedding"), F.col("cand_embedding"))
    return met.select(*keep, f.alias("_f")).select(*keep, *(F.col(f"_f.{n}").alias(f"{prefix}_{n}") for n in ("cosine", "l2", "diff_mean", "diff_max", "diff_std")))


def unique_texts(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct non-null texts of several columns, each with its md5 as ``text_key``."""
    texts = df.select(F.explode(F.array(*columns)).alias("text")).where("text is not null").distinct()
    return texts.select(F.md5(F.col("text").cast("binary")).alias("text_key"), "text")


def count_unique(df: DataFrame, *columns: str) -> DataFrame:
    """One row: ``texts``, the exact number of different non-null texts of several columns. Texts are told apart by their md5, as :func:`unique_texts` keys them, so none is shuffled."""
    keys = df.select(F.explode(F.array(*(F.md5(F.col(c).cast("string").cast("binary")) for c in columns))).alias("text_key")).where("text_key is not null")
    return keys.distinct().agg(F.count("*").alias("texts"))


#: Bits of the sketches' registers: an estimate is within 2.5 % of the exact count, three standard errors.
SKETCH_BITS, SKETCH_BOUND = 14, 0.025


def count_states(df: DataFrame, columns: tuple[str, ...], by: str) -> DataFrame:
    """``by`` and ``state``: a sketch of the different non-null texts of ``columns`` in each part. States are a few kilobytes whatever a part holds, so keep them with the parts."""
    texts = df.select(by, F.explode(F.array(*(F.col(c).cast("string") for c in columns))).alias("_t")).where("_t is not null")
    return texts.groupBy(by).agg(F.hll_sketch_agg("_t", SKETCH_BITS).alias("state"))


def merge_counts(states: DataFrame, *keys: str) -> DataFrame:
    """``keys``, the number of merged states and the estimated number of different texts in all their parts; no part is read again."""
    return states.groupBy(*keys).agg(F.count("*").alias("parts"), F.hll_sketch_estimate(F.hll_union_agg("state")).alias("estimate"))


def hashed_ngram_vectors(texts: list[str], size: int = 64, n: int = 3) -> np.ndarray:
    """The shipped encoder: counts of hashed character n-grams, of unit length; the same on every machine."""
    out = np.zeros((len(texts), size), dtype=np.float32)
    for row, text in zip(out, texts, strict=True):
        for i in range(max(len(text) - n + 1, 1)):
            row[zlib.crc32(text[i : i + n].encode()) % size] += 1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-8)


def encode_unique(texts: DataFrame, encode: Callable[[list[str]], np.ndarray] = hashed_ngram_vectors, known: DataFrame | None = None) -> DataFrame:
    """text_key and embedding of ``texts`` (text_key, text) that aren't in ``known`` yet."""
    if known is not None:
        texts = texts.join(known.select("text_key"), "text_key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = encode(batch.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(np.arange(0, vectors.size + 1, vectors.shape[1], dtype=np.int32), pa.array(vectors.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), lists], ["text_key", "embedding"])

    return texts.select("text_key", "text").mapInArrow(run, "text_key string, embedding array<float>")


Weights = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def tower(vector: Column, weights: Weights) -> Column:
    """A given two-layer network with unit output, of arrays; null for null. The weights' size is fixed."""
    w1, b1, w2, b2 = weights

    @F.arrow_udf("array<double>")
    def encode(x: pa.Array) -> pa.Array:
        rows = np.flatnonzero(np.asarray(x.is_valid()))
        v = np.asarray(x.take(pa.array(rows)).flatten(), dtype=np.float64).reshape(len(rows), -1)
        z = np.maximum(v @ w1 + b1, 0) @ w2 + b2 if len(rows) else np.zeros((0, len(b2)))
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-8)
        out: list = [None] * len(x)
        for i, one in zip(rows.tolist(), z, strict=True):
            out[i] = one
        return pa.array(out, pa.list_(pa.float64()))

    return encode(vector)


def apply_tower(sides: DataFrame, key: str, vector: str, weights: Weights) -> DataFrame:
    """``key`` and ``encoded`` of distinct sides by :func:`tower`."""
    return sides.where(F.col(vector).isNotNull()).select(key, vector).dropDuplicates([key]).select(key, tower(F.col(vector), weights).alias("encoded"))


def tower_sim(a: Column, b: Column) -> Column:
    """1 / (1 + distance) of two encodings; null if either is null."""
    square = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return 1 / (1 + F.sqrt(square + 1e-12))


def tower_pairs(pairs: DataFrame, base: str, cand: str, weights: Weights, keep: tuple[str, ...]) -> DataFrame:
    """1 / (1 + distance) of the encodings of the ``base`` and ``cand`` vectors in each row; null where either is null."""
    met = pairs.select(*keep, tower(F.col(base), weights).alias("_b"), tower(F.col(cand), weights).alias("_c"))
    return met.select(*keep, tower_sim(F.col("_b"), F.col("_c")).alias("tower_sim"))


def tower_score(pairs: DataFrame, encoded: DataFrame, key: str, base: str, cand: str, keep: tuple[str, ...]) -> DataFrame:
    """1 / (1 + distance) of both sides' encodings."""
    met = lookup_both(pairs.select(*dict.fromkeys([*keep, base, cand])), encoded, key, base, cand, ("encoded",))
    return met.select(*keep, tower_sim(F.col("base_encoded"), F.col("cand_encoded")).alias("tower_sim"))
