"""Both sides of every pair as rows: their numbers, standardised, and vectors of embedding and numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.attributes import side_numbers
from ..sources.pairs import sides
from ..sources.stored import BROADCAST_ROWS

#: Names of the numbers of :func:`~twinlens.functions.attributes.side_numbers`.
NUMBERS = ("log_price", "price_known", "images", "log_title", "log_description")
#: Added to a standard deviation, so that a constant number gives zeros.
LEAST_SPREAD = 1e-6


def numbered_sides(pairs: DataFrame, *keep: str) -> DataFrame:
    """pair_id, side, the ``keep`` columns of the side and its five numbers. Those that listings brought (``_base_numbers``, ``_cand_numbers``) aren't worked out again."""
    if "_base_numbers" in pairs.columns:
        flat = sides(pairs.withColumnsRenamed({f"_{s}_numbers": f"{s}_v" for s in ("base", "cand")}), (*keep, "v")).withColumnRenamed("v", "_v")
    else:
        numbers = side_numbers(F.col("price"), F.col("count_images"), F.col("title"), F.col("description"))
        flat = sides(pairs, (*keep, "price", "count_images", "title", "description")).select("pair_id", "side", *keep, numbers.alias("_v"))
    return flat.select("pair_id", "side", *keep, *(F.col("_v")[i].alias(n) for i, n in enumerate(NUMBERS)))


def statistics(numbered: DataFrame, columns: tuple[str, ...] = NUMBERS) -> DataFrame:
    """One row: mean and population deviation of each column over all the rows given, both sides together. Give the training rows alone."""
    return numbered.agg(*(F.avg(c).alias(f"mean_{c}") for c in columns), *((F.stddev_pop(c) + LEAST_SPREAD).alias(f"std_{c}") for c in columns))


def standardise(numbered: DataFrame, stats: DataFrame, columns: tuple[str, ...] = NUMBERS) -> DataFrame:
    """``numbered``, of whatever rows, with ``columns`` standardised by the one row of :func:`statistics`."""
    joined = numbered.join(F.broadcast(stats))  # one row
    scaled = {c: (F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}") for c in columns}
    return joined.select(*(scaled[c].alias(c) if c in scaled else F.col(c) for c in numbered.columns))


def side_vectors(pairs: DataFrame, table: DataFrame, stats: DataFrame | None = None, key: str = "vec_id") -> DataFrame:
    """pair_id, side and ``vector``: the side's embedding in ``table`` (``key``, embedding), then its standardised numbers.

    Without ``stats`` those of ``pairs`` are taken. The vector of a side without an embedding is null.
    """
    numbered = numbered_sides(pairs, key)
    scaled = standardise(numbered, statistics(numbered) if stats is None else stats)
    vectors = table.select(key, F.col("embedding").cast("array<double>").alias("_e"))
    met = scaled.join(F.broadcast(vectors) if vectors.count() <= BROADCAST_ROWS // 16 else vectors, key, "left")
    return met.select("pair_id", "side", F.when(F.col("_e").isNotNull(), F.concat("_e", F.array(*NUMBERS))).alias("vector"))


def standardised_numbers(numbers: Column) -> Column:
    """An array of the five numbers, standardised, where the row of :func:`statistics` is joined."""
    return F.array(*((numbers[i] - F.col(f"mean_{c}")) / F.col(f"std_{c}") for i, c in enumerate(NUMBERS)))


def pair_vectors(vectors: DataFrame) -> DataFrame:
    """pair_id with the ``base`` and ``cand`` vector of :func:`side_vectors` in one row."""
    of = lambda side: F.first(F.when(F.col("side") == side, F.col("vector")), ignorenulls=True)
    return vectors.groupBy("pair_id").agg(of("base").alias("base"), of("cand").alias("cand"))


def keyed_sides(pairs: DataFrame, key: str = "vec_id") -> DataFrame:
    """pair_id with ``base_side`` and ``cand_side``, keys of the sides by what their vectors are made of; sides alike in that share a key. Nothing is shuffled."""
    numbers = lambda s: side_numbers(F.col(f"{s}_price"), F.col(f"{s}_count_images"), F.col(f"{s}_title"), F.col(f"{s}_description"))
    parts = lambda s: F.concat_ws(":", F.coalesce(F.col(f"{s}_{key}").cast("string"), F.lit("")), F.array_join(F.transform(numbers(s), lambda x: x.cast("string")), ":"))
    return pairs.select("pair_id", *(F.md5(parts(s).cast("binary")).alias(f"{s}_side") for s in ("base", "cand")))


def distinct_side_vectors(pairs: DataFrame, table: DataFrame, stats: DataFrame | None = None, key: str = "vec_id") -> DataFrame:
    """side_key and vector, as :func:`side_vectors` gives it, once for each key of :func:`keyed_sides`."""
    numbered = numbered_sides(pairs, key)
    parts = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), *(F.col(n).cast("string") for n in NUMBERS))
    distinct = numbered.select(F.md5(parts.cast("binary")).alias("side_key"), key, *NUMBERS).dropDuplicates(["side_key"])
    scaled = standardise(distinct, statistics(numbered) if stats is None else stats)
    met = scaled.join(table.select(key, F.col("embedding").cast("array<double>").alias("_e")), key, "left")
    return met.select("side_key", F.when(F.col("_e").isNotNull(), F.concat("_e", F.array(*NUMBERS))).alias("vector"))


def absolute_difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


@F.arrow_udf(ArrayType(DoubleType()))
def long_difference(a: pa.Array, b: pa.Array) -> pa.Array:
    """The absolute difference of embeddings in double precision, many times faster than :func:`absolute_difference`; null if either is null or lengths differ."""
    sizes, other = np.asarray(a.value_lengths().fill_null(-1)), np.asarray(b.value_lengths().fill_null(-2))
    met = sizes == other
    x, y = (np.asarray(v.filter(pa.array(met)).flatten(), dtype=np.float64) for v in (a, b))
    offsets = np.concatenate([[0], np.cumsum(np.where(met, sizes, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.abs(x - y)), mask=pa.array(~met))
