"""Photo hashes and vectors: encoded once per key, compared per pair."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.attributes import hamming
from ..sources.stored import BROADCAST_ROWS, exists
from .lookup import dot, lookup_both

SUFFIXES = ("jpg", "jpeg", "png", "webp")


def photo_keys(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct keys that aren't blank."""
    return df.select(F.explode(F.array(*columns)).alias("image_key")).where("image_key is not null and image_key <> ''").distinct()


#: A file's key: its name without the suffix.
STEM = r"([^/]+)\.[^./]+$"


def locate_photos(spark: SparkSession, roots: list[str], keys: DataFrame, suffixes: tuple[str, ...] = SUFFIXES, key: str = STEM) -> DataFrame:
    """image_key and path of the wanted keys' files in ``roots`` and their folders, not in folders of those. ``key`` is a pattern whose first group is the key in a path.

    Of several files with one key that of the first root counts, in a root that of the root itself, then of the first folder by name.
    """
    parts = []
    for i, root in enumerate(roots):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
        # what follows the root's own name: the place of its last part in the path
        inner = F.regexp_extract("path", rf"(?:^|/){re.escape(root.rstrip('/').split('/')[-1])}/(.*)$", 1)
        parts.append(files.select("path", F.lit(i).alias("root"), F.size(F.split(inner, "/")).alias("depth")))
    files = reduce(DataFrame.unionByName, parts).where("depth <= 2")
    found = files.select("*", F.regexp_extract("path", key, 1).alias("image_key"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"))
    wanted = found.where(F.col("suffix").isin(*suffixes)).join(keys.select("image_key"), "image_key", "left_semi")
    return wanted.groupBy("image_key").agg(F.min(F.struct("root", "depth", "path")).alias("first")).select("image_key", "first.path")


def save_encoded(table: DataFrame, path: str) -> None:
    """Keep an encode table (image_key, dhash, embedding, found) for a later run."""
    table.write.mode("overwrite").parquet(path)


def load_encoded(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that :func:`save_encoded` kept; None where there is none."""
    return spark.read.parquet(path) if exists(spark, path) else None


def location_stats(located: DataFrame) -> DataFrame:
    return located.agg(F.count("*").alias("n_files"), F.countDistinct(F.regexp_extract("path", r"^(.*)/[^/]+$", 1)).alias("n_folders"))


def dhash(grid: Column) -> Column:
    """Difference hash of 8 rows of 9 grey values: right above left, row by row, the first bit highest."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (F.get(grid, i + (i / 8).cast("int") + 1) > F.get(grid, i + (i / 8).cast("int"))).cast("long"))
    return F.when(F.size(grid) == 72, F.aggregate(bits, F.lit(0).cast("long"), lambda h, b: F.shiftleft(h, 1).bitwiseOR(b)))


def byte_grid(content: bytes | None) -> list[int] | None:
    """72 means, in 65,536ths, of even runs of all bytes; of fewer than 72 bytes each fills several cells. None without bytes."""
    if not content:
        return None
    n = len(content)
    sums = np.concatenate([[0], np.cumsum(np.frombuffer(content, dtype=np.uint8), dtype=np.int64)])
    start = np.arange(72, dtype=np.int64) * n // 72
    end = np.maximum(np.arange(1, 73, dtype=np.int64) * n // 72, start + 1)
    return ((sums[end] - sums[start]) * 65536 // (end - start)).tolist()


def read_files(located: DataFrame, roots: list[str]) -> DataFrame:
    """image_key, path and content of ``located`` files (image_key, path). Files are read where their contents are used; name the ``roots`` that they lie in."""
    spark = located.sparkSession
    files = reduce(DataFrame.unionByName, (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content") for root in roots))
    # paths are looked up in files' rows, so contents don't move as long as the located paths are few enough to broadcast
    small = located.count() <= BROADCAST_ROWS
    found = located.select("image_key", "path")
    return files.join(F.broadcast(found) if small else found, "path").select("image_key", "path", "content")


_PGM = re.compile(rb"(P[25])(?:\s+|\s*#[^\n]*\n)+(\d+)(?:\s+|\s*#[^\n]*\n)+(\d+)(?:\s+|\s*#[^\n]*\n)+(\d+)\s")


def decode_pgm(content: bytes, rows: int = 8, columns: int = 9) -> list[int]:
    """``rows`` times ``columns`` mean grey values, in 256ths, of a picture in portable grey format (plain or raw); ValueError for anything else.

    Cells share the picture's lines and columns evenly; of a picture with fewer than these each fills several cells.
    """
    head = _PGM.match(content or b"")
    if not head:
        raise ValueError("not a grey picture")
    width, height, most = (int(x) for x in head.groups()[1:])
    if not width or not height or not 0 < most < 65536:
        raise ValueError("a grey picture without pixels or depth")
    if head[1] == b"P2":
        values = np.array(re.sub(rb"#[^\n]*", b"", content[head.end() :]).split()[: width * height], dtype=np.int64)
    else:
        values = np.frombuffer(content[head.end() :], np.uint8 if most < 256 else ">u2")[: width * height].astype(np.int64)
    if len(values) < width * height or (values > most).any():
        raise ValueError("a grey picture that is cut off or too bright")
    grid = values.reshape(height, width)
    for axis, (n, cells) in enumerate(((height, rows), (width, columns))):
        start = np.arange(cells) * n // cells
        end = np.maximum(np.arange(1, cells + 1) * n // cells, start + 1)
        sums = np.insert(np.cumsum(grid, axis=axis), 0, 0, axis=axis)
        grid = np.take(sums, end, axis) - np.take(sums, start, axis)
        if axis == 0:
            tall = end - start
        else:
            grid = grid * 256 // (tall[:, None] * (end - start))
    return grid.ravel().tolist()


def still_to_encode(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """Keys that the cache has no usable row for."""
    return keys.join(cache.where("found").select("image_key"), "image_key", "left_anti")


def _grid(decode: Callable[[bytes], list[int] | None], content: bytes | None) -> list[int] | None:
    try:
        return decode(content)
    except (ValueError, OSError):
        return None  # an unreadable file is a photo that isn't found


def hash_photos(files: DataFrame, decode: Callable[[bytes], list[int] | None]) -> DataFrame:
    """image_key, dhash and found of ``files`` (image_key, content); ``decode`` gives 72 grey values, or None for what it can't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grids = [_grid(decode, content.as_py()) for content in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("image_key"), pa.array(grids, pa.list_(pa.int32()))], ["image_key", "grid"])

    grids = files.select("image_key", "content").mapInArrow(run, "image_key string, grid array<int>")
    hashed = grids.select("image_key", dhash(F.col("grid")).alias("dhash"))
    return hashed.withColumn("found", F.col("dhash").isNotNull())


def encode_photos(files: DataFrame, keys: DataFrame, decode: Callable[[bytes], list[int] | None], encode: Callable[[list[bytes]], np.ndarray], known: DataFrame | None = None) -> DataFrame:
    """image_key, dhash, embedding and found of all ``keys``: usable rows of ``known`` as they are, the others from ``files`` (image_key, content).

    ``encode`` gives one vector for each readable photo; a key without a readable file isn't found. A batch's photos are encoded together.
    """
    todo = keys.select("image_key") if known is None else still_to_encode(keys.select("image_key"), known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch.column("content").to_pylist()
            grids = [_grid(decode, c) for c in contents]
            readable = [i for i, g in enumerate(grids) if g is not None]
            vectors: list = [None] * len(grids)
            for i, v in zip(readable, encode([contents[i] for i in readable]) if readable else [], strict=True):
                vectors[i] = np.asarray(v, dtype=np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("image_key"), pa.array(grids, pa.list_(pa.int32())), pa.array(vectors, pa.list_(pa.float32()))], ["image_key", "grid", "embedding"])

    wanted = files.join(todo, "image_key", "left_semi").select("image_key", "content")
    new = wanted.mapInArrow(run, "image_key string, grid array<int>, embedding array<float>").select("image_key", dhash(F.col("grid")).alias("dhash"), "embedding")
    rows = todo.join(new, "image_key", "left").withColumn("found", F.col("dhash").isNotNull())
    return rows if known is None else align_cache(keys.select("image_key"), known.select("image_key", "dhash", "embedding", "found")).where("found").unionByName(rows)


def align_cache(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """Every key with its usable row of the cache; ``found`` is false for the others."""
    met = keys.join(cache.where("found"), "image_key", "left")
    return met.withColumn("found", F.coalesce("found", F.lit(False)))


def photo_pair_features(pairs: DataFrame, images: DataFrame, base: str, cand: str, keep: tuple[str, ...], *, stored: bool = False) -> DataFrame:
    """``keep`` and six features from ``images`` (image_key, dhash, embedding, found; stored or cheap), of pairs that are ``stored`` or will be; blank keys never match."""
    usable = images.where("found").select("image_key", "dhash", "embedding")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    keyed = pairs.select(*keep, *(F.when(~blank(c), F.col(c)).alias(f"_{s}") for s, c in (("base", base), ("cand", cand))))
    met = lookup_both(keyed, usable, "image_key", "_base", "_cand", ("dhash", "embedding"), stored=stored)
    distance = hamming(F.col("base_dhash"), F.col("cand_dhash"))
    both = F.col("base_embedding").isNotNull() & F.col("cand_embedding").isNotNull()
    # least and greatest pass over nulls
    cosine = F.when(both, F.least(F.greatest(dot(F.col("base_embedding"), F.col("cand_embedding")), F.lit(-1.0)), F.lit(1.0)))
    return met.select(
        *keep,
        F.coalesce(distance / 64, F.lit(0.0)).alias("image_dhash_distance"),
        F.coalesce((distance == 0).cast("int"), F.lit(0)).alias("image_dhash_equal"),
        distance.isNotNull().cast("int").alias("image_hash_pair_known"),
        F.coalesce(cosine, F.lit(0.0)).alias("image_cosine"),
        both.cast("int").alias("image_embedding_pair_known"),
        (F.col("_base").isNull() | F.col("_cand").isNull()).cast("int").alias("image_missing"),
    )
