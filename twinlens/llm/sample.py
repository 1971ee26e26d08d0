"""Bounded samples of labelled texts."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Bytes of text that a class's sample holds at most, but for its first text: the other half of the sample's bound.
SAMPLE_BYTES = 1 << 24


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, per_class_bytes: int = SAMPLE_BYTES) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` texts and ``per_class_bytes`` bytes of each class (h, text, y) by a hash of the text, and how many rows each class has.

    Only rows for which ``learn`` (of doc_id) holds take part, each text once and whole, in the order of their hashes until the
    class's sample is full; long texts are as likely to come first as others. Texts and ids with
    several different labels are left out; null labels and ids are ignored; a null text is empty.
    """
    one = labels.where(learn & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z").select("doc_id", F.col("y").cast("int").alias("y"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.where(learn).select("doc_id", text.alias("text")).select("doc_id", "text", F.xxhash64("text").alias("h"))
    met = rows.select("doc_id", "h", F.octet_length("text").alias("bytes")).join(one, "doc_id")
    known = met.groupBy("h").agg(F.min("y").alias("y"), F.max("y").alias("z"), F.count("*").alias("n"), F.max("bytes").alias("bytes")).where("y = z").select("h", "y", "n", "bytes")
    known = materialize(known, "labelled")
    sizes = {int(r["y"]): int(r["n"]) for r in known.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    picked: list[tuple[int, int]] = []
    for y in (0, 1):
        # per_class rows of two numbers at most
        first = known.where(F.col("y") == y).orderBy(F.xxhash64("h"), "h").select("h", "bytes").limit(per_class).collect()
        held = accumulate(r["bytes"] for r in first)
        picked += [(r["h"], y) for i, (r, n) in enumerate(zip(first, held, strict=True)) if not i or n <= per_class_bytes]
    keys = F.broadcast(documents.sparkSession.createDataFrame(picked, "h long, y int"))
    return rows.join(keys, "h").groupBy("h").agg(F.min("text").alias("text"), F.min("y").alias("y")), sizes
