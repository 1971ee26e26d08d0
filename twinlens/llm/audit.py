"""How filters overlap: what each removes in every order of application, and its exact Shapley value.

One pass over the documents gives each the set of filters that it fails, as a mask; the rest is arithmetic on the counts of the 32 masks of each part.
The documents that a set of filters removes are a function on the corners of the unit cube. Its multilinear extension is one polynomial for each part: a document with
mask M adds 1 - prod(1 - x_i for i in M). Its value at a corner is what that set of filters removes, so all orders and steps read their survivors from
corners; a filter's Shapley value is the integral of the partial derivative along the diagonal, which is summed exactly with rationals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import BROADCAST_ROWS, materialize

#: Filters in the order of their mask bits.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 200, 50, 2
_MARKS = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_FOLLOWING = bytes(range(0x80, 0xC0))  # bytes that begin no code point
_MASKS = 1 << len(FILTERS)
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_REPORT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)


def own_failures(text: bytes) -> int:
    """Bits of A to D, which a text fails by itself. Words end at ASCII white space."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _FOLLOWING))
    fails = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words),
        100 * capitals > MOST_CAPITALS_PERCENT * points,
        _MARKS.search(text) is not None,
    )
    return sum(bit << i for i, bit in enumerate(fails))


@F.arrow_udf(IntegerType())
def _own(texts: pa.Array) -> pa.Array:
    return pa.array([own_failures(t.as_py()) for t in texts], pa.int32())


def failures(documents: DataFrame) -> DataFrame:
    """doc_id, source and mask (a bit for each filter that the text fails, A lowest) of every row; null texts count as empty.

    E compares digests of whole texts: a row fails it if a smaller doc_id has the same text. A null doc_id is smaller than none and has none below it.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select("doc_id", "source", text.alias("text"))
    narrow = materialize(rows.select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), _own(F.col("text").cast("binary")).alias("own")), "audit-documents")
    repeated = materialize(narrow.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "audit-repeated")
    # many copies have one digest: few digests are broadcast, of many Spark splits the skewed partitions
    repeated = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).cast("int")
    return narrow.join(repeated, "digest", "left").select("doc_id", "source", F.col("own").bitwiseOR(F.shiftleft(copy, 4)).alias("mask"))


class Removals:
    """The removal polynomial of the documents counted by mask: sum over T of ``a[T] * prod(x_i for i in T)``."""

    def __init__(self, counts: list[int]):
        self.a = [0] * _MASKS
        for mask, n in enumerate(counts):
            if n:
                inside = mask  # each set of filters T in the mask but the empty one: 1 - prod(1 - x_i) = -sum over T of (-1)^|T| prod(x_i)
                while inside:
                    self.a[inside] -= n * (-1) ** inside.bit_count()
                    inside = (inside - 1) & mask
        self.corner = [sum(self.a[t] for t in range(_MASKS) if t & corner == t) for corner in range(_MASKS)]

    def shapley(self, i: int) -> Fraction:
        """The integral from 0 to 1 of the partial derivative by x_i at (t, ..., t), where a monomial T has t^(|T| - 1)."""
        return sum((Fraction(self.a[t], t.bit_count()) for t in range(_MASKS) if t >> i & 1), Fraction(0))


def audit_part(part: str, counts: list[int], good: list[int], toxic: list[int]) -> list[tuple]:
    """Rows of all orders and steps of one part, from its documents, good ones and toxic ones by mask."""
    every, good_ones, toxic_ones = Removals(counts), Removals(good), Removals(toxic)
    n, orders = sum(counts), factorial(len(FILTERS))
    scaled = [orders * every.shapley(i) for i in range(len(FILTERS))]
    assert all(s.denominator == 1 for s in scaled)
    rows = []
    for order in permutations(range(len(FILTERS))):
        before, name = 0, "".join(FILTERS[i] for i in order)
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            lost = [p.corner[after] - p.corner[before] for p in (every, good_ones, toxic_ones)]
            rows.append((part, name, step, n - every.corner[after], lost[0], every.corner[1 << i] - lost[0], counts[1 << i], lost[1], lost[2], int(scaled[i])))
            before = after
    return rows


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(_COUNTS)]
    names = ["part", "filter_order", "step", *_COUNTS]
    for batch in batches:
        for row in batch.to_pylist():
            rows = audit_part(row["part"], row["counts"], row["good"], row["toxic"])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The effect of five filters on ``documents`` (doc_id, text, source) in each of their 120 orders, for every source.

    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley (the filter's removals summed over all orders).
    ``labels`` (doc_id, quality, toxic) tells good and toxic documents; a document with several rows there is good if one of them says so, toxic likewise. Null
    sources are the part of the empty string, null texts are empty. Repeated rows count each. Without documents there are no parts and no rows; extra columns are ignored.
    """
    masks = failures(documents)
    named = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c) for c in ("quality", "toxic")))
    # labels are as many as documents at most; ids spread evenly, and rows are a few numbers each
    met = masks.join(named, "doc_id", "left").groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "mask")
    counts = met.agg(F.count("*").alias("n"), F.sum(F.coalesce("quality", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    by_mask = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("m"))  # 32 masks at most
    each = lambda name: F.transform(F.sequence(F.lit(0), F.lit(_MASKS - 1)), lambda i: F.coalesce(F.try_element_at("m", i)[name], F.lit(0).cast("long")))
    return by_mask.select("part", each("n").alias("counts"), each("good").alias("good"), each("toxic").alias("toxic")).mapInArrow(_audit, _REPORT)
