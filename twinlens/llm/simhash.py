"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints' 64 bits are grouped into partitions, correlated bits together. Two fingerprints that differ in
at most T bits differ in at most t_i bits of some partition i, if the sum of the t_i + 1 is T + 1; a t_i of -1
leaves its partition out. Dynamic programming allocates the t_i by the candidates they are estimated to give.
Every fingerprint is then put under its own key of each partition and under the keys within t_i bits,
and what meets under a key is verified. Tasks return spanning forests of the links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, connected_components, fresh, materialize, row_key, with_keys
from .forest import Forest

SHINGLE_WORDS, MAX_BITS, SEED = 4, 4, 42
#: Numbers of partitions to choose from.
PARTITIONS = (3, 4, 5)
#: What a probe costs, in comparisons.
PROBE_COST = 20
#: Fingerprints of one key that a task compares at once; larger groups are split into pairs of blocks.
BLOCK = 4096


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text in UTF-8: its words split at ASCII white space with A-Z lowered, shingles with repeats.

    A shorter text is one shingle; a text without words has fingerprint zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    hash_ = xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        hashes = [hash_(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes).tolist()
        hashes = [hash_(joined[a:b], SEED) for a, b in zip(starts, ends[shingle_words - 1 :].tolist(), strict=False)]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, row (a hash of the row's id and text) and fp (the fingerprint's 64 bits as a long) of every document; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py() or b"", shingle_words) for t in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "row", "fp"])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", row_key(documents).alias("row"), F.col("text").cast("string").cast("binary")).mapInArrow(run, f"doc_id {kind}, row long, fp long")


def _correlations(fps: DataFrame) -> np.ndarray:
    """Correlations of the 64 bits over all fingerprints: sums per task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((65, 65))
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            bits = np.ones((len(fp), 65), dtype=np.float32)
            bits[:, :64] = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total += bits.T @ bits
        i, j = np.triu_indices(65)
        yield pa.RecordBatch.from_arrays([pa.array(i * 65 + j), pa.array(total[i, j])], ["cell", "n"])

    sums = np.zeros((65, 65))
    for row in fps.select("fp").mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        sums.flat[row["cell"]] = row["n"]
    n = max(sums[64, 64], 1)
    both = (sums + np.triu(sums, 1).T)[:64, :64] / n
    mean = np.diag(both)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    return (both - np.outer(mean, mean)) / np.outer(spread, spread)


def group_bits(correlations: np.ndarray, partitions: int) -> list[list[int]]:
    """Bits dealt to partitions of nearly equal width: each partition starts with the most correlated free pair and takes the bits closest to it."""
    close = np.abs(correlations).copy()
    np.fill_diagonal(close, -1)
    free, groups = set(range(64)), []
    for k in range(partitions):
        width = 64 // partitions + (k < 64 % partitions)
        rest = sorted(free)
        part = close[np.ix_(rest, rest)]
        i, j = np.unravel_index(int(part.argmax()), part.shape)
        group = [rest[i], rest[j]]
        free -= set(group)
        while len(group) < width:
            rest = sorted(free)
            nearest = rest[int(close[np.ix_(rest, group)].mean(axis=1).argmax())]
            group.append(nearest)
            free.remove(nearest)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 of least total cost with the sum of t_i + 1 equal to ``budget``; costs[i][t + 1] is partition i's cost of t."""
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * budget
    for cost in costs:
        best = [min((best[b - x][0] + cost[x], [*best[b - x][1], x - 1]) for x in range(min(b + 1, len(cost)))) for b in range(budget + 1)]
    return best[budget]


def _key(fp: Column, bits: list[int]) -> Column:
    key = F.lit(0).cast("long")
    for k, bit in enumerate(bits):
        key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, bit).bitwiseAND(F.lit(1).cast("long")), k))
    return key


def _ball(width: int, t: int) -> int:
    return sum(comb(width, k) for k in range(t + 1))


def plan_partitions(fps: DataFrame, max_bits: int = MAX_BITS) -> list[tuple[list[int], int]]:
    """Bits and threshold of each partition that is used, for the distinct fingerprints ``fps``.

    The candidates of a threshold are estimated from the sum of the squared counts of the partition's keys over
    all fingerprints, times the number of keys within that many bits.
    """
    correlations = _correlations(fps)
    layouts = {m: group_bits(correlations, m) for m in PARTITIONS}
    flat = [(m, i, bits) for m, groups in layouts.items() for i, bits in enumerate(groups)]
    keys = F.array(*(F.struct(F.lit(k).alias("k"), _key(F.col("fp"), bits).alias("key")) for k, (_, _, bits) in enumerate(flat)))
    counts = fps.select(F.explode(keys).alias("x")).select("x.*").groupBy("k", "key").agg(F.count("*").alias("n"))
    met = {r["k"]: (r["n"], r["squares"]) for r in counts.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares")).collect()}
    options = []
    for m in PARTITIONS:
        costs, groups = [], []
        for k, (of, _, bits) in enumerate(flat):
            if of == m:
                n, squares = met.get(k, (0, 0))
                costs.append([0.0] + [_ball(len(bits), t) * (squares / 2 + PROBE_COST * n) for t in range(max_bits + 1)])
                groups.append(bits)
        total, thresholds = allocate(costs, max_bits + 1)
        options.append((total, [(bits, t) for bits, t in zip(groups, thresholds, strict=True) if t >= 0]))
    return min(options, key=lambda x: x[0])[1]


def _compare(max_bits: int):
    """Links among the rows of one key; rows come sorted by group (part, key, lo, hi)."""

    def among(group: np.ndarray, fp: np.ndarray, probe: np.ndarray, cross: np.ndarray, block: np.ndarray, found: Forest) -> None:
        change = np.flatnonzero(np.append(True, np.any(group[1:] != group[:-1], axis=1)))
        sizes = np.diff(np.append(change, len(fp)))
        rest = np.repeat(change + sizes, sizes) - np.arange(len(fp))  # rows of the group from this one on
        rows, d = np.arange(len(fp)), 0
        while True:
            d += 1
            rows = rows[rest[rows] > d]
            if not len(rows):
                return
            to = rows + d
            near = np.bitwise_count(fp[rows] ^ fp[to]) <= max_bits
            near &= ~(probe[rows] & probe[to]) & (~cross[rows] | (block[rows] != block[to])) & (fp[rows] != fp[to])
            found.add(fp[rows[near]].view(np.int64), fp[to[near]].view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, kept = Forest(), None
        for batch in batches:
            cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("part", "key", "lo", "hi", "block", "probe", "fp")]
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            last = np.all([c[:] == c[-1] for c in cols[:4]], axis=0)
            start = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            kept = [c[start:] for c in cols]
            if start:
                _run([c[:start] for c in cols], found)
        if kept is not None and len(kept[0]):
            _run(kept, found)
        a, b = found.links()
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def _run(cols: list[np.ndarray], found: Forest) -> None:
        part, key, lo, hi, block, probe, fp = cols
        among(np.stack([part.astype(np.int64), key, lo.astype(np.int64), hi.astype(np.int64)], axis=1), fp.view(np.uint64), probe.astype(bool), lo != hi, block, found)

    return run


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """A spanning forest (a, b) of the links between the distinct fingerprints ``fps`` (column fp, a written table)."""
    plan = plan_partitions(fps, max_bits)
    rows = []
    for k, (bits, t) in enumerate(plan):
        masks = [sum(1 << b for b in c) for r in range(t + 1) for c in combinations(range(len(bits)), r)]
        met = fps.select(F.lit(k).alias("part"), _key(F.col("fp"), bits).alias("own"), "fp").withColumn("mask", F.explode(F.array(*(F.lit(m).cast("long") for m in masks))))
        met = met.withColumn("key", F.col("own").bitwiseXOR(F.col("mask"))).withColumn("probe", F.col("mask") != 0)
        # of two fingerprints under neighbouring keys, the one with the smaller key probes
        rows.append(met.where("key >= own").select("part", "key", "probe", "fp"))
    probes = rows[0]
    for more in rows[1:]:
        probes = probes.unionByName(more)
    large = materialize(probes.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "simhash-large")
    met = probes.join(large, ["part", "key"], "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int"))
    met = met.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # a large group's block i meets each block j under the pair (i, j)
    met = met.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("part", "key", F.least("block", "j").alias("lo"), F.greatest("block", "j").alias("hi"), "block", "probe", "fp")
    dealt = met.repartition("part", "key", "lo", "hi").sortWithinPartitions("part", "key", "lo", "hi")
    return dealt.mapInArrow(_compare(max_bits), "a long, b long")


def _components(documents: DataFrame, shingle_words: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: doc_id, row and fp of every document, and fp, root of every fingerprint."""
    docs = materialize(fingerprints(documents, shingle_words), "simhash-documents")
    fps = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-fingerprints")
    found = connected_components(fingerprint_links(fps, max_bits), "simhash").withColumnRenamed("id", "fp")
    roots = fps.join(found, "fp", "left").select("fp", "first", F.coalesce("component_id", "fp").alias("root"))
    return docs, materialize(roots, "simhash-roots")


def _spread(table: DataFrame) -> DataFrame:
    """A written table of one row for each component or fingerprint, of which one may have most documents: broadcast if it is small, so that they aren't
    gathered; else joined by a shuffle whose skewed partitions Spark splits."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def near_duplicates(documents: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable by links) of every document.

    Documents with one fingerprint are linked; so are documents whose fingerprints differ in at most ``max_bits`` bits. Rows
    that repeat an id are each kept. A null doc_id gets its component's smallest id, or null if it has
    none. Extra columns are ignored; no documents, no rows.
    """
    docs, roots = _components(documents, shingle_words, max_bits)
    least = materialize(roots.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    named = materialize(roots.join(_spread(least), "root").select("fp", "component_id"), "simhash-components")
    return docs.join(_spread(named), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(documents: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``documents``, with all their columns, of which one row of each component stays: that of its smallest doc_id.

    Null ids come last; of rows that share the smallest id any one text stays, the same in every run; of rows alike in id and
    text the one whose columns, as JSON, come first. Null and wordless texts are alike, so one of them stays. Columns may
    have any names and kinds; no documents, no rows.
    """
    docs, roots = _components(documents, shingle_words, max_bits)
    key, nth = fresh(documents, "row"), fresh(documents, "nth")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    best = docs.join(_spread(roots).select("fp", "root"), "fp").groupBy("root").agg(F.min(rank).alias("best")).select("best.row")
    times = docs.groupBy("row").agg(F.count("*").alias("n"))
    kept = materialize(times.join(best, "row", "left_semi").select(F.col("row").alias(key), F.col("n").alias("times")), "simhash-kept")
    keyed = documents.withColumn(key, row_key(documents))
    once = with_keys(keyed, kept.where("times = 1").select(key), "left_semi", key)
    # rows that occur several times, few if any, are put in order
    order = Window.partitionBy(key).orderBy(F.to_json(F.struct(*(F.col(f"`{c}`") for c in documents.columns))))
    again = with_keys(keyed, kept.where("times > 1").select(key), "left_semi", key).withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth)
    return once.unionByName(again).drop(key)
