"""Hard negatives for embedding training by norm-bucketed inner-product search.

Vectors are scaled to whole numbers, sorted by norm and cut into buckets. Blocks of anchors go through the buckets from the longest vectors down. By Cauchy-Schwarz no
score in a bucket exceeds its largest norm times the anchor's, so an anchor is done with a stripe of buckets once that product is below all that it still
looks for: first the running score of its k-th positive; then, for each positive, the greater of its window's lower limit and the running
score of its k-th negative. A block is sent no bucket that its windows' lower limits rule out.

Anchors and buckets meet in tiles: one block of anchors, one stripe of buckets. Every stripe has buckets of all norms. A tile's task holds the anchors, one bucket at
a time and the best of each anchor, and returns these only; the best of all stripes are chosen by a window over a few rows for each stripe.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

SCALE, POSITIVES, NEGATIVES, LOW_PERCENT, HIGH_PERCENT = 256, 5, 3, 50, 95
#: Vectors of a bucket, anchors of a block, and buckets of a stripe at most on average.
BUCKET, ANCHORS, STRIPE = 2048, 1024, 64
#: Up to this product of norms all sums are exact in doubles, and up to the other in 64 bits.
_EXACT, _LONGEST = 2.0**52, 2.0**31
#: Room for the rounding of norms.
_ROOM = 1 + 1e-9
_ROWS = "key long, vec_id long, label long, anchor boolean, size int, norm double, vector binary"
_BLOCK = "block long, size int, top double, need double, keys binary, ids binary, labels binary, norms binary, vectors binary, windows binary"
_FOUND = "anchor long, positive long, found long, found_id long, score long"


def _scaled(scale: int):
    """Adds size, norm and the whole numbers floor(scale * x), as doubles, of vectors without nulls; leaves out those that are too long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            sizes = np.asarray(vectors.value_lengths()).astype(np.int32)
            with np.errstate(over="ignore"):
                flat = np.floor(np.asarray(vectors.flatten(), dtype=np.float64) * scale)
                ends = np.cumsum(sizes)
                norms = np.array([np.sqrt(np.dot(v, v)) for v in np.split(flat, ends[:-1])]) if len(sizes) else np.zeros(0)
            blobs = [flat[e - s : e].tobytes() for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            out = pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "vec_id", "label", "anchor")), pa.array(sizes), pa.array(norms), pa.array(blobs, pa.binary())],
                ["key", "vec_id", "label", "anchor", "size", "norm", "vector"],
            )
            yield out.filter(pa.array(norms < _LONGEST))

    return run


def _cut(rows_of_block: int):
    """Blocks of rows that come sorted by size; each has vectors of one size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 33, None

        def block(t: pa.Table) -> pa.RecordBatch:
            norms, size = t.column("norm").to_numpy(), t.column("size")[0].as_py()
            windows = t.column("windows").combine_chunks().flatten().to_numpy().astype("<i8").tobytes()
            numbers = [t.column(c).to_numpy().astype("<i8").tobytes() for c in ("key", "vec_id", "label")]
            row = [number, size, norms.max(), t.column("need").to_numpy().min(), *numbers, norms.tobytes(), b"".join(t.column("vector").to_pylist()), windows]
            types = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, types, strict=True)], [c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (pa.concat_tables([held, table]) if held is not None else table).combine_chunks()
            at, sizes = 0, table.column("size").to_numpy()
            while at < len(sizes):
                end = min(at + rows_of_block, int(np.searchsorted(sizes, sizes[at], side="right")))
                if end == len(sizes) and end - at < rows_of_block:
                    break  # the next batch may go on with it
                yield block(table.slice(at, end - at))
                at, number = end, number + 1
            held = table.slice(at)
        if held is not None and held.num_rows:
            yield block(held)

    return run


def norm_blocks(rows: DataFrame, n: int, *, windows: Column | None = None, need: Column | None = None) -> DataFrame:
    """``rows`` sorted by norm, longest first (or by what they need, where that is given), in blocks of ``n``, as a written table."""
    rows = rows.select("key", "vec_id", "label", "size", "norm", "vector", (F.lit(0.0) if need is None else need).alias("need"), (F.array().cast("array<long>") if windows is None else windows).alias("windows"))
    order = [F.col("size"), F.col("norm").desc() if need is None else F.col("need").desc(), F.col("key")]
    return materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_cut(n), _BLOCK), "negatives-blocks")


class Block:
    def __init__(self, row: dict):
        self.keys, self.ids, self.labels = (np.frombuffer(row[c], "<i8") for c in ("keys", "ids", "labels"))
        self.norms, self.top = np.frombuffer(row["norms"], np.float64), row["top"]
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(self.keys), -1)

    def scores(self, which: np.ndarray, bucket: Block) -> np.ndarray:
        """Exact inner products of some rows with all of the bucket."""
        x, y = self.vectors[which], bucket.vectors
        if self.top * bucket.top <= _EXACT:
            return (x @ y.T).astype(np.int64)
        return x.astype(np.int64) @ y.astype(np.int64).T


class Best:
    """The k greatest entries of each slot; equal scores go by the smaller id."""

    def __init__(self, slots: int, k: int):
        self.k, self.kth = k, np.full(slots, np.iinfo(np.int64).min)  # the k-th score so far
        self.slot = self.score = self.id = self.key = np.zeros(0, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        if not len(slot):
            return
        both = [np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids), (self.key, keys))]
        order = np.lexsort((both[3], both[2], -both[1], both[0]))
        slot = both[0][order]
        starts = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        place = np.arange(len(slot)) - np.repeat(starts, np.diff(np.append(starts, len(slot))))
        kept = place < self.k
        self.slot, self.score, self.id, self.key = (x[order][kept] for x in both)
        last = place[kept] == self.k - 1
        self.kth[self.slot[last]] = self.score[last]


class Positives:
    """Of a block of anchors: the best other rows of the same label."""

    def __init__(self, row: dict, k: int, low: int, high: int):
        self.anchors = Block(row)
        self.best = Best(len(self.anchors.keys), k)

    def meet(self, bucket: Block) -> bool:
        """False if no shorter bucket can have anything more."""
        a = self.anchors
        live = np.flatnonzero(a.norms * bucket.top * _ROOM >= self.best.kth)
        if not len(live):
            return False
        scores = a.scores(live, bucket)
        i, j = np.nonzero((scores >= self.best.kth[live, None]) & (a.labels[live, None] == bucket.labels) & (a.keys[live, None] != bucket.keys))
        self.best.add(live[i], scores[i, j], bucket.ids[j], bucket.keys[j])
        return True

    def rows(self) -> list[np.ndarray]:
        b = self.best
        return [self.anchors.keys[b.slot], b.key, b.key, b.id, b.score]


class Negatives:
    """Of a block of anchors: for each window of scores, the best rows of other labels in it."""

    def __init__(self, row: dict, k: int, low: int, high: int):
        self.anchors = Block(row)
        self.anchor, self.positive, score = np.frombuffer(row["windows"], "<i8").reshape(-1, 3).T
        hundreds, rest = score // 100, score % 100
        self.low, self.high = hundreds * low - (-rest * low // 100), hundreds * high + rest * high // 100
        order = np.argsort(self.anchors.keys)
        self.of = order[np.searchsorted(self.anchors.keys[order], self.anchor)]
        self.best = Best(len(self.anchor), k)

    def meet(self, bucket: Block) -> bool:
        a = self.anchors
        least = np.maximum(self.low, self.best.kth)
        live = np.flatnonzero(a.norms[self.of] * bucket.top * _ROOM >= least)
        if not len(live):
            return False
        rows, at = np.unique(self.of[live], return_inverse=True)
        scores = a.scores(rows, bucket)
        other = a.labels[rows, None] != bucket.labels
        for some in np.array_split(np.arange(len(live)), -(-len(live) // ANCHORS)):
            w = live[some]
            met = scores[at[some]]
            i, j = np.nonzero((met >= least[w, None]) & (met <= self.high[w, None]) & other[at[some]])
            self.best.add(w[i], met[i, j], bucket.ids[j], bucket.keys[j])
        return True

    def rows(self) -> list[np.ndarray]:
        b = self.best
        return [self.anchor[b.slot], self.positive[b.slot], b.key, b.id, b.score]


def _search(kind: Callable, k: int, low: int, high: int):
    """Each tile's best; its anchors come first, then its buckets from the longest vectors down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, search, more = None, None, False

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in search.rows()], [c.split()[0] for c in _FOUND.split(", ")])

        for batch in batches:
            for i in range(batch.num_rows):
                # the buckets that a search is done with aren't even unpacked
                own = (batch.column("tile")[i].as_py(), batch.column("stripe")[i].as_py())
                if own != tile:
                    if search is not None:
                        yield out()
                    tile, search, more = own, kind(batch.slice(i, 1).to_pylist()[0], k, low, high), True
                elif more:
                    more = search.meet(Block(batch.slice(i, 1).to_pylist()[0]))
        if search is not None:
            yield out()

    return run


def search(anchors: DataFrame, buckets: DataFrame, kind: Callable, k: int, low: int = 0, high: int = 0) -> DataFrame:
    """Every stripe's best for the blocks of ``anchors``, from all ``buckets`` whose vectors are long enough."""
    n, m = buckets.count(), anchors.count()
    stripes = max(1, min(n, max(-(-n // STRIPE), -(-2 * buckets.sparkSession.sparkContext.defaultParallelism // max(m, 1)))))
    # a stripe has buckets of every norm, as many as any other
    dealt = buckets.withColumn("stripe", F.pmod(F.xxhash64("block"), F.lit(stripes)).cast("int"))
    tiles = anchors.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))).withColumn("tile", F.col("block"))
    asks = tiles.select("tile", "stripe", F.col("size").alias("tile_size"), F.col("need").alias("tile_need"))
    sent = dealt.join(asks, "stripe").where("size = tile_size and top * (1 + 1e-9) >= tile_need").drop("tile_size", "tile_need")
    met = tiles.withColumn("turn", F.lit(0)).unionByName(sent.withColumn("turn", F.lit(1)))
    ordered = met.repartition("tile", "stripe").sortWithinPartitions("tile", "stripe", "turn", F.col("top").desc(), "block")
    return ordered.mapInArrow(_search(kind, k, low, high), _FOUND)


def mine_negatives(
    vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW_PERCENT, high: int = HIGH_PERCENT, scale: int = SCALE
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for the rows of ``vectors`` (vec_id, embedding, label) for which ``anchor`` holds.

    Scores are inner products of floor(scale * x). Positives are the ``positives`` best other rows of the anchor's label; negatives of each are the ``negatives`` best rows of
    other labels whose score is ``low`` to ``high`` percent of the positive's. Fewer are returned where there are fewer; equal scores go by the smaller vec_id.

    Rows with a null vec_id or label, a null vector or a null or non-finite component take no part, nor do vectors whose scaled norm is 2^31 or more, as scores of such don't
    fit in 64 bits. Vectors of different lengths aren't compared; vectors without components have score 0. A repeated row is another row. No rows, no rows; extra columns are ignored.
    """
    fit = F.expr("vec_id is not null and label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    rows = vectors.select("vec_id", "embedding", "label", F.coalesce(anchor, F.lit(False)).alias("anchor")).where(F.coalesce(fit, F.lit(False)))
    keyed = rows.select(F.monotonically_increasing_id().alias("key"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "anchor", "embedding")
    table = materialize(keyed.mapInArrow(_scaled(scale), _ROWS), "negatives-rows")
    buckets = norm_blocks(table, BUCKET)
    anchors = norm_blocks(table.where("anchor"), ANCHORS)
    best = lambda *by: Window.partitionBy(*by).orderBy(F.col("score").desc(), "found_id", "found")
    found = search(anchors, buckets, Positives, positives).withColumn("place", F.row_number().over(best("anchor"))).where(F.col("place") <= positives)
    found = materialize(found.select("anchor", F.col("found").alias("positive"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    discard(anchors)
    # a window below zero is empty; an anchor has a few windows
    asked = found.where("positive_score >= 0").groupBy(F.col("anchor").alias("key"))
    asked = asked.agg(F.flatten(F.collect_list(F.array("anchor", "positive", "positive_score"))).alias("windows"), F.min("positive_score").alias("least"))
    # what the shortest useful vector's norm is at least, less the rounding
    need = F.when(F.col("norm") > 0, F.col("least") * low / 100 / F.col("norm")).otherwise(F.lit(0.0))
    anchors = norm_blocks(table.where("anchor").join(asked, "key"), ANCHORS, windows=F.col("windows"), need=need)
    last = search(anchors, buckets, Negatives, negatives, low, high).withColumn("rank", F.row_number().over(best("anchor", "positive"))).where(F.col("rank") <= negatives)
    ids = table.where("anchor").select(F.col("key").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    named = last.select("anchor", "positive", "rank", F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score")).join(found, ["anchor", "positive"]).join(ids, "anchor")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
