"""Hard negatives by a secondary-sort shuffle (dealt operator 12).

Pair scores are packed into keys of (anchor, falling score, positives before negatives, id), dealt by anchor and sorted within
partitions. An iterator reads them as a stream: a positive opens a window of scores, and a negative is emitted for each open
window that it lies in, until the window has its number of negatives. It holds the windows of one anchor, never its pairs.

Pairs are thinned before the shuffle without loss: a cell of the grid keeps its first positives of each anchor, and, once
the anchor's positives are known, its first negatives of each of their windows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.shared import stored
from lectern.llm.vectors import QUERIES, ROWS, Shape, first_of_each, grid, is_query, matrix, products, runs, shape, usable

#: A window reaches from LOW to HIGH hundredths of its positive's score.
LOW, HIGH = 50, 95
_KEY = struct.Struct(">QQBQ")
_MIDDLE = 1 << 63


def pack(anchor: int, score: int, negative: bool, ident: int) -> bytes:
    """A key whose bytes order pairs by anchor, falling score, positives before negatives, and id."""
    return _KEY.pack(anchor + _MIDDLE, _MIDDLE - 1 - score, negative, ident + _MIDDLE)


def unpack(key: bytes) -> tuple[int, int, bool, int]:
    anchor, score, negative, ident = _KEY.unpack(key)
    return anchor - _MIDDLE, _MIDDLE - 1 - score, bool(negative), ident - _MIDDLE


def mine(keys: Iterator[bytes], negatives: int = 3, low: int = LOW, high: int = HIGH) -> Iterator[tuple[int, int, int, int, int, int]]:
    """anchor, positive, rank, negative and both scores, from sorted keys; a key that repeats counts as often as it stands there."""
    at, windows = None, []  # of the anchor: positive, its score, negatives so far
    for key in keys:
        anchor, score, negative, ident = unpack(key)
        if anchor != at:
            at, windows = anchor, []
        if not negative:
            windows.append([ident, score, 0])
            continue
        for w in windows:
            if w[2] < negatives and low * w[1] <= 100 * score <= high * w[1]:
                w[2] += 1
                yield anchor, w[0], w[2], ident, w[1], score


class Best:
    """The first k pairs (score, id, row) of each group that were met."""

    def __init__(self, groups: int, k: int):
        self.k, self.floor = k, np.full(groups, -(2**62))
        self.group, self.score, self.ident, self.row = (np.zeros(0, np.int64) for _ in range(4))

    def keep(self, group: np.ndarray, score: np.ndarray, ident: np.ndarray, row: np.ndarray) -> None:
        own = np.flatnonzero(np.isin(self.group, group))  # only groups that met something change
        rest = np.setdiff1d(np.arange(len(self.group)), own)
        parts = [np.append(x[own], y) for x, y in ((self.group, group), (self.score, score), (self.ident, ident), (self.row, row))]
        first = first_of_each(*parts[:3], self.k)
        self.group, self.score, self.ident, self.row = (np.append(x[rest], y[first]) for x, y in zip((self.group, self.score, self.ident, self.row), parts, strict=True))
        groups, counts = np.unique(parts[0][first], return_counts=True)
        last = np.cumsum(counts) - 1
        self.floor[groups[counts == self.k]] = parts[1][first][last[counts == self.k]]


class Anchors:
    """Anchors of one cell. Without windows it keeps the first positives of each, with windows the first negatives of each."""

    def __init__(self, batch: pa.RecordBatch, width: int, positives: int, negatives: int, windows: bool):
        self.rows, self.labels, self.v = batch.column("row").to_numpy(), batch.column("label").to_numpy(), matrix(batch.column("v"), width)
        if not windows:
            self.best = Best(len(self.rows), positives)
            self.low = None
            return
        tops = batch.column("tops")
        scores, held = matrix(tops, positives), tops.value_lengths().to_numpy(zero_copy_only=False)
        none = np.arange(positives) >= held[:, None]
        # 100 * score is at least LOW * positive, and at most HIGH * positive
        self.low, self.high = np.where(none, 1, -(-LOW * scores // 100)), np.where(none, 0, HIGH * scores // 100)
        self.best = Best(scores.size, negatives)

    def see(self, batch: pa.RecordBatch) -> None:
        v, labels = matrix(batch.column("v"), self.v.shape[1]), batch.column("label").to_numpy()
        rows, ids = batch.column("row").to_numpy(), batch.column("vec_id").to_numpy()
        for start in range(0, len(self.rows), QUERIES):
            part = slice(start, start + QUERIES)
            scores, same = products(self.v[part], v), self.labels[part, None] == labels[None, :]
            if self.low is None:
                a, x = np.nonzero(same & (scores >= self.best.floor[part, None]) & (self.rows[part, None] != rows[None, :]))
                self.best.keep(a + start, scores[a, x], ids[x], rows[x])
                continue
            for r in range(self.low.shape[1]):
                windows = np.arange(start, start + len(scores)) * self.low.shape[1] + r
                least = np.maximum(self.low[part, r], self.best.floor[windows])
                a, x = np.nonzero((scores >= least[:, None]) & (scores <= self.high[part, r, None]) & ~same)
                self.best.keep(windows[a], scores[a, x], ids[x], rows[x])

    def results(self) -> pa.RecordBatch:
        """Pairs of anchor and row; a negative of several windows once."""
        anchor = self.rows[self.best.group // (1 if self.low is None else self.low.shape[1])]
        pairs = np.stack([anchor, self.best.score, self.best.ident, self.best.row], 1)
        pairs = pairs if self.low is None else np.unique(pairs, axis=0)
        return pa.record_batch([pa.array(x) for x in pairs.T], names=["anchor", "score", "vec_id", "row"])


def _pairs(anchors: DataFrame, rows: DataFrame, size: Shape, positives: int, negatives: int, windows: bool) -> DataFrame:
    """anchor (its row), score, vec_id and row that some cell keeps."""
    dealt = grid(anchors, rows, size, 16 * size.width + 128).sortWithinPartitions("cell", "tag", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, held = None, [], None
        for cell, tag, batch in runs(batches, ROWS):
            if cell != at:
                if held:
                    yield held.results()
                at, asked, held = cell, [], None
            if not tag:
                asked.append(batch)
            elif asked:
                held = held or Anchors(pa.Table.from_batches(asked).combine_chunks().to_batches()[0], size.width, positives, negatives, windows)
                held.see(batch)
        if held:
            yield held.results()

    return dealt.mapInArrow(run, "anchor long, score long, vec_id long, row long")


def hard_negatives(spark: SparkSession, table: DataFrame, positives: int = 5, negatives: int = 3, every: int = 50) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each anchor and each of its positives, the
    first negatives whose score lies in the positive's window.

    table has vec_id, embedding and label; anchors are its rows whose id is divisible by every, positives their first other
    rows of the same label. Rows without id, label or vector, or with a component that is null or not finite, take no part.
    Vectors of different lengths meet as if zeros followed the shorter. Of rows that repeat an id each is a row of its own. An
    anchor without positives, or a window without negatives, gives no row, and so does an empty table. A score of zero opens
    a window of zero alone, a score below zero none. Other columns are ignored. Scores have 64 bits.
    """
    rows = usable(table.where("label is not null").select("vec_id", "embedding", "label"))
    query = is_query(F.col("vec_id"), every)
    size = shape(rows, query)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not size.queries:
        return spark.createDataFrame([], schema)
    rows = stored(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v").withColumn("row", F.monotonically_increasing_id()), "vectors")
    anchors = rows.where(query)
    met = _pairs(anchors, rows, size, positives, negatives, windows=False)
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.col("score").desc(), "vec_id", "row"))
    first = stored(met.withColumn("rank", rank).where(F.col("rank") <= positives).drop("rank"), "positives")
    tops = first.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list("score"), asc=False).alias("tops"))
    asked = anchors.join(tops, "row")
    found = _pairs(asked, rows, size, positives, negatives, windows=True)
    keyed = first.select("anchor", "score", F.lit(False).alias("negative"), "vec_id").union(found.select("anchor", "score", F.lit(True), "vec_id"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = keyed.rdd.map(lambda r: (pack(*r), None))
    in_order = keys.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:8]))
    mined = in_order.mapPartitions(lambda pairs: mine((key for key, _ in pairs), negatives))
    named = spark.createDataFrame(mined, "row long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return named.join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
