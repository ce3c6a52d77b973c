"""Exact top-k search by pivot-table elimination (dealt operator 11).

For every row the distances to many pivots are computed once. For a query q, a row x and any pivot p, |d(q, p) - d(x, p)| is
at most d(q, x), so the largest such difference is a lower bound of the distance, and, since
2 <q, x> = |q|^2 + |x|^2 - d(q, x)^2, it gives an upper bound of the score. Rows stand near others of their pivot, so
stretches of them are eliminated by the range of their distances; in the others candidates are evaluated by falling bound,
until the bound is below the k-th score found. Any pivots give the same, exact results; they only decide how much is eliminated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.shared import stored
from lectern.llm.vectors import Shape, grid, is_query, matrix, products, runs, shape, usable

#: Rows that pivots are chosen from, and the number of pivots.
SAMPLE, PIVOTS = 512, 64
#: Rows of a stretch, and candidates that are evaluated before the first look at the bound; twice as many before each further one.
STRETCH, STEP = 512, 64
#: Distances are kept as single floats: so much of their size two of them can be wrong by.
SLACK = 2.0**-22
#: Below every score.
LEAST = -(2**62)


def farthest_first(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """n rows of the sample, each the farthest from those before it; fewer if the sample has fewer different rows."""
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < n:
        far = np.minimum(far, ((sample - sample[chosen[-1]]).astype(float) ** 2).sum(1))
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    return sample[chosen]


def norms(v: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", v, v)


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = norms(v)[:, None].astype(float) + norms(pivots)[None, :] - 2.0 * products(v, pivots)
    return np.sqrt(np.maximum(squares, 0)).astype(np.float32)


def pivot_table(rows: DataFrame, size: Shape, k: int) -> DataFrame:
    """row, vec_id, v, norm, d (distances to the pivots), near (the nearest pivot and how far it is) and least of each row, stored.

    least is the k-th score among the rows of the sample, a bound that every query starts from. The sample is chosen by a hash
    of the id and has SAMPLE rows at most, so what the driver sends to tasks does not grow with the table.
    """
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    sample = matrix(pa.array([r["v"] for r in taken], pa.list_(pa.int64())), size.width)
    ids, pivots = np.array([r["vec_id"] for r in taken]), farthest_first(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, STRETCH) for b in batches for at in range(0, b.num_rows, STRETCH)):
            v, vec_id = matrix(batch.column("v"), size.width), batch.column("vec_id")
            d, scores = distances(v, pivots), products(v, sample)
            scores[vec_id.to_numpy()[:, None] == ids[None, :]] = LEAST  # a row is no candidate of its own
            least = np.partition(scores, len(ids) - k, 1)[:, len(ids) - k] if k <= len(ids) else np.full(len(v), LEAST)
            near = d.argmin(1)
            lists = [pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel()) for x in (v, d)]
            columns = [vec_id, lists[0], pa.array(norms(v)), lists[1], pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(v)), near]), pa.array(least)]
            yield pa.record_batch(columns, names=["vec_id", "v", "norm", "d", "pivot", "away", "least"])

    made = rows.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<long>, norm long, d array<float>, pivot int, away float, least long")
    return stored(made.withColumn("row", F.monotonically_increasing_id()), "pivot-table")


class Search:
    """Queries of one cell with the k best candidates that they have met."""

    def __init__(self, batch: pa.RecordBatch, width: int, pivots: int, k: int):
        self.rows, self.ids = batch.column("row").to_numpy(), batch.column("vec_id").to_numpy()
        self.v, self.norm = matrix(batch.column("v"), width), batch.column("norm").to_numpy()
        self.most, self.floats = float(np.abs(self.v).max(initial=0)), self.v.astype(float)
        self.d, self.least, self.k = matrix(batch.column("d"), pivots), batch.column("least").to_numpy(), k
        n = len(self.rows)
        self.scores, self.found, self.counts = np.full((n, k), LEAST), np.zeros((n, k), np.int64), np.zeros(n, np.int64)
        self.evaluated = 0

    def see(self, batch: pa.RecordBatch) -> None:
        """Meets a stretch of rows."""
        v, norm, d = matrix(batch.column("v"), self.v.shape[1]), batch.column("norm").to_numpy(), matrix(batch.column("d"), self.d.shape[1])
        rows, ids = batch.column("row").to_numpy(), batch.column("vec_id").to_numpy()
        # floating point is exact up to 53 bits
        exact = float(np.abs(v).max(initial=0)) * self.most * v.shape[1] < 2**53
        left, right = (v.astype(float), self.floats) if exact else (v, self.v)
        slack = SLACK * (float(d.max(initial=0)) + float(self.d.max(initial=0)))
        apart = np.maximum(0, np.maximum(d.min(0) - self.d, self.d - d.max(0))).max(1)
        for q in np.flatnonzero(bound(self.norm, norm.max(), apart, slack) >= np.maximum(self.least, self.scores[:, -1])).tolist():
            bounds = bound(self.norm[q], norm, np.abs(d - self.d[q]).max(1), slack)
            bounds[rows == self.rows[q]] = LEAST
            order = np.argsort(-bounds, kind="stable")
            falling, vector = -bounds[order], right[q]
            least = max(self.least[q], self.scores[q, -1], LEAST + 1)
            at, step, end = 0, STEP, np.searchsorted(falling, -least, "right")
            while at < end:
                some = order[at : min(at + step, end)]
                scores = left[some] @ vector
                good = np.flatnonzero(scores >= least)
                if len(good):
                    self._keep(q, scores[good].astype(np.int64), ids[some[good]])
                    least = max(least, self.scores[q, -1])
                    end = min(end, np.searchsorted(falling, -least, "right"))
                at, step = at + len(some), 2 * step
                self.evaluated += len(some)

    def _keep(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        n = self.counts[q]
        scores, ids = np.concatenate([self.scores[q, :n], scores]), np.concatenate([self.found[q, :n], ids])
        best = np.lexsort((ids, -scores))[: self.k]
        self.counts[q] = n = len(best)
        self.scores[q, :n], self.found[q, :n] = scores[best], ids[best]

    def results(self) -> pa.RecordBatch:
        has = np.arange(self.k) < self.counts[:, None]
        each = lambda x: pa.array(np.repeat(x, self.counts))
        return pa.record_batch([each(self.rows), each(self.ids), pa.array(self.found[has]), pa.array(self.scores[has])], names=["row", "query_id", "vec_id", "score"])


def bound(a: np.ndarray, b: np.ndarray, apart: np.ndarray, slack: float) -> np.ndarray:
    """The largest inner product of vectors of squared norms a and b that are so far apart, but for the slack; rounding can only raise it."""
    apart = np.maximum(0, apart.astype(float) - slack)
    top = (a + b - apart * apart) / 2
    return np.minimum(np.floor(top + 1e-9 * np.abs(top) + 1e-6), 2.0**62).astype(np.int64)


def top_k(spark: SparkSession, table: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows with the highest inner products with each query; ties go to smaller ids.

    table has vec_id and embedding; queries are its rows whose id is divisible by every. Rows without an id or a vector, or with
    a component that is null or not finite, take no part. Vectors of different lengths meet as if zeros followed the shorter; an
    empty one scores 0 with all. Of rows that repeat an id each is a row: each is a query, and the others are its candidates.
    A query with fewer candidates gets all; no rows or no queries give no rows. Other columns are ignored. Scores have 64 bits.
    """
    rows = usable(table.select("vec_id", "embedding"))
    query = is_query(F.col("vec_id"), every)
    size = shape(rows, query)
    if not size.queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = pivot_table(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "v"), size, k)
    dealt = grid(rows.where(query), rows, size, 16 * size.width + 8 * PIVOTS).sortWithinPartitions("cell", "tag", "pivot", "away")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, search = None, [], None
        for cell, tag, batch in runs(batches, STRETCH):
            if cell != at:
                if search:
                    yield search.results()
                at, asked, search = cell, [], None
            if not tag:
                asked.append(batch)
            elif asked:
                search = search or Search(pa.Table.from_batches(asked).combine_chunks().to_batches()[0], size.width, len(batch.column("d")[0]), k)
                search.see(batch)
        if search:
            yield search.results()

    # a cell gives k rows a query; ranks are of a query's cells
    found = dealt.mapInArrow(run, "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
