"""Integer vectors: preparation, and a grid that brings every group of queries to every group of rows.

Used by operators 11 and 12. A cell of the grid holds queries of a bounded number of bytes and a part of all rows; one task
reads one cell: its queries first, then its rows as a stream. No task holds more than its queries and one batch of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of queries that one task holds, and of rows that one task reads.
QUERY_BYTES, ROW_BYTES = 64 << 20, 256 << 20
#: Queries and rows whose scores one task holds at once.
QUERIES, ROWS = 2048, 2048


def usable(table: DataFrame) -> DataFrame:
    """table with v, floor(256 * x) of each component as a double, without the rows that take no part: those without vec_id or
    vector, and those with a component that is null, infinite or no number."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < math.inf))
    rows = table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    return rows.withColumn("v", F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))))


def is_query(vec_id: Column, every: int = 50) -> Column:
    return vec_id % every == 0


@dataclass(frozen=True)
class Shape:
    """Rows, queries and the longest vector of a table. Shorter vectors count as if zeros followed."""

    rows: int
    queries: int
    width: int


def shape(rows: DataFrame, query: Column) -> Shape:
    got = rows.agg(F.count("*"), F.count_if(query), F.max(F.size("v"))).first()
    return Shape(got[0], got[1], max(1, got[2] or 1))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix; short lists are filled with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a with all rows of b, exact up to 64 bits: by floating point where it is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return np.rint(a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 2**53 else a @ b.T


def first_of_each(group: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group: higher scores first, then smaller ids. Sorted by group, then rank."""
    order = np.lexsort((ident, -score, group))
    starts = np.flatnonzero(np.diff(group[order], prepend=group[order][:1] - 1))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


def grid(queries: DataFrame, rows: DataFrame, size: Shape, bytes_each: int) -> DataFrame:
    """Both tables (the same columns, with a key: row) dealt over cells; a task reads one cell, its queries (tag 0) before its rows (tag 1).

    The number of query groups follows from QUERY_BYTES, that of row groups from ROW_BYTES and the session's partitions, so
    queries are repeated once a row group and rows once a query group. Dealing by a hash of row leaves no hot cell.
    """
    down = max(1, -(-size.queries * bytes_each // QUERY_BYTES))
    across = max(1, -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // down), -(-size.rows * bytes_each // ROW_BYTES))
    part = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.withColumn("tag", F.lit(0)).withColumn("i", every(across)).withColumn("cell", F.col("i") + F.lit(across) * part(down)).drop("i")
    read = rows.withColumn("tag", F.lit(1)).withColumn("j", every(down)).withColumn("cell", part(across) + F.lit(across) * F.col("j")).drop("j")
    return asked.unionByName(read, allowMissingColumns=True).repartitionById(down * across, F.col("cell"))


def runs(batches: Iterator[pa.RecordBatch], most: int = ROWS) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """cell, tag and at most so many rows of a stream that is sorted by cell and tag."""
    for batch in batches:
        cell, tag = (batch.column(c).to_numpy() for c in ("cell", "tag"))
        cuts = np.flatnonzero(np.diff(cell * 2 + tag, prepend=-1)).tolist() if len(cell) else []
        for start, end in zip(cuts, [*cuts[1:], len(cell)], strict=True):
            for at in range(start, end, most):
                yield int(cell[at]), int(tag[at]), batch.slice(at, min(most, end - at))
