"""Ordered scans within keys: ranks, next values, last values so far. A key may hold any part of the rows.

A window over a key puts all its rows into one task. Here rows are dealt by ranges of (key, order), so a large key spans several
tasks, and each task scans its own rows as a stream. Then it is handed over what a key's earlier tasks left: each task leaves one
row, so that table is small whatever the number of rows, and it is broadcast to the rows of the tasks' first keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from lectern.operators.durable import stored


def _differ(column: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """Whether each value differs from the one before it; nulls are equal. before: the last value of the batch before, if any."""
    whole = column if before is None else pa.concat_arrays([pa.array([before.as_py()], column.type), column])
    a, b = whole.slice(1), whole.slice(0, len(whole) - 1)
    equal = pc.fill_null(pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b))), False)
    out = ~equal.to_numpy(zero_copy_only=False)
    return np.append(True, out) if before is None else out


class _Ranks:
    """The place of each row in its key, from 1. A task leaves the number of its last key's rows."""

    def __init__(self, kind: pa.DataType):
        self.count, self.kind = 0, pa.int64()

    def values(self, starts: np.ndarray, _: np.ndarray, column: pa.Array) -> pa.Array:
        at = np.arange(len(starts))
        begun = np.maximum.accumulate(np.where(starts, at, -1))
        ranks = np.where(begun < 0, self.count + at + 1, at - begun + 1)
        self.count = int(ranks[-1])
        return pa.array(ranks)

    def left(self):
        return self.count


class _LastSoFar:
    """The last value that is not null of rows that come strictly before in the order, in the same key. A task leaves that of its last key."""

    def __init__(self, kind: pa.DataType):
        self.kind, self.last, self.before_tie = kind, None, None  # the last value of all rows, and of those before the running tie

    def values(self, starts: np.ndarray, ties: np.ndarray, column: pa.Array) -> pa.Array:
        n, at = len(starts), np.arange(len(starts))
        begun = np.maximum.accumulate(np.where(starts, at, -1))
        full = np.maximum.accumulate(np.where(column.is_valid().to_numpy(zero_copy_only=False), at, -1))
        tied = np.maximum.accumulate(np.where(ties, at, -1))
        # places in [value before the running tie, last value, the batch]; -1 is none
        def last_at(i: np.ndarray) -> np.ndarray:
            """The place of the last value of rows up to i (from -1), within the key of at."""
            found = np.where(i >= 0, full[np.maximum(i, 0)], -1)
            return np.where(found >= np.maximum(begun, 0), found + 2, np.where(begun >= 0, -1, 1))

        place = np.where(tied >= 0, last_at(tied - 1), 0)
        pool = pa.concat_arrays([pa.array([self.before_tie, self.last], column.type), column])
        out = pc.take(pool, pa.array(np.maximum(place, 0), mask=place < 0))
        end = last_at(np.full(n, n - 1))[-1]
        self.before_tie = out[-1].as_py()
        self.last = pool[int(end)].as_py() if end >= 0 else None
        return out

    def left(self):
        return self.last


def _scan(rows: DataFrame, key: str, order: list[Column], value: Column, tie: Column, scan: type, out: str) -> DataFrame:
    """rows with out, which holds what the scan gives each row within its task, and _carry, what the key's earlier tasks left to it.

    tie is the value by which rows of one order are told; such rows are in one task.
    """
    named = rows.select("*", F.col(key).alias("_key"), tie.alias("_tie"), value.alias("_value"))
    dealt = named.repartitionByRange("_key", *order).sortWithinPartitions("_key", *order)
    fields = {f.name: f.dataType for f in named.schema.fields}
    made = LongType() if scan is _Ranks else fields["_value"]
    columns, key_type = rows.columns, fields["_key"]
    tail = [("_task", IntegerType()), ("_first", BooleanType()), ("_summary", BooleanType()), ("_key", key_type), ("_from", key_type), (out, made)]
    schema = StructType([StructField(f.name, f.dataType) for f in rows.schema.fields] + [StructField(*t) for t in tail])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, state, first, last, last_tie, begun, types = TaskContext.get().partitionId(), None, None, None, None, False, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            state = state or scan(batch.column("_value").type)
            keys, tied = batch.column("_key"), batch.column("_tie")
            fresh = last is None
            starts = _differ(keys, last)
            ties = starts | _differ(tied, last_tie)
            opens = starts.copy()
            opens[0] &= not fresh  # the task's first row may go on with a key of the task before
            if fresh:
                first = keys[0].as_py()
            values = state.values(starts, ties, batch.column("_value"))
            begun_here = np.maximum.accumulate(opens)
            in_first = np.zeros(n, bool) if begun else ~begun_here
            begun = begun or bool(begun_here[-1])
            last, last_tie = keys[-1], tied[-1]
            fixed = [pa.array(np.full(n, task, np.int32)), pa.array(in_first), pa.array(np.zeros(n, bool)), pa.nulls(n, keys.type), pa.nulls(n, keys.type), values]
            types = [*(batch.column(c).type for c in columns), *(x.type for x in fixed)]
            yield pa.record_batch([*(batch.column(c) for c in columns), *fixed], names=names)
        if last is not None:
            told = [None] * len(columns) + [task, None, True, last.as_py(), first, state.left()]
            yield pa.record_batch([pa.array([x], t) for x, t in zip(told, types, strict=True)], names=names)

    held = stored(dealt.mapInArrow(run, schema), "scan")
    ends = held.where("_summary")
    gives = ends.select(F.col("_key").alias("_k"), "_task", F.lit(1).alias("_gives"), F.col(out).alias("_left"))
    takes = ends.select(F.col("_from").alias("_k"), "_task", F.lit(0).alias("_gives"), F.lit(None).cast(made).alias("_left"))
    w = Window.partitionBy("_k").orderBy("_task", "_gives").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as tasks
    carry = F.sum("_left").over(w) if scan is _Ranks else F.last("_left", True).over(w)
    handed = gives.union(takes).withColumn("_carry", carry).where("_gives = 0 and _carry is not null").select("_task", "_carry")
    first_rows = F.when(F.col("_first"), F.col("_task"))  # null for rows that need nothing
    return held.where("not _summary").withColumn("_of_task", first_rows).join(F.broadcast(handed.withColumnRenamed("_task", "_of_task")), "_of_task", "left").select(*columns, out, "_carry")


def ranked(rows: DataFrame, key: str, order: list[Column], out: str = "rank") -> DataFrame:
    """rows with their place (from 1) in their key's order, which must be total. A null key is a key of its own."""
    none = F.lit(None).cast("long")
    made = _scan(rows, key, order, none, none, _Ranks, out)
    return made.withColumn(out, F.col(out) + F.coalesce("_carry", F.lit(0))).drop("_carry")


def with_next(rows: DataFrame, key: str, order: list[Column], value: str, out: str) -> DataFrame:
    """rows with the value of the row that follows in their key's order, which must be total; null for the last.

    Places in the order make the join's keys, of which none is frequent.
    """
    placed = stored(ranked(rows, key, order, "_place"), "ranked")
    after = placed.select(F.col(key).alias("_key"), (F.col("_place") - 1).alias("_before"), F.col(value).alias(out))
    met = placed.join(after, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_place") == F.col("_before")), "left")
    return met.select(*rows.columns, out)


def with_last(rows: DataFrame, key: str, order: str, value: str, out: str, down: bool = False) -> DataFrame:
    """rows with the last value that is not null of the rows strictly before them in their key's order; rows of one place see the same."""
    made = _scan(rows, key, [F.col(order).desc() if down else F.col(order).asc()], F.col(value), F.col(order), _LastSoFar, out)
    return made.withColumn(out, F.coalesce(out, "_carry")).drop("_carry")
