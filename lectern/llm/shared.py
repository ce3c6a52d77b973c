"""Shared folder, durable tables and other small helpers of the training-data operators."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.batches import text_batches  # noqa: F401

#: White space of the word pattern [^\x20\x09-\x0D]+.
SPACES = " \t\n\x0b\f\r"
#: Fixed value: separators of the word pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are folded.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of the warehouse, or on one machine a temporary one."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        one_machine = sc.master == "local" or sc.master.startswith("local[")
        root = "file://" + tempfile.mkdtemp(prefix="lectern-") if one_machine else posixpath.join(spark.conf.get("spark.sql.warehouse.dir"), "lectern-work")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


#: Folders that the running scratch() block has made.
_made: list[str] = []


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder; Spark or a task creates it."""
    _made.append(posixpath.join(shared_root(spark), f"{what}-{uuid.uuid4().hex}"))
    return _made[-1]


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Removes the folders that were made in its block when that ends, but those added to the list that it gives.

    For results that are written by then: a DataFrame that still reads a table of the block must not outlive it.
    """
    outer, kept = _made[:], []
    _made.clear()
    try:
        yield kept
    finally:
        for folder in [x for x in _made if x not in kept]:
            remove(folder)
        _made[:] = outer + [x for x in _made if x in kept]


def remove(folder: str) -> None:
    fs, path = pafs.FileSystem.from_uri(folder)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_dir(path)


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: its lineage ends there and outlives lost executors."""
    return stored_at(df, new_folder(df.sparkSession, what))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes that a table may have for a broadcast. They are measured, as JSON, before each.
BROADCAST_BYTES = 48 << 20


def is_small(df: DataFrame) -> bool:
    """Whether a stored table has at most BROADCAST_BYTES bytes."""
    return (df.agg(F.sum(F.length(F.to_json(F.struct("*"))) + 16).alias("n")).first()["n"] or 0) <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is small; if not, Spark joins it by shuffle."""
    return F.broadcast(df) if is_small(df) else df


def fold_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else (lower() would also fold letters outside ASCII)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def letter_words(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the folded text, in order; null and empty texts have none."""
    return F.array_remove(F.split(fold_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def space_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+, in order; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def text_key(text: Column) -> Column:
    """What joins a row's results back to it, besides its id: rows that repeat an id with another text stay apart."""
    return F.struct(F.xxhash64(text).alias("h"), F.coalesce(F.length(text), F.lit(-1)).alias("n"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, also where a filter moved it into a loop."""
    return F.get(F.transform(F.array(value), use), 0)


def crc_fold(doc_id: Column, folds: int = 3) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int")


def each_text(column: pa.Array) -> Iterator[str | None]:
    """The texts of an Arrow column one by one, so a batch of long texts is never held as Python strings."""
    return (x.as_py() for x in column)
