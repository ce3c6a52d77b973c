"""Tables that cut lineage: written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder on a single machine, and on a cluster one of the warehouse.

    A warehouse on a local disk is refused on a cluster: each executor would write to its own.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root
    if sc.master == "local" or sc.master.startswith("local["):
        root = "file://" + tempfile.mkdtemp(prefix="lectern-")
        sc.setCheckpointDir(root)
        return root
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return posixpath.join(warehouse, "lectern-work")


def new_folder(spark: SparkSession, what: str) -> str:
    return posixpath.join(shared_folder(spark), f"{what}-{uuid.uuid4().hex}")


class Stored:
    """Tables of an iteration. keep() writes one and removes those that were written before under its name."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        folder = new_folder(self.spark, name)
        df.write.parquet(folder)
        self.drop(name)
        self.folders[name] = folder
        return self.spark.read.schema(df.schema).parquet(folder)

    def drop(self, *names: str) -> None:
        for name in names:
            if folder := self.folders.pop(name, None):
                remove(folder)


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written and read back; the table stays, since what reads it is lazy."""
    return Stored(df.sparkSession).keep(what, df)


def remove(folder: str) -> None:
    fs, path = pafs.FileSystem.from_uri(folder)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_dir(path)
