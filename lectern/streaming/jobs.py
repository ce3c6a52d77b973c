"""Structured Streaming forms of incremental work: feeds and outcomes; reading states are in reading.py, cards in cards.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream; the checkpoint is its cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def new_entries(entries: DataFrame, delay: str = "30 days") -> DataFrame:
    """Entries (dedupe_key, ts, ...) with each key once within the delay; later repeats meet stored keys in append_new()."""
    return entries.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["dedupe_key"])


def append_new(entries: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends entries whose key is not stored. A batch that is run again finds its keys stored and adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(["dedupe_key"])
        jvm = spark._jvm.org.apache.hadoop.fs.Path(target)
        if jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
            rows = rows.join(spark.read.schema(batch.schema).parquet(target).select("dedupe_key"), "dedupe_key", "left_anti").select(batch.columns)
        rows.write.mode("append").parquet(target)

    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outcome_counts(jobs: DataFrame, delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """Counts of outcomes (ts, outcome) in windows; rows later than the delay are dropped, which the watermark declares."""
    counts = jobs.withWatermark("ts", delay).groupBy(F.window("ts", width), "outcome").count()
    return counts.select(F.col("window.start").alias("start"), "outcome", F.col("count").alias("n"))
