"""Arrow batches of rows that hold whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame


def text_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, with Arrow batches of so many rows in its session, unless the session sets its own: rows hold whole texts.

    The setting is read when a plan is run, so it has to outlive this call; with Spark's default executors exceed 3,000 MB.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's default
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    return df
