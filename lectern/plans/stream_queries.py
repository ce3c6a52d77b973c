"""Queries that replay the given tables as streams: written to files in the shared folder, read back as a stream, folded to the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.durable import new_folder
from lectern.plans.event_queries import READING_SQL, reading_events
from lectern.plans.registry import query
from lectern.streaming import cards, reading
from lectern.streaming.jobs import file_stream


@query(READING_SQL)
def reading_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reading_state over its events as files, a batch each, with the states in RocksDB; files come in any order, so the delay spans them all."""
    rows = reading_events(spark, sf_dir)
    files = new_folder(spark, "events")
    rows.repartitionByRange(4, "ts").write.parquet(files)
    days = rows.agg(F.datediff(F.max("ts"), F.min("ts"))).first()[0] or 0
    out = new_folder(spark, "reading-states")
    stream = file_stream(spark, files, rows.schema, 1)
    reading.fold_reading_states(stream, out, new_folder(spark, "reading-checkpoint"), f"{days + 1} days").awaitTermination()
    return reading.current_states(spark, out).withColumn("progress", F.round("progress", 6))


@query("""WITH c AS (SELECT lang, doc_id FROM documents WHERE doc_id IS NOT NULL)
SELECT lang, count(*) AS cards, count(DISTINCT doc_id) AS ids, max(doc_id // 3 * 60000000) AS latest FROM c GROUP BY lang""")
def card_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cards of a service, of which three share an update time; two thirds are there at the first run, the rest at the second."""
    i = F.col("doc_id")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null")
    made = rows.select(F.lpad(i.cast("string"), 20, "0").alias("id"), (F.floor(i / 3) * 60_000_000).alias("update_time"), i.alias("doc_id"), "lang", F.left("text", F.lit(40)).alias("title"))
    half = rows.agg(F.expr("floor(max(doc_id) * 2 / 9) * 180000000")).first()[0] or 0
    folder, target, checkpoint = (new_folder(spark, x) for x in ("cards", "imported-cards", "card-checkpoint"))
    for part in (F.col("update_time") < half, F.col("update_time") >= half):
        cards.write_replay(made.where(part), folder)
        cards.import_cards(spark, cards.ReplayedCards(folder), made.schema, target, checkpoint).awaitTermination()
    got = spark.read.parquet(target)
    return got.groupBy("lang").agg(F.count("*").alias("cards"), F.countDistinct("doc_id").alias("ids"), F.max("update_time").alias("latest"))
