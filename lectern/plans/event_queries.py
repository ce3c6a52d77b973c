"""Queries over events and conversations, which stand for job logs, reading events and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import highlights, identity, jobs
from lectern.operators.filters import recent
from lectern.plans.registry import query
from lectern.sources import transcripts


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""
WITH g AS (SELECT user_id, count(*) AS n, max(ts) AS latest FROM events WHERE event_type = 'purchase' GROUP BY user_id), m AS (SELECT max(ts) AS now FROM events)
SELECT 'source:' || user_id AS identity, n, epoch_us(latest) AS latest FROM g, m WHERE latest > now - INTERVAL 7 DAY
""")
def recent_sources_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as sources: those with a purchase in the last 7 days."""
    events = _events(spark, sf_dir)
    now = events.agg(F.max("ts")).first()[0]
    rows = events.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.concat(F.lit("source:"), F.col("user_id").cast("string")).alias("identity"), F.lit("").alias("label"), F.lit("source").alias("kind"), F.lit("").alias("host"), F.col("ts").alias("created_at"))
    return identity.source_groups(rows, F.lit(now)).select("identity", "n", F.unix_micros("latest").alias("latest"))


@query("""
WITH a AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'), d AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase'),
j AS (SELECT d.event_id, min(a.ts) AS bound FROM d JOIN a ON a.user_id = d.user_id AND a.ts > d.ts GROUP BY d.event_id)
SELECT event_id, epoch_us(bound) AS bound, 'BEFORE' AS kind FROM j
""")
def published_upper_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as hosts and purchases as dated pages: the next purchase bounds each other event."""
    at = F.unix_micros("ts")
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("user_id").alias("host"), at.alias("captured"), F.when(F.col("event_type") == "purchase", at).alias("published"))
    return jobs.upper_bounds(rows).select(F.col("id").alias("event_id"), "bound", "kind")


@query("""
WITH e AS (SELECT event_id AS id, ts, CASE WHEN event_id % 3 = 0 THEN 'example.com' ELSE 'h' || (user_id % 20) || '.org' END AS host, event_type = 'purchase' AS dated, event_id % 7 = 0 AS failed, event_id % 4 <> 0 AS page FROM events WHERE event_id % 11 <> 0),
d AS (SELECT host, ts FROM e WHERE dated AND page),
j AS (SELECT e.id, min(d.ts) AS bound FROM e JOIN d ON d.host = e.host AND d.ts > e.ts WHERE NOT e.dated AND NOT e.failed GROUP BY e.id)
SELECT id, epoch_us(bound) AS bound, 'BEFORE' AS kind FROM j
""")
def host_upper_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as documents of hosts, one of which has a third of them, by source or canonical URL; feeds give no bound and failed ones get none."""
    i = F.col("event_id")
    host = F.when(i % 3 == 0, "Example.com").otherwise(F.concat(F.lit("h"), (F.col("user_id") % 20).cast("string"), F.lit(".org")))
    url = F.concat(F.when(i % 2 == 0, "http://").otherwise("https://"), host, F.when(i % 5 == 0, "").otherwise("/p?x"))
    none = F.lit(None).cast("string")
    at = F.unix_micros("ts")
    rows = _events(spark, sf_dir).select(
        i.alias("id"), F.when((i % 11 != 0) & (i % 13 != 0), url).alias("source_url"), F.when(i % 11 != 0, url).otherwise(none).alias("canonical_url"), at.alias("captured"),
        F.when(F.col("event_type") == "purchase", at).alias("published"), F.when(i % 7 == 0, "FAILED").otherwise("READY").alias("ingestion_status"), F.when(i % 4 == 0, "FEED").when(i % 4 == 1, "VIDEO").otherwise("PAGE").alias("capture_kind"),
    )
    return jobs.host_bounds(rows)


@query("""
WITH f AS (SELECT event_id, user_id, event_id % 50 AS u, ts, CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts END AS fin FROM events WHERE event_type = 'error'),
d AS (SELECT DISTINCT user_id AS id, user_id % 50 AS u FROM events),
m AS (SELECT d.id, f.* EXCLUDE (user_id, u) FROM d JOIN f ON f.user_id = d.id UNION SELECT d.id, f.* EXCLUDE (user_id, u) FROM d JOIN f ON f.u = d.u)
SELECT id, event_id AS job_id FROM (SELECT id, event_id, row_number() OVER (PARTITION BY id ORDER BY fin DESC NULLS FIRST, ts DESC, event_id DESC) AS r FROM m) WHERE r = 1
""")
def latest_failed_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as documents and error events as failed jobs, matched by user or by a URL that several users share."""
    events = _events(spark, sf_dir)
    url = lambda c: F.concat(F.lit("u"), (F.col(c) % 50).cast("string"))
    docs = events.select(F.col("user_id").alias("id"), url("user_id").alias("source_url")).distinct()
    log = events.where("event_type = 'error'").select(F.col("event_id").alias("id"), F.lit("FAILED").alias("status"), F.col("user_id").alias("document_id"), url("event_id").alias("source_url"), F.when(F.col("event_id") % 9 != 0, F.col("ts")).alias("finished_at"), F.col("ts").alias("created_at"))
    return jobs.latest_failures(docs, log)


_OUTCOME = "CASE event_type WHEN 'purchase' THEN 'generated' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'deferred' END"


@query(f"SELECT count(*) FILTER (o = 'generated') AS generated, count(*) FILTER (o = 'failed') AS failed, count(*) FILTER (o = 'skipped') AS skipped, count(*) FILTER (o = 'deferred') AS deferred FROM (SELECT {_OUTCOME} AS o FROM events)")
def job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.outcomes(_events(spark, sf_dir).select(F.expr(_OUTCOME).alias("outcome")))


@query("SELECT count(*) AS pending FROM events WHERE event_type = 'click'")
def queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.queue_depth(_events(spark, sf_dir).select(F.when(F.col("event_type") == "click", "PENDING").alias("ai_summary_status")))


READING_SQL = """
WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN 'read' WHEN event_id % 3 = 0 THEN 'open' ELSE 'progress' END AS kind, value - 5 AS p FROM events WHERE event_type <> 'error' OR user_id % 4 = 0),
g AS (SELECT user_id AS document_id, min(ts) FILTER (kind = 'open') AS entered, arg_max(least(greatest(p, 0), 100), (ts, event_id)) FILTER (kind = 'progress') AS p, bool_or(kind = 'read') AS read FROM e GROUP BY user_id)
SELECT document_id, epoch_us(entered) AS entered_at, round(CASE WHEN read THEN 100 ELSE coalesce(p, 0) END, 6) AS progress, CASE WHEN read THEN 'READ' WHEN p > 0 AND p < 100 THEN 'READING' ELSE 'UNREAD' END AS read_state FROM g
"""


def reading_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as documents: events open them, move their progress, and errors mark every fourth one read."""
    kind = F.when(F.col("event_type") == "error", "read").when(F.col("event_id") % 3 == 0, "open").otherwise("progress")
    rows = _events(spark, sf_dir).where("event_type <> 'error' or user_id % 4 = 0")
    return rows.select("event_id", F.col("user_id").alias("document_id"), "ts", kind.alias("kind"), (F.col("value") - 5).alias("progress"))


@query(READING_SQL)
def reading_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.reading_states(reading_events(spark, sf_dir)).withColumns({"entered_at": F.unix_micros("entered_at"), "progress": F.round("progress", 6)})


@query("SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n, count(DISTINCT user_id) AS documents FROM events WHERE event_type = 'click' GROUP BY 1")
def highlights_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).where("event_type = 'click'").select(F.col("user_id").alias("document_id"), F.col("ts").alias("created_at"))
    return highlights.by_day(rows).withColumn("day", F.col("day").cast("string"))


@query("SELECT count(*) AS highlights, count(DISTINCT user_id) AS documents FROM events WHERE event_type = 'click'")
def highlight_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return highlights.overview(_events(spark, sf_dir).where("event_type = 'click'").select(F.col("user_id").alias("document_id")))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as segments: 10 s apart, as long as a 20th of their text."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    start = F.col("turn") * 10.0
    return rows.select(F.col("conv_id").alias("video_id"), start.alias("start"), (start + F.length("text") / 20).alias("end"), "text")


_SEG = "SELECT conv_id AS video_id, turn * 10.0::DOUBLE AS s, turn * 10.0::DOUBLE + length(text) / 20.0::DOUBLE AS e, nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') AS t FROM conversations"
_LINE = f"SELECT video_id, s AS \"start\", CASE WHEN nx > s AND e > nx THEN nx ELSE e END AS \"end\", t AS text FROM (SELECT *, lead(s) OVER (PARTITION BY video_id ORDER BY s, e, t) AS nx FROM ({_SEG}) WHERE e > s AND t IS NOT NULL)"


@query(f'SELECT video_id, round("start", 3) AS "start", round("end", 3) AS "end", md5(text) AS text FROM ({_LINE}) WHERE "end" > "start"')
def transcript_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.timeline(_turns(spark, sf_dir)).select("video_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.md5(F.col("text").cast("binary")).alias("text"))


@query(f"""
WITH l AS (SELECT * FROM ({_LINE}) WHERE "end" > "start"), q AS (SELECT DISTINCT conv_id AS video_id, turn * 7.0::DOUBLE AS tm FROM conversations),
m AS (SELECT video_id, max("end") AS last FROM l GROUP BY video_id),
j AS (SELECT q.video_id, q.tm, l."start" AS s, l."end" AS e, m.last FROM q LEFT JOIN m USING (video_id) ASOF LEFT JOIN l ON q.video_id = l.video_id AND q.tm >= l."start")
SELECT video_id, tm AS "at", CASE WHEN tm < e OR tm >= last THEN round(s, 3) END AS "start" FROM j
""")
def active_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transcripts.timeline(_turns(spark, sf_dir))
    times = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("video_id"), (F.col("turn") * 7.0).alias("at")).distinct()
    return transcripts.active_segments(times, rows).select("video_id", "at", F.round("start", 3).alias("start"))


@query(f"SELECT video_id, sha256(string_agg(t, chr(10) ORDER BY s, e, t)) AS text_hash FROM ({_SEG}) WHERE e > s AND t IS NOT NULL GROUP BY video_id")
def transcript_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.functions.text import collapse

    rows = _turns(spark, sf_dir).withColumn("text", collapse(F.col("text"))).where("end > start and text is not null")
    return transcripts.transcript_text(rows).select("video_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"))


@query("""
SELECT kind, value, name FROM (SELECT 'domain' AS kind, 'v' || (user_id % 40) AS value, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS name, row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND name IS NOT NULL
""")
def alias_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of aliases, the latest of each value; errors delete."""
    seq = F.struct("ts", "event_id")
    rows = _events(spark, sf_dir).select(F.lit("domain").alias("kind"), F.concat(F.lit("v"), (F.col("user_id") % 40).cast("string")).alias("value"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("name"), seq.alias("seq"))
    return jobs.aliases(rows)


@query("""
WITH c AS (SELECT 'b' || (user_id % 60) AS biz, CASE WHEN event_type IN ('click', 'view') THEN 'Account b' || '…' ELSE event_type || '-' || (event_id % 5) END AS name, event_id FROM events)
SELECT biz, coalesce(max_by(name, event_id) FILTER (name NOT LIKE '%…'), max_by(name, event_id)) AS display_name FROM c GROUP BY biz
""")
def registry_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest name of each account; placeholders never overwrite a name."""
    name = F.when(F.col("event_type").isin("click", "view"), F.lit("Account b…")).otherwise(F.concat_ws("-", "event_type", (F.col("event_id") % 5).cast("string")))
    return identity.register_names(_events(spark, sf_dir).select(F.concat(F.lit("b"), (F.col("user_id") % 60).cast("string")).alias("biz"), name.alias("display_name"), F.col("event_id").alias("seq")))


@query("SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS next_id FROM events")
def next_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.operators.listing import next_documents

    rows = _events(spark, sf_dir).withColumnRenamed("event_id", "id")
    return next_documents(rows, "user_id", [F.col("ts").desc(), F.col("id").desc()]).select(F.col("id").alias("event_id"), "next_id")
