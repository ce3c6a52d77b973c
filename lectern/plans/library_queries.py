"""Queries of lookups, projections, captures, sync states and small rules. What the tables lack is derived from ids, in the same way in the SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import dates, text, urls
from lectern.operators import dedupe, filters, identity, jobs, listing
from lectern.operators.durable import new_folder
from lectern.plans.registry import query
from lectern.sources import feeds, transcripts
from lectern.streaming import jobs as streams


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with contents, tags, sources and errors, which some of them lack."""
    i = F.col("doc_id")
    s = i.cast("string")
    docs = _table(spark, sf_dir)
    at = lambda c: F.timestamp_seconds(c * 60)
    rows = docs.select(
        i.alias("id"), F.when(i % 3 == 0, "RSS_ITEM").otherwise("WEB_PAGE").alias("type"), F.left("text", F.lit(20)).alias("title"), F.concat(F.lit("https://a.org/"), s).alias("source_url"),
        F.when(i % 5 == 0, F.concat(F.lit("https://youtu.be/"), F.left(F.md5(s.cast("binary")), F.lit(11)))).alias("canonical_url"), F.lit(None).cast("string").alias("video_url"), F.when(i % 4 == 0, "S").alias("ai_summary"), F.lit(None).cast("string").alias("ai_summary_status"),
        F.left("text", F.lit(30)).alias("excerpt"), F.col("lang").alias("author"), F.lit("UNREAD").alias("read_state"), F.lit(0.0).alias("reading_progress"), F.lit(False).alias("is_favorite"), F.when(i % 7 == 0, "FAILED").otherwise("READY").alias("ingestion_status"),
        "lang", F.when(i % 2 == 0, at(i)).alias("published_at"), F.lit(None).cast("timestamp").alias("entered_reading_at"), at(i).alias("created_at"), at(i + 1).alias("updated_at"), F.when(i % 6 != 0, F.col("source")).alias("source_id"), F.col("source").alias("source_title"),
        F.lit("https://s.org").alias("site_url"), F.when(i % 3 != 1, "k").alias("content_origin_key"), F.when(i % 3 != 2, "L").alias("content_origin_label"), F.when(i % 7 == 0, "E").alias("error_code"), F.when(i % 7 == 0, "said").alias("error_message"),
    )
    contents = docs.where("doc_id % 8 <> 0").select(i.alias("document_id"), F.concat(F.lit("<p>"), s, F.lit("</p>")).alias("content_html"), F.col("text").alias("plain_text"), F.length("text").alias("word_count"))
    tags = docs.select(i.alias("document_id"), F.explode(F.when(i % 2 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array().cast("array<string>"))).alias("slug")).withColumn("name", F.upper("slug"))
    return listing.with_details(rows, contents, tags)


_FULL = """WITH d AS (SELECT doc_id AS id, doc_id % 8 <> 0 AS has, CASE WHEN doc_id % 8 <> 0 THEN length(text) END::INT AS words, CASE WHEN doc_id % 8 <> 0 THEN md5(text) END AS body, CASE WHEN doc_id % 2 = 0 THEN 'a,b' ELSE '' END AS tags,
  CASE WHEN doc_id % 6 <> 0 THEN source END AS src, CASE WHEN doc_id % 5 = 0 THEN 'youtube' END AS video, strftime(make_timestamp(doc_id * 60000000), '%Y-%m-%dT%H:%M:%S.000Z') AS made, doc_id % 2 = 0 AS dated, doc_id % 3 AS g, doc_id % 7 = 0 AS failed,
  doc_id % 4 = 0 AS summed, left(text, 30) AS excerpt FROM documents) """


@query(_FULL + """SELECT id, tags, words AS word_count, src AS source, made AS created_at, CASE WHEN dated THEN made END AS published_at, CASE WHEN failed THEN NULL WHEN summed THEN 'S' ELSE nullif(regexp_replace(excerpt, '^\\s+|\\s+$', '', 'g'), '') END AS preview FROM d""".replace("\\\\", "\\"))
def document_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing.list_items(_full(spark, sf_dir))
    return rows.select("id", F.array_join(F.transform("tags", lambda t: t["slug"]), ",").alias("tags"), "word_count", F.col("source.id").alias("source"), "created_at", "published_at", "preview")


@query(_FULL + "SELECT id, src AS source, CASE WHEN g = 0 THEN 'L' END AS origin, CASE WHEN failed THEN 'E: said' END AS error, words AS word_count, body, video FROM d")
def document_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing.detail_items(_full(spark, sf_dir))
    error = F.concat_ws(": ", "error.code", "error.message")
    return rows.select(
        "id", F.col("source.id").alias("source"), F.col("origin.label").alias("origin"), F.when(F.col("error").isNotNull(), error).alias("error"), F.col("content.word_count").alias("word_count"), F.md5(F.col("content.plain_text").cast("binary")).alias("body"),
        F.col("video.provider").alias("video"),
    )


@query(_FULL + "SELECT id, CASE WHEN g <> 2 THEN 'L' END AS origin, CASE WHEN has THEN '<p>' || id || '</p>' END AS html, words AS word_count, video FROM d")
def document_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing.reader_items(_full(spark, sf_dir))
    return rows.select("id", "origin", F.col("content.content_html").alias("html"), F.col("content.word_count").alias("word_count"), F.col("video.provider").alias("video"))


@query("SELECT doc_id AS id, (1000000 - doc_id) AS pos FROM documents WHERE doc_id % 3 = 0")
def documents_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir).select(F.col("doc_id").alias("id"))
    ids = docs.select((F.col("id") * 3).alias("id")).distinct().withColumn("pos", F.lit(1_000_000) - F.col("id"))
    return listing.in_order_of(docs.where("id % 3 = 0"), ids.unionByName(docs.where("id % 3 = 0").select("id", (F.lit(1_000_000) - F.col("id")).alias("pos"))).distinct()).select("id", "pos")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return _table(spark, sf_dir).select(
        i.alias("id"), F.when(i % 4 == 0, "PAUSED").otherwise("ACTIVE").alias("status"), (i % 3 != 0).alias("scheduled"), F.when(i % 5 != 0, i).alias("feed_id"), F.when(i % 7 != 0, F.timestamp_seconds(i * 7919 % 100_003)).alias("last_synced_at"), F.timestamp_seconds(i).alias("created_at"),
    )


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 ORDER BY CASE WHEN doc_id % 7 <> 0 THEN doc_id * 7919 % 100003 END NULLS FIRST, doc_id LIMIT 10")
def due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten sources that a scheduled run syncs, which is the feature's limit."""
    return listing.due_sources(_sources(spark, sf_dir)).select("id")


@query("SELECT doc_id AS id, row_number() OVER (ORDER BY CASE WHEN doc_id % 7 <> 0 THEN doc_id * 7919 % 100003 END DESC NULLS LAST, doc_id DESC) AS place FROM documents")
def source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.operators.scans import ranked

    rows = _sources(spark, sf_dir).withColumn("all", F.lit(0))
    order = [F.col("last_synced_at").desc_nulls_last(), F.col("created_at").desc(), F.col("id").asc()]
    return ranked(rows, "all", order, "place").select("id", "place")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN doc_id - 1 WHEN doc_id % 4 = 1 THEN doc_id END AS existing_id FROM documents WHERE doc_id % 4 <> 3")
def source_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New sources against known ones (every fourth): by feed, else by locator, which another known source may share; a null is no match."""
    i = F.col("doc_id")
    u = lambda kind, c: F.concat(F.lit(f"https://{kind}.org/"), c.cast("string"))
    docs = _table(spark, sf_dir)
    ids = docs.select((i - i % 4).alias("b")).distinct()
    known = ids.select((F.col("b") - 1).alias("id"), u("feed", F.col("b")).alias("feed_url"), u("at", F.col("b") - 9).alias("locator_url"))
    known = known.unionByName(ids.select((F.col("b") + 1).alias("id"), F.lit(None).cast("string").alias("feed_url"), u("at", F.col("b") + 1).alias("locator_url")))
    new = docs.where("doc_id % 4 <> 3").select(i.alias("id"), F.when(i % 4 == 0, u("feed", i)).alias("feed_url"), F.when(i % 4 != 2, u("at", i)).alias("locator_url"))
    return dedupe.register_sources(new, known).select("id", "existing_id")


@query("""WITH p AS (SELECT page_id AS id, page_id % 6 AS f FROM pages)
SELECT id, CASE f WHEN 0 THEN 'dedupe_key' WHEN 1 THEN 'external_id' WHEN 2 THEN 'url' WHEN 3 THEN 'final_key' WHEN 4 THEN 'content_hash' END AS matched_by, CASE WHEN f < 5 THEN id * 10 END AS match_id FROM p""")
def capture_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the lookups of a capture finds a sixth of the pages; a page that an earlier lookup finds has another match at a later one."""
    i = F.col("page_id")
    s = i.cast("string")
    pages = _table(spark, sf_dir, "pages")
    at = lambda k, c: F.when(i % 6 == k, c)
    new = pages.select(
        i.alias("id"), F.concat(F.lit("k"), s).alias("dedupe_key"), F.concat(F.lit("e"), s).alias("external_id"), F.array(F.concat(F.lit("other"), s), F.concat(F.lit("u"), s)).alias("urls"), F.concat(F.lit("f"), s).alias("final_key"), F.concat(F.lit("h"), s).alias("content_hash"),
    )
    first = pages.where("page_id % 6 < 5").select(
        (i * 10).alias("id"), F.coalesce(at(0, F.concat(F.lit("k"), s)), at(3, F.concat(F.lit("f"), s))).alias("dedupe_key"), at(1, F.concat(F.lit("e"), s)).alias("external_id"), F.lit(None).cast("string").alias("source_url"), at(2, F.concat(F.lit("u"), s)).alias("canonical_url"),
        at(4, F.concat(F.lit("h"), s)).alias("content_hash"),
    )
    none = F.lit(None).cast("string")
    later = pages.where("page_id % 6 < 4").select((i * 10 + 1).alias("id"), none.alias("dedupe_key"), none.alias("external_id"), none.alias("source_url"), none.alias("canonical_url"), F.concat(F.lit("h"), s).alias("content_hash"))
    return dedupe.match_captures(new, first.unionByName(later)).select("id", "matched_by", "match_id")


@query("SELECT page_id AS id, CASE WHEN page_id % 4 = 0 THEN 'FAILED' ELSE 'READY' END AS ingestion_status, page_id % 4 <> 0 AS has_text FROM pages WHERE page_id % 3 <> 0")
def capture_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured pages that no stored document matches, unreadable ones as placeholders without a text."""
    i = F.col("page_id")
    none = F.lit(None).cast("string")
    pages = _table(spark, sf_dir, "pages").select(
        i.alias("id"), F.concat(F.lit("k"), i.cast("string")).alias("dedupe_key"), none.alias("external_id"), F.array().cast("array<string>").alias("urls"), none.alias("final_key"), none.alias("content_hash"), F.when(i % 4 == 0, "EXTRACTION_EMPTY").alias("error_code"),
        F.col("html").alias("plain_text"),
    )
    stored = pages.where("id % 3 = 0").select("id", "dedupe_key", "external_id", none.alias("source_url"), none.alias("canonical_url"), "content_hash")
    return dedupe.capture(pages, stored).select("id", "ingestion_status", F.col("plain_text").isNotNull().alias("has_text"))


@query("""WITH d AS (SELECT doc_id AS id, doc_id % 6 AS f, 'B' || (doc_id % 13) AS b, 'N' || (doc_id % 7) AS n FROM documents)
SELECT id, CASE WHEN f IN (0, 1) THEN b END AS biz, CASE f WHEN 1 THEN n WHEN 2 THEN n WHEN 3 THEN n WHEN 4 THEN 'me' END AS nickname, CASE WHEN f IN (0, 1) THEN 'wechat:biz:' || b WHEN f IN (2, 3) THEN 'wechat:nickname:' || n WHEN f = 4 THEN 'wechat:nickname:me' END AS origin_key FROM d""")
def origin_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publications by a URL's parameter, a script's variable, an element, a script's call, or the author; none off the messenger's host."""
    i = F.col("doc_id")
    b, n = F.concat(F.lit("B"), (i % 13).cast("string")), F.concat(F.lit("N"), (i % 7).cast("string"))
    url = F.when(i % 6 == 0, F.concat(F.lit("https://mp.weixin.qq.com/s?__biz="), b, F.lit("&mid=1"))).when(i % 6 == 5, "https://example.com/").otherwise("https://mp.weixin.qq.com/s/x")
    html = F.when(i % 6 == 1, F.concat(F.lit('<a id="js_name"> '), n, F.lit(' </a><script>var biz = "'), b, F.lit('";</script>'))).when(i % 6 == 2, F.concat(F.lit('<b id="js_name">'), n, F.lit("</b>"))).when(i % 6 == 3, F.concat(F.lit("<script>nickname = htmlDecode('"), n, F.lit("')</script>"))).otherwise("<p></p>")
    rows = _table(spark, sf_dir).select(i.alias("id"), url.alias("source_url"), F.lit(None).cast("string").alias("canonical_url"), html.alias("raw_html"), F.when(i % 6 == 4, " me ").alias("author"))
    return identity.origin_metadata(rows).select("id", "biz", "nickname", "origin_key")


@query("SELECT DISTINCT 'b' || (doc_id % 17) AS biz, 'Account ' || left('b' || (doc_id % 17), 6) || '…' AS name FROM documents")
def placeholder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir).select(F.concat(F.lit("b"), (F.col("doc_id") % 17).cast("string")).alias("biz")).distinct().withColumn("name", identity.placeholder_name(F.col("biz")))


@query("""WITH r AS (SELECT user_id % 30 AS feed_id, ts, event_id, event_type AS status, CASE WHEN event_id % 3 = 0 THEN 'T' || event_id END AS title FROM events)
SELECT f.feed_id, epoch_us(max_by(ts, (ts, event_id))) AS last_synced_at, max_by(status, (ts, event_id)) AS status, coalesce(max_by(title, (ts, event_id)) FILTER (title IS NOT NULL), 'old') AS title FROM (SELECT DISTINCT user_id % 30 AS feed_id FROM events) f JOIN r USING (feed_id) GROUP BY 1""")
def feed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds after a log of sync runs: the latest run's state, and the latest title that a run told. Times are made unique by the event's id."""
    events = _table(spark, sf_dir, "events")
    at = F.struct(F.col("ts"), F.col("event_id"))
    runs = events.select((F.col("user_id") % 30).alias("feed_id"), at.alias("finished_at"), F.col("event_type").alias("status"), F.lit(None).cast("string").alias("error"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("T"), F.col("event_id").cast("string"))).alias("title"), F.lit(None).cast("string").alias("site_url"))
    known = runs.select("feed_id").distinct().select("feed_id", F.lit("old").alias("title"), F.lit(None).cast("string").alias("site_url"), F.lit(None).cast("timestamp").alias("last_synced_at"), F.lit("").alias("status"), F.lit("").alias("error"))
    return feeds.sync_state(known, runs).select("feed_id", F.unix_micros(F.col("last_synced_at.ts").cast("timestamp")).alias("last_synced_at"), "status", "title")


@query("""WITH d AS (SELECT doc_id AS id, doc_id % 3 AS f, doc_id % 4 AS g, doc_id % 5 = 0 AS late, left(md5(doc_id::VARCHAR), 11) AS y FROM documents)
SELECT id, CASE WHEN f < 2 THEN 'youtube:' || y END AS video, CASE WHEN late AND g <> 0 THEN 'new' WHEN g = 1 THEN NULL ELSE 'old' END AS segments, CASE WHEN late AND g <> 0 THEN 'READY' WHEN g = 3 THEN 'PENDING' ELSE 'READY' END AS status, late AND g <> 0 AS origin_lost FROM d""")
def refreshed_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of videos after a later capture of every fifth: those with a whole native transcript keep it; machine transcripts are hidden."""
    i = F.col("doc_id")
    y = F.left(F.md5(i.cast("string").cast("binary")), F.lit(11))
    url = F.when(i % 3 == 0, F.concat(F.lit("https://youtu.be/"), y)).when(i % 3 == 1, F.concat(F.lit("https://www.youtube.com/watch?v="), y))
    seg = lambda said: F.array(F.struct(F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.lit(said).alias("text")))
    docs = _table(spark, sf_dir).select(
        i.alias("id"), F.when(i % 3 == 0, url).alias("video_url"), F.when(i % 3 == 1, url).alias("canonical_url"), F.lit("https://example.com").alias("source_url"), F.lit("youtube").alias("video_provider"), F.when(i % 4 == 1, "AI").otherwise("NATIVE").alias("transcript_source"),
        F.when(i % 4 == 3, "PENDING").otherwise("READY").alias("transcript_status"), seg("old").alias("transcript_segments"), F.when(i % 4 != 2, F.col("text")).alias("plain_text"), F.lit("k").alias("content_origin_key"),
    )
    docs = docs.withColumn("video_url", F.when(F.col("id") % 4 == 0, F.coalesce("video_url", F.lit("https://youtu.be/x"))).otherwise(F.coalesce("video_url", F.lit("none"))))
    captured = docs.where("id % 5 = 0").select("id", seg("new").alias("segments"), F.lit("text").alias("text"))
    refreshed = transcripts.refresh_videos(docs, captured)
    source = F.when(F.col("content_origin_key").isNull(), "NATIVE").otherwise(F.col("transcript_source"))
    out = transcripts.video_documents(refreshed.withColumn("transcript_source", source))
    return out.select("id", F.col("video.external_id").alias("video"), F.get("transcript_segments", 0)["text"].alias("segments"), F.col("transcript_status").alias("status"), F.col("content_origin_key").isNull().alias("origin_lost"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'C' || (event_id % 5) WHEN 1 THEN 'CAPTURE_FAILED' WHEN 2 THEN 'CAPTURE_FAILED' END AS code, CASE event_id % 4 WHEN 0 THEN 'inner' WHEN 1 THEN 'outer' WHEN 2 THEN 'outer' END AS message FROM events")
def payload_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    payload = F.when(i % 4 == 0, F.concat(F.lit('{"error": {"code": "C'), (i % 5).cast("string"), F.lit('", "message": "inner"}}'))).when(i % 4 == 1, '{"error": {"code": "half"}}').otherwise("broken {")
    return _table(spark, sf_dir, "events").select("event_id", jobs.payload_error(payload, F.when(i % 4 != 3, "outer")).alias("e")).select("event_id", "e.code", "e.message")


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 9 END AS entered, CASE WHEN doc_id % 3 = 0 THEN 'BEFORE' WHEN doc_id % 5 = 0 THEN 'UNKNOWN' ELSE 'EXACT' END AS kind, CASE doc_id % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'READY' END AS summary FROM documents""")
def backfilled_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    rows = _table(spark, sf_dir).select(
        i.alias("id"), F.when(i % 2 == 0, F.timestamp_seconds(F.lit(5))).alias("entered_reading_at"), F.timestamp_seconds(F.lit(9)).alias("created_at"), F.when(i % 3 == 0, "BEFORE").alias("published_at_kind"), F.when(i % 5 != 0, F.timestamp_seconds(F.lit(1))).alias("published_at"),
        F.when(i % 4 == 0, "PENDING").alias("ai_summary_status"), F.when(i % 4 == 1, " x").when(i % 4 == 2, "  ").alias("ai_summary"),
    )
    return jobs.backfill(rows).select("id", F.unix_seconds("entered_reading_at").cast("int").alias("entered"), F.col("published_at_kind").alias("kind"), F.col("ai_summary_status").alias("summary"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'before 2024-01-02' WHEN 1 THEN '2024-01-02' ELSE CASE WHEN doc_id % 2 = 0 THEN 'imported 2024-03-04' ELSE 'unknown' END END AS label, CASE doc_id % 4 WHEN 0 THEN 1704153600 END::BIGINT AS day,
  CASE doc_id % 3 WHEN 0 THEN 3723.5 WHEN 1 THEN 123.0 END::DOUBLE AS seconds, replace(replace(replace(replace(replace(left(text, 50), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS escaped,
  sha1('f|' || doc_id) AS fallback, regexp_replace('https://a.org/' || CASE WHEN doc_id % 2 = 0 THEN 'x/' ELSE '' END, '/$', '') AS site FROM documents""")
def small_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of dates, days without a time, cue times, HTML escapes, fall-back ids and site URLs, each with usable and unusable input."""
    i = F.col("doc_id")
    day = lambda s: F.lit(s).cast("timestamp")
    label = dates.published_label(F.when(i % 3 < 2, day("2024-01-02 03:04:05")), F.when(i % 3 == 0, "BEFORE").otherwise("EXACT"), F.when(i % 2 == 0, day("2024-03-04 00:00:00")))
    return _table(spark, sf_dir).select(
        "doc_id", label.alias("label"), F.unix_seconds(dates.day(_pick([" 2024-01-02 ", "2024-01-02 03:00", "2024-13-02", None], i % 4))).alias("day"), dates.vtt_seconds(_pick(["01:02:03,500", " 02:03", "soon"], i % 3)).alias("seconds"),
        text.escape_html(F.left("text", F.lit(50))).alias("escaped"), text.fallback_id(F.lit("f"), F.lit(None).cast("string"), i.cast("string")).alias("fallback"), urls.site_url(F.concat(F.lit("https://a.org/"), F.when(i % 2 == 0, "x/").otherwise(""))).alias("site"),
    )


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'Alpha,b' ELSE 'Alpha,b,c ' || (doc_id % 2) END AS cats, doc_id % 4 <> 1 AS meets,
  '<p>one<br />two &amp; ' || doc_id || '</p><p>three</p>' AS html FROM documents""")
def category_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories from text with repeats in other case, their meeting a source's list, and paragraphs of a text."""
    i = F.col("doc_id")
    said = F.concat(F.lit(" Alpha ,b，ALPHA\n\nB"), F.when(i % 3 != 2, F.concat(F.lit(", c  "), (i % 2).cast("string"))).otherwise(""))
    include = F.when(i % 4 == 0, F.array().cast("array<string>")).when(i % 4 == 1, F.array(F.lit("other"))).when(i % 4 == 2, F.array(F.lit("reviews"))).otherwise(F.array(F.lit(" B ")))
    entry = F.when(i % 4 == 2, F.array(F.lit("Review"))).otherwise(text.categories(said))
    body = F.concat(F.lit("\n\n one\ntwo & "), i.cast("string"), F.lit("\n\n\n\nthree\n\n"))
    return _table(spark, sf_dir).select("doc_id", F.array_join(text.categories(said), ",").alias("cats"), text.categories_match(entry, include).alias("meets"), text.paragraph_html(body).alias("html"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'https://mp.weixin.qq.com/s/Ab' || doc_id WHEN 1 THEN 'https://mp.weixin.qq.com/s?__biz=B&mid=' || doc_id || '&idx=1&sn=s' ELSE 'https://mp.weixin.qq.com/s?__biz=B' END AS canonical,
  CASE doc_id % 3 WHEN 0 THEN 'wechat:s:Ab' || doc_id WHEN 1 THEN 'wechat:url:https://mp.weixin.qq.com/s?__biz=B&mid=' || doc_id || '&idx=1&sn=s' ELSE 'wechat:url:https://mp.weixin.qq.com/s?__biz=B' END AS key, doc_id % 5 = 0 AS test,
  CASE doc_id % 6 WHEN 5 THEN NULL WHEN 4 THEN 'https://mp.weixin.qq.com/s/L' || doc_id ELSE 'https://mp.weixin.qq.com/s/T' || doc_id END AS target FROM documents""")
def messenger_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical URLs and keys of the messenger's articles in short, long and other form, test URLs, and the targets of wrapper pages: encoded
    once, twice, in another wrapper, in a script, in a link, or none."""
    i = F.col("doc_id")
    s = i.cast("string")
    c = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    url = F.when(i % 3 == 0, c("https://mp.weixin.qq.com/s/Ab", s, "/?utm_source=x")).when(i % 3 == 1, c("https://mp.weixin.qq.com/s?sn=s&idx=1&mid=", s, "&__biz=B&from=z#top")).otherwise("https://mp.weixin.qq.com/s?__biz=B&utm_x=1")
    wrap = "https://mp.weixin.qq.com/mp/wappoc_appmsgcaptcha?target_url="
    article = c("https://mp.weixin.qq.com/s/T", s)
    once = F.url_encode(article)
    final = F.when(i % 6 == 0, c(wrap, once)).when(i % 6 == 1, c(wrap, F.url_encode(once), "&x=1")).when(i % 6 == 2, c(wrap, F.url_encode(F.url_encode(c(wrap, F.url_encode(once)))))).otherwise("https://mp.weixin.qq.com/mp/wappoc_appmsgcaptcha")
    html = F.when(i % 6 == 3, c("<script>var target_url = '/s/T", s, "';</script>")).when(i % 6 == 4, c('<a href="https://other.org/s/1">x</a><a class="y" href="/s/L', s, '">z</a>')).otherwise('<a href="https://other.org/s/1">x</a>')
    none = F.lit(None).cast("string")
    test = F.when(i % 5 == 0, c("https://a.org/?b=1&qa_x=", s)).otherwise(c("https://a.org/?b=qa_", s))
    return _table(spark, sf_dir).select(
        "doc_id", urls.wechat_canonical(url).alias("canonical"), urls.dedupe_key(F.lit("WEB_PAGE"), url, none, none).alias("key"), urls.is_test_url(test).alias("test"), urls.wechat_target(final, none, html).alias("target"),
    )


@query("""WITH g AS (SELECT sha256(text) AS k, count(*) AS n, list(doc_id ORDER BY doc_id) AS ids FROM documents GROUP BY text HAVING count(*) > 1), t AS (SELECT * FROM g ORDER BY n DESC, k LIMIT 10)
SELECT (SELECT count(*) FROM g) AS conflicts, (SELECT coalesce(sum(n - 1), 0) FROM g)::BIGINT AS extra, (SELECT string_agg(k || ':' || array_to_string(ids[:10], ','), ';' ORDER BY k) FROM t) AS sample""")
def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit's totals, and a sample of ten keys with ten ids each, which is what it shows."""
    rows = _table(spark, sf_dir).select(F.col("doc_id").alias("id"), text.text_hash(F.col("text")).alias("dedupe_key"))
    told = F.array_join(F.transform("sample", lambda x: F.concat(x["key"], F.lit(":"), F.array_join(x["ids"].cast("array<string>"), ","))), ";")
    return dedupe.audit_report(rows).select("conflicts", "extra", F.nullif(told, F.lit("")).alias("sample"))


@query("""WITH m AS (SELECT sha256(text) AS k, doc_id AS id, doc_id % 4 AS h, doc_id % 500 AS c FROM documents) SELECT k AS dedupe_key, min_by(id, (-h, c, id)) AS winner, count(*) AS n FROM m GROUP BY k HAVING count(*) > 1""")
def merge_winners_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners where a summary does not count."""
    i = F.col("doc_id")
    rows = _table(spark, sf_dir).select(i.alias("id"), text.text_hash(F.col("text")).alias("dedupe_key"), (i % 4).alias("highlights"), (i % 2 == 0).alias("has_summary"), (i % 500).alias("created_at"))
    return dedupe.winners(rows, summary=False)


@query("SELECT date_trunc('day', ts)::VARCHAR AS start, event_type AS outcome, count(*) AS n FROM events GROUP BY 1, 2")
def outcome_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes by day as a stream of files, whose windows close as the watermark passes; a last row far ahead closes them all."""
    rows = _table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("outcome"))
    days = rows.agg(F.datediff(F.max("ts"), F.min("ts"))).first()[0] or 0
    folder = new_folder(spark, "outcomes")
    rows.repartition(3).write.parquet(folder)
    ahead = rows.agg((F.max("ts") + F.make_dt_interval(F.lit(2 * days + 9))).alias("ts")).select("ts", F.lit("ahead").alias("outcome"))
    out, checkpoint = new_folder(spark, "outcome-windows"), new_folder(spark, "outcome-checkpoint")
    for part in (None, ahead):
        if part is not None:
            part.write.mode("append").parquet(folder)
        stream = streams.outcome_counts(streams.file_stream(spark, folder, rows.schema), f"{days + 1} days")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema("start timestamp, outcome string, n long").parquet(out).where("outcome <> 'ahead'")
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "outcome", "n")


@query("SELECT doc_id AS id, doc_id % 3 <> 0 AS enabled, doc_id % 2 = 0 OR doc_id % 5 = 0 AS since FROM documents")
def facets_and_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets of a host by a source's own URL or an item's, and entries from a bound on or undated."""
    i = F.col("doc_id")
    own = F.when(i % 3 == 1, "https://Facet.org/x").otherwise("https://other.org/facet.org")
    items = F.when(i % 3 == 2, F.array(F.lit("https://other.org"), F.lit("http://facet.org:80/y"))).otherwise(F.array(F.lit(None).cast("string")))
    rows = _table(spark, sf_dir).select(i.alias("id"), own.alias("own"), items.alias("items"), F.when(i % 5 != 0, F.timestamp_seconds(F.when(i % 2 == 0, 100).otherwise(99))).alias("published_at"))
    return rows.select("id", filters.facet_enabled(F.col("own"), F.col("items"), "facet.org").alias("enabled"), filters.published_since(F.timestamp_seconds(F.lit(100))).alias("since"))
