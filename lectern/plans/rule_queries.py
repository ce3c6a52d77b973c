"""Queries of the rules for single documents: states, cleanups, dates, names, excerpts, tracks, redirects. What the tables lack is derived
from ids, in the same way in the SQL, so that every branch of a rule has rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import dates, text
from lectern.operators import filters, identity, jobs, listing
from lectern.plans.registry import query
from lectern.sources import bookmarks, scripts, transcripts


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def _div(c: Column, n: int) -> Column:
    return F.floor(c / n)


_CODES = [
    "VIDEO_SUBTITLE_UNAVAILABLE", "VIDEO_METADATA_FETCH_FAILED", "VIDEO_FETCH_FAILED", "VIDEO_URL_UNSUPPORTED", "SOURCE_VERIFICATION_REQUIRED",
    "EXTRACTION_EMPTY", "EXTRACTION_UNREADABLE", "OTHER",
]
_MESSAGES = ["公众号迁移", "来源站点返回了异常或壳页面", "unreadable"]


def _states(docs: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    segment = F.struct(F.lit(0.0).alias("start"), F.lit(1.0).alias("end"))
    none = F.lit(None)
    return docs.select(
        i.alias("id"), F.when(i % 4 == 0, "  ").when(i % 4 != 1, F.left("text", F.lit(100))).alias("excerpt"), F.when(i % 9 == 0, "FAILED").when(i % 9 == 1, "PENDING").otherwise("READY").alias("ingestion_status"),
        F.when(i % 5 == 0, F.left("text", F.lit(30))).alias("ai_summary"), _pick([None, "PENDING", "FAILED", "READY"], _div(i, 4) % 4).alias("ai_summary_status"),
        F.when(i % 6 == 0, none).when(i % 6 == 1, " \n").otherwise(F.col("text")).alias("plain_text"), F.when(i % 12 == 0, "<p>x</p>").alias("content_html"), _pick(_CODES, i % 8).alias("code"), _pick(_MESSAGES, _div(i, 8) % 3).alias("message"),
        _pick(["READ", "READING", "UNREAD"], i % 3).alias("read_state"), (i % 2 == 0).alias("is_favorite"), F.when(_div(i, 2) % 5 != 0, "youtube").alias("video_provider"), F.when(_div(i, 3) % 5 != 0, "https://youtu.be/x").alias("video_url"),
        F.when(i % 7 < 5, "NATIVE").when(i % 7 == 5, "AI").alias("transcript_source"), F.when(i % 11 != 0, "READY").alias("transcript_status"), F.when(i % 10 < 8, F.array(segment)).when(i % 10 == 8, F.array().cast("array<struct<start: double, end: double>>")).alias("transcript_segments"),
        F.when(i % 3 == 0, "RSS_ITEM").otherwise("WEB_PAGE").alias("type"), F.timestamp_seconds(i % 500 * 60).alias("created_at"), F.timestamp_seconds(i % 700 * 60).alias("updated_at"),
    )


_STATES = f"""WITH s AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN '  ' WHEN doc_id % 4 <> 1 THEN left(text, 100) END AS excerpt,
  CASE doc_id % 9 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PENDING' ELSE 'READY' END AS status, CASE WHEN doc_id % 5 = 0 THEN left(text, 30) END AS summary, [NULL, 'PENDING', 'FAILED', 'READY'][(doc_id // 4 % 4 + 1)::INT] AS state,
  CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN ' ' || chr(10) ELSE text END AS body, CASE WHEN doc_id % 12 = 0 THEN '<p>x</p>' END AS html, {_CODES}[(doc_id % 8 + 1)::INT] AS code, {_MESSAGES}[(doc_id // 8 % 3 + 1)::INT] AS message,
  ['READ', 'READING', 'UNREAD'][(doc_id % 3 + 1)::INT] AS reading, doc_id % 2 = 0 AS fav, doc_id // 2 % 5 <> 0 AS provided, doc_id // 3 % 5 <> 0 AS linked, doc_id % 7 < 5 AS own, doc_id % 11 <> 0 AS done, doc_id % 10 < 8 AS cut,
  CASE WHEN doc_id % 3 = 0 THEN 'RSS_ITEM' ELSE 'WEB_PAGE' END AS type, doc_id % 500 * 60 AS created, doc_id % 700 * 60 AS updated FROM documents),
t AS (SELECT *, nullif(regexp_replace(excerpt, '^\\s+|\\s+$', '', 'g'), '') AS lead, coalesce(regexp_matches(body, '\\S'), false) OR coalesce(regexp_matches(excerpt, '\\S'), false) AS told FROM s) """


@query(_STATES + """SELECT id, CASE WHEN status = 'FAILED' THEN NULL WHEN lead IS NOT NULL THEN '原文导语' WHEN state = 'PENDING' THEN 'AI 摘要生成中' WHEN state = 'FAILED' THEN 'AI 摘要未就绪' END AS label,
  CASE WHEN status = 'FAILED' THEN NULL WHEN lead IS NOT NULL THEN lead WHEN state = 'PENDING' THEN 'AI 摘要正在生成中。' WHEN state = 'FAILED' THEN 'AI 摘要暂时没有生成出来。' END AS text,
  CASE WHEN status = 'FAILED' OR lead IS NULL THEN NULL WHEN state = 'PENDING' THEN 'AI 摘要正在生成中。' WHEN state = 'FAILED' THEN 'AI 摘要暂时没有生成出来。' END AS note FROM t""")
def document_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(_table(spark, sf_dir)).select("id", filters.lead().alias("l")).select("id", "l.label", "l.text", "l.note")


@query(_STATES + """SELECT id, CASE WHEN fav THEN 'starred' WHEN reading = 'READ' THEN 'archive' ELSE 'queue' END AS reading_view, status = 'READY' AND summary IS NULL AND told AND state IS NULL AS due_first,
  status = 'READY' AND summary IS NULL AND told AND state IS DISTINCT FROM 'PENDING' AS due_again, status = 'READY' AND (coalesce(regexp_matches(body, '\\S'), false) OR html IS NOT NULL) AS can_highlight,
  NOT (provided AND linked AND own AND done AND cut AND coalesce(regexp_matches(body, '\\S'), false)) AS transcript_due,
  CASE WHEN code = 'EXTRACTION_UNREADABLE' AND message = '公众号迁移' THEN 'MIGRATION_NOTICE' WHEN code = 'EXTRACTION_UNREADABLE' AND message LIKE '%壳页面' THEN 'SHARE_SHELL' WHEN code = 'OTHER' THEN 'UNKNOWN' ELSE code END AS failure FROM t""")
def document_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(_table(spark, sf_dir)).select(
        "id", filters.reading_view().alias("reading_view"), filters.summary_due(True).alias("due_first"), filters.summary_due(False).alias("due_again"), filters.highlightable().alias("can_highlight"),
        filters.transcript_due().alias("transcript_due"), filters.failure_class(F.col("code"), F.col("message")).alias("failure"),
    )


@query(_STATES + "SELECT id, told AND state IS DISTINCT FROM 'PENDING' AS queued FROM t WHERE type = 'WEB_PAGE' AND status = 'READY' AND summary IS NULL AND (state IS NULL OR state = 'FAILED') ORDER BY created, id LIMIT 20")
def summary_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.summary_batch(_states(_table(spark, sf_dir)), 20)


@query(_STATES + "SELECT id FROM t WHERE status = 'READY' AND (fav OR summary IS NOT NULL OR id % 21 = 0) ORDER BY updated DESC, id DESC LIMIT 50")
def export_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir)
    marked = docs.where("doc_id % 21 = 0").select(F.col("doc_id").alias("document_id"))
    return listing.export_candidates(_states(docs), marked).select("id")


@query("SELECT count(*) AS total FROM documents WHERE doc_id % 3 <> 0 AND lang = 'en'")
def filtered_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _states(_table(spark, sf_dir)).join(_table(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("lang").alias("source_id")), "id")
    return listing.count_of(rows.withColumn("entered_reading_at", F.col("created_at")), filters.ListQuery(type="WEB_PAGE", source_id="en"))


@query(_STATES + ", o AS (SELECT doc_id AS id, 'wechat:biz:' || source AS origin FROM documents) SELECT id FROM t JOIN o USING (id) WHERE type = 'WEB_PAGE' AND origin = (SELECT min(origin) FROM o) ORDER BY created DESC, id DESC LIMIT 20 OFFSET 20")
def documents_of_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of the first origin's documents."""
    docs = _table(spark, sf_dir)
    assigned = docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("wechat:biz:"), F.col("source")).alias("origin"))
    first = assigned.agg(F.min("origin").alias("o")).first()["o"] or ""
    return listing.page_by_origin(_states(docs), assigned, first, filters.ListQuery(type="WEB_PAGE", page=2)).select("id")


def _messenger(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents of the messenger and of others, their contents, and jobs."""
    i = F.col("doc_id")
    s = i.cast("string")
    none = F.lit(None).cast("string")
    url = F.when(i % 4 == 0, F.concat(F.lit("https://mp.weixin.qq.com/s/"), s)).when(i % 4 == 1, F.concat(F.lit("http://mp.weixin.qq.com/s/"), s)).when(i % 4 == 2, F.concat(F.lit("https://example.com/"), s))
    canonical = F.when(i % 10 == 0, F.concat(F.lit("https://mp.weixin.qq.com/mp/wappoc_appmsgcaptcha?x="), s)).when(i % 10 == 1, F.concat(F.lit("https://mp.weixin.qq.com/s/"), s))
    out = docs.select(
        i.alias("id"), F.left("text", F.lit(20)).alias("title"), F.when(i % 3 == 0, "RSS_ITEM").otherwise("WEB_PAGE").alias("type"), url.alias("source_url"), canonical.alias("canonical_url"),
        F.when(i % 7 == 0, "当前环境异常，完成验证后即可继续访问").otherwise(F.left("text", F.lit(50))).alias("excerpt"), F.when(i % 8 == 0, "FAILED").otherwise("READY").alias("ingestion_status"), F.col("lang"), none.alias("author"),
    )
    body = F.when(i % 11 == 0, F.concat(F.col("text"), F.lit("去验证"))).when(i % 11 < 4, F.concat(F.lit("微信扫一扫 "), F.col("text"))).otherwise(F.col("text"))
    contents = docs.where("doc_id % 5 <> 0").select(i.alias("document_id"), body.alias("plain_text"), F.when(i % 13 == 0, None).when(i % 2 == 0, 12).otherwise(300).alias("word_count"))
    made = docs.select(i.alias("id"), F.when(i % 2 == 0, "FETCH_WEB_PAGE").otherwise("OTHER").alias("kind"), F.when(i % 3 == 1, i).alias("document_id"), url.alias("source_url"), F.lit("DONE").alias("status"), none.alias("error_message"), none.alias("payload_json"), F.lit(None).cast("timestamp").alias("finished_at"))
    return out, contents, made


_MESSENGER = """WITH d AS (SELECT doc_id AS id, left(text, 20) AS title, CASE WHEN doc_id % 3 = 0 THEN 'RSS_ITEM' ELSE 'WEB_PAGE' END AS type,
  CASE doc_id % 4 WHEN 0 THEN 'https://mp.weixin.qq.com/s/' || doc_id WHEN 1 THEN 'http://mp.weixin.qq.com/s/' || doc_id WHEN 2 THEN 'https://example.com/' || doc_id END AS url,
  CASE doc_id % 10 WHEN 0 THEN 'https://mp.weixin.qq.com/mp/wappoc_appmsgcaptcha?x=' || doc_id WHEN 1 THEN 'https://mp.weixin.qq.com/s/' || doc_id END AS canonical,
  CASE WHEN doc_id % 7 = 0 THEN '当前环境异常，完成验证后即可继续访问' ELSE left(text, 50) END AS excerpt, CASE WHEN doc_id % 8 = 0 THEN 'FAILED' ELSE 'READY' END AS status, lang,
  CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN text || '去验证' WHEN doc_id % 11 < 4 THEN '微信扫一扫 ' || text ELSE text END AS body, doc_id % 5 <> 0 AS has,
  CASE WHEN doc_id % 5 = 0 OR doc_id % 13 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 12 ELSE 300 END AS units FROM documents),
v AS (SELECT *, coalesce(canonical, '') LIKE '%/mp/wappoc_appmsgcaptcha%' OR regexp_matches(coalesce(excerpt, ''), '当前环境异常|完成验证后即可继续访问|去验证|环境异常') OR regexp_matches(coalesce(body, ''), '当前环境异常|完成验证后即可继续访问|去验证|环境异常') AS asks FROM d),
bad AS (SELECT * FROM (SELECT *, CASE WHEN asks THEN 'verification' WHEN coalesce(units, 0) <= 30 AND regexp_matches(coalesce(body, ''), '微信扫一扫|使用小程序|向上滑动看下一个|使用完整服务') THEN 'share_shell' END AS reason FROM v
  WHERE type = 'WEB_PAGE' AND status = 'READY' AND has AND (coalesce(url, '') LIKE 'https://mp.weixin.qq.com/%' OR coalesce(canonical, '') LIKE 'https://mp.weixin.qq.com/%')) WHERE reason IS NOT NULL) """


@query(_MESSENGER + "SELECT reason, count(*) AS n FROM bad GROUP BY reason")
def cleanup_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, contents, _ = _messenger(_table(spark, sf_dir))
    return jobs.cleanup_histogram(jobs.unreadable_documents(docs, contents))


@query(_MESSENGER + "SELECT DISTINCT id, url AS source_url FROM v WHERE type = 'WEB_PAGE' AND (coalesce(url, '') LIKE '%mp.weixin.qq.com%' OR coalesce(canonical, '') LIKE '%mp.weixin.qq.com%') AND asks")
def invalid_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, contents, _ = _messenger(_table(spark, sf_dir))
    return jobs.invalid_documents(jobs.with_contents(docs, contents))


@query(_MESSENGER + """SELECT d.id, CASE WHEN b.id IS NULL OR d.url IS NULL THEN d.title ELSE regexp_replace(d.url, '^https?://([^/]+).*$', '\\1') END AS title, CASE WHEN b.id IS NULL THEN d.status ELSE 'FAILED' END AS ingestion_status,
  CASE WHEN b.id IS NULL THEN d.canonical END AS canonical_url, CASE WHEN b.id IS NULL THEN d.excerpt END AS excerpt, CASE WHEN b.id IS NULL THEN d.lang END AS lang, d.has AND b.id IS NULL AS has_content FROM d LEFT JOIN bad b ON d.id = b.id""")
def cleanup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents once those that are not readable are reset, and whether they still have a content."""
    reset, contents, _ = jobs.clean_up(*_messenger(_table(spark, sf_dir)))
    kept = contents.select(F.col("document_id").alias("id"), F.lit(True).alias("c"))
    return reset.join(kept, "id", "left").select("id", "title", "ingestion_status", "canonical_url", "excerpt", "lang", F.coalesce("c", F.lit(False)).alias("has_content"))


@query(_MESSENGER + """, j AS (SELECT id, id % 2 = 0 AS fetched, CASE WHEN id % 3 = 1 THEN id END AS doc, url FROM d),
h AS (SELECT j.id, max(b.reason) AS reason FROM j JOIN bad b ON j.fetched AND (j.doc = b.id OR (b.url IS NOT NULL AND j.url = b.url)) GROUP BY j.id)
SELECT j.id, CASE WHEN reason IS NULL THEN 'DONE' ELSE 'FAILED' END AS status, CASE reason WHEN 'share_shell' THEN '来源站点返回了微信分享壳页面，无法提取可阅读正文。' WHEN 'verification' THEN '来源站点触发验证或环境异常，当前无法稳定抓取正文。' END AS error_message,
  CASE reason WHEN 'share_shell' THEN 'EXTRACTION_UNREADABLE' WHEN 'verification' THEN 'SOURCE_VERIFICATION_REQUIRED' END AS code, reason IS NOT NULL AS finished FROM j LEFT JOIN h USING (id)""")
def cleanup_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = jobs.clean_up(*_messenger(_table(spark, sf_dir)))[2]
    return made.select("id", "status", "error_message", F.get_json_object("payload_json", "$.error.code").alias("code"), F.col("finished_at").isNotNull().alias("finished"))


@query(_MESSENGER + "SELECT count(*) AS failed_documents, 0::BIGINT AS remaining_content_rows FROM bad")
def cleanup_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, contents, made = _messenger(_table(spark, sf_dir))
    reset, kept, _ = jobs.clean_up(docs, contents, made)
    return jobs.cleanup_check(jobs.unreadable_documents(docs, contents), reset, kept)


_FORMS = """WITH p AS (SELECT page_id, page_id % 8 AS f, 2000 + page_id % 50 AS y, 1 + page_id % 12 AS mo, 1 + page_id % 28 AS d, page_id % 24 AS h, page_id % 60 AS mi FROM pages),
t AS (SELECT page_id, f, y, mo, d, h, mi, epoch(make_timestamp(y, mo, d, 0, 0, 0))::BIGINT AS day FROM p) """


@query(_FORMS + "SELECT page_id, CASE f WHEN 0 THEN 1704067200 + page_id * 60 WHEN 1 THEN 1704067200 + page_id * 60 WHEN 2 THEN day - 28800 WHEN 3 THEN day - 28800 + h * 3600 + mi * 60 WHEN 4 THEN day - 28800 WHEN 5 THEN day - 28800 + h * 3600 + mi * 60 + 9 WHEN 6 THEN day + h * 3600 + mi * 60 END::BIGINT AS at FROM t")
def page_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in eight forms, by page: digits of seconds and of milliseconds, ideographs, slashes with a time, dots, hyphens with a time, ISO, and none."""
    i = F.col("page_id")
    y, mo, d, h, mi = 2000 + i % 50, 1 + i % 12, 1 + i % 28, i % 24, i % 60
    at = 1_704_067_200 + i * 60
    said = lambda form, *c: F.format_string(form, *[x.cast("long") for x in c])
    forms = [
        at.cast("string"), (at * 1000).cast("string"), said(" %d年%d月%d日", y, mo, d), said("%d/%d/%d %d:%d", y, mo, d, h, mi), said("%d.%d.%d", y, mo, d), said("%d-%02d-%02d %02d:%02d:09", y, mo, d, h, mi),
        said("%d-%02d-%02dT%02d:%02d:00Z", y, mo, d, h, mi), F.lit("soon"),
    ]
    out = F.coalesce(*[F.when(i % 8 == k, f) for k, f in enumerate(forms)])
    return _table(spark, sf_dir, "pages").select("page_id", F.unix_seconds(dates.page_date(out)).alias("at"))


_BYLINES = """WITH s AS (SELECT doc_id, 'Ann ' || source AS name, doc_id % 11 AS f, left(text, 80) AS l FROM documents) """


@query(_BYLINES + """SELECT doc_id, CASE f WHEN 0 THEN name WHEN 1 THEN name WHEN 2 THEN name WHEN 8 THEN name WHEN 9 THEN 'By ' || name WHEN 10 THEN name END AS author, CASE f WHEN 1 THEN name WHEN 8 THEN name WHEN 9 THEN name END AS byline FROM s""")
def byline_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors from eleven forms of names, by document; marks, @ and closing punctuation go, and what is no name gives none."""
    i = F.col("doc_id")
    name = F.concat(F.lit("Ann "), F.col("source"))
    around = lambda a, b: F.concat(F.lit(a), name, F.lit(b))
    forms = [
        around("原创 作者：", ""), around("By: ", ","), around("@", ""), around("https://x.org/", ""), F.lit("data-author"), around("2024/1/2 ", ""), F.repeat(name, F.lit(9)), F.lit("微信扫一扫"), around("文：", "。"), around("By ", ""),
        around(" \t", " . "),
    ]
    out = F.coalesce(*[F.when(i % 11 == k, f) for k, f in enumerate(forms)])
    return _table(spark, sf_dir).select("doc_id", text.author(out).alias("author"), text.byline_author(out).alias("byline"))


_CARDS = """WITH c AS (SELECT doc_id, nullif(trim(regexp_replace(CASE doc_id % 5 WHEN 0 THEN '作者：someone who writes a long line' WHEN 1 THEN 'https://example.com/a-long-link' WHEN 2 THEN 'short' WHEN 3 THEN left(text, 60) END, '\\s+', ' ', 'g')), '') AS d,
  nullif(trim(regexp_replace(left(text, 300), '\\s+', ' ', 'g')), '') AS b, doc_id % 3 AS f, doc_id % 4 AS g FROM documents),
r AS (SELECT *, CASE WHEN f = 0 THEN left(coalesce(CASE WHEN length(b) >= 20 THEN b END, 'tiny'), 240) WHEN f = 1 THEN 'tiny' WHEN f = 2 THEN 'by: nobody at all in this line' END AS shown FROM c) """


@query(_CARDS + """SELECT doc_id, shown, CASE WHEN doc_id % 5 = 3 AND (shown IS NULL OR (length(d) >= 20 AND NOT regexp_matches(d, '(?i)^(文|作者|来源|by)[:：]') AND NOT regexp_matches(d, '(?i)^https?://\\S+$') AND NOT regexp_matches(d, '^[.。…·_\\-\\s]{4,}$'))) THEN d ELSE trim(shown) END AS excerpt,
  CASE g WHEN 0 THEN 'said ' || doc_id WHEN 1 THEN '[Image highlight] https://example.com/' || doc_id || '.png' ELSE '[Image highlight]' END AS quote FROM r""".replace("\\\\", "\\"))
def card_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts that the blocks of bookmark cards give, the choice between them and descriptions, and texts of highlights."""
    i = F.col("doc_id")
    s = i.cast("string")
    said = F.when(i % 5 == 0, "作者：someone who writes a long line").when(i % 5 == 1, "https://example.com/a-long-link").when(i % 5 == 2, "short").when(i % 5 == 3, F.left("text", F.lit(60)))
    noise = F.lit("by: nobody at all in this line")
    blocks = F.when(i % 3 == 0, F.array(noise, F.lit("tiny"), F.left("text", F.lit(300)))).when(i % 3 == 1, F.array(noise, F.lit(" "), F.lit("tiny"))).otherwise(F.array(F.lit(""), noise, F.lit("....")))
    shown = text.block_excerpt(blocks)
    image = F.when(i % 4 == 1, F.concat(F.lit("https://EXAMPLE.com/"), s, F.lit(".png?utm_source=x"))).when(i % 4 == 2, "not a link")
    quote = bookmarks.quote_text(F.when(i % 4 == 0, F.concat(F.lit(" said  "), s)), image)
    return _table(spark, sf_dir).select("doc_id", shown.alias("shown"), text.bookmark_excerpt(said, shown).alias("excerpt"), quote.alias("quote"))


@query("""WITH s AS (SELECT doc_id, 'a\\x22b\\x26c\\x5cn\\x0d\\x0a\\x3ci\\x3e\\x27\\/' || left(text, 20) || ['\\x5cx22', '\\x5c', '\\n'][(doc_id % 3 + 1)::INT] AS v FROM documents)
SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(v, '\\x5c', '\\'), '\\x0d', chr(13)), '\\x0a', chr(10)), '\\x22', '"'), '\\x26', '&'), '\\x27', chr(39)), '\\x3c', '<'), '\\x3e', '>') AS said FROM s""")
def script_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    end = _pick(["\\x5cx22", "\\x5c", "\\n"], i % 3)
    made = F.concat(F.lit("a\\x22b\\x26c\\x5cn\\x0d\\x0a\\x3ci\\x3e\\x27\\/"), F.left("text", F.lit(20)), end)
    return _table(spark, sf_dir).select("doc_id", text.unescape_js(made).alias("said"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(left(text, 90) || ['/a:b', '?*', ' <x>|\"y\"', '\\'][(doc_id % 4 + 1)::INT], '[\\\\/:*?\"<>|]', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM documents")
def download_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.left("text", F.lit(90)), _pick(["/a:b", "?*", ' <x>|"y"', "\\"], F.col("doc_id") % 4))
    return _table(spark, sf_dir).select("doc_id", text.file_name(title).alias("name"))


_BODY = "nullif(regexp_replace(regexp_replace(replace({0}, chr(13) || chr(10), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g'), '')"
_SUMMARY = f"""WITH s AS (SELECT doc_id, {_BODY.format("CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || chr(10) || chr(10) || text END")} AS c, {_BODY.format("CASE WHEN doc_id % 3 = 1 THEN text END")} AS e, left(text, 30) AS title, source, doc_id % 2 = 0 AS linked, lang FROM documents) """


@query(_SUMMARY + """SELECT doc_id, CASE WHEN c IS NOT NULL THEN 'content' WHEN e IS NOT NULL THEN 'excerpt' ELSE 'metadata' END AS source, sha256(CASE WHEN length(c) > 12000 THEN regexp_replace(left(c, 12000), '\\s+$', '') || chr(10) || chr(10) || '[内容过长，已截断]' WHEN c IS NOT NULL THEN c
  WHEN length(e) > 1500 THEN regexp_replace(left(e, 1500), '\\s+$', '') || chr(10) || chr(10) || '[内容过长，已截断]' WHEN e IS NOT NULL THEN e ELSE """.replace("\\\\", "\\") + _BODY.format("'标题：' || title || chr(10) || '作者：' || lang || chr(10) || '发布时间：2024-01-02T03:04:05.000Z' || CASE WHEN linked THEN chr(10) || '来源链接：https://' || source ELSE '' END") + " END) AS text_hash FROM s")
def summary_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    content, excerpt = F.when(i % 3 == 0, F.concat(F.col("text"), F.lit("\n\n\n"), F.col("text"))), F.when(i % 3 == 1, F.col("text"))
    url = F.when(i % 2 == 0, F.concat(F.lit("https://"), F.col("source")))
    made = text.summary_input(content, excerpt, F.left("text", F.lit(30)), F.col("lang"), F.timestamp_seconds(F.lit(1_704_164_645)), url)
    return _table(spark, sf_dir).select("doc_id", made.alias("m")).select("doc_id", "m.source", text.text_hash(F.col("m.text")).alias("text_hash"))


@query("""WITH t AS (SELECT doc_id // 6 AS video_id, doc_id % 6 AS idx, [NULL, 'zh-Hans', 'en-GB', 'fr', ''][(doc_id * 7 // 3 % 5 + 1)::INT] AS lang, doc_id % 4 = 0 AS asr FROM documents),
s AS (SELECT *, CASE WHEN coalesce(lang, '') = '' THEN 4 WHEN lang LIKE 'zh%' THEN 0 WHEN lang LIKE 'en%' THEN 1 ELSE 2 END + CASE WHEN asr THEN 10 ELSE 0 END AS score FROM t)
SELECT video_id, idx, lang FROM s QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score, idx) = 1""")
def caption_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    lang = _pick([None, "zh-Hans", "en-GB", "fr", ""], _div(i * 7, 3) % 5)
    rows = _table(spark, sf_dir).select(_div(i, 6).alias("video_id"), (i % 6).alias("idx"), lang.alias("lang"), F.when(i % 4 == 0, "asr").alias("kind"), F.lit("u").alias("base_url"))
    return transcripts.best_track(rows).select("video_id", "idx", "lang")


@query("""WITH t AS (SELECT doc_id // 6 AS video_id, doc_id % 6 AS idx, [NULL, 'en-US', 'zh-CN', '', 'ai-zh'][(doc_id * 7 // 3 % 5 + 1)::INT] AS lang, doc_id % 5 = 0 AS locked FROM documents),
s AS (SELECT *, CASE WHEN coalesce(lang, '') = '' THEN 2 WHEN lang LIKE 'zh%' THEN 0 ELSE 1 END AS score FROM t WHERE NOT locked)
SELECT video_id, idx, lang FROM s QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score, idx) = 1""")
def subtitle_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    lang = _pick([None, "en-US", "zh-CN", "", "ai-zh"], _div(i * 7, 3) % 5)
    rows = _table(spark, sf_dir).select(_div(i, 6).alias("video_id"), (i % 6).alias("idx"), lang.alias("lang"), (i % 5 == 0).alias("locked"), F.lit("u").alias("base_url"))
    return transcripts.best_subtitle(rows).select("video_id", "idx", "lang")


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(left(text, 60), '^\s+|\s+$', '', 'g') || '}{"\' AS title, doc_id % 4 AS f, doc_id % 3 AS g FROM documents)
SELECT doc_id, CASE WHEN f < 3 THEN title END AS title, CASE WHEN f = 0 THEN 'me' END AS author, CASE WHEN f < 3 THEN CASE WHEN f = 1 THEN 'up' ELSE '2024-01-02' END END AS published,
  CASE f WHEN 0 THEN 'b' || doc_id WHEN 1 THEN 'm' WHEN 2 THEN 'm' END AS thumbnail, CASE WHEN f = 0 THEN doc_id % 1000 END::INT AS seconds, CASE g WHEN 0 THEN 20 + doc_id WHEN 1 THEN 7 ELSE 10 + doc_id END AS cid FROM d""")
def player_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of players from scripts that hold whole documents, braces and quotes in strings: in both parts, in one, or in a broken one; ids of parts by page number."""
    i = F.col("doc_id")
    s = i.cast("string")
    title = F.concat(F.regexp_replace(F.left("text", F.lit(60)), r"^\s+|\s+$", ""), F.lit('}{"\\'))
    quoted = text.json_string(title)
    details = F.concat(
        F.lit('{"videoDetails": {"title": '), quoted, F.lit(', "author": " me ", "lengthSeconds": "'), (i % 1000).cast("string"), F.lit('", "shortDescription": '), text.json_string(F.col("text")),
        F.lit(', "thumbnail": {"thumbnails": [{"url": "a"}, {"url": "b'), s, F.lit('"}, {"url": " "}]}}, "microformat": {"playerMicroformatRenderer": {"publishDate": "2024-01-02"}}}'),
    )
    micro = lambda key, date: F.concat(F.lit('{"microformat": {"playerMicroformatRenderer": {"title": '), quoted, F.lit(f', "{key}": "{date}", "thumbnail": {{"thumbnails": [{{"url": "m"}}]}}}}}}}}'))
    body = F.coalesce(F.when(i % 4 == 0, details), F.when(i % 4 == 1, micro("uploadDate", "up")), F.when(i % 4 == 2, micro("publishDate", "2024-01-02")), F.concat(F.lit('{"videoDetails": {"title": "'), s))
    html = F.concat(F.lit("<script>var other = {'x': '}'}; var ytInitialPlayerResponse = "), body, F.lit(";var y = {}</script>"))
    state = F.concat(F.lit("<script>window.__INITIAL_STATE__={"), F.when(i % 3 == 1, '"cid": 7, ').otherwise(""), F.lit('"pages": [{"part": "}"}, {"cid": '), (i + 10).cast("string"), F.lit('}, {"cid": '), (i + 20).cast("string"), F.lit("}]};(function(){})</script>"))
    rows = _table(spark, sf_dir).select("doc_id", scripts.embedded_json(html, "ytInitialPlayerResponse").alias("p"), scripts.embedded_json(state, "__INITIAL_STATE__").alias("v"))
    met = rows.select("doc_id", transcripts.player_metadata(F.col("p")).alias("m"), transcripts.video_cid(F.col("v"), F.when(i % 3 == 0, "3").when(i % 3 == 1, "9").otherwise("x")).alias("cid"))
    return met.select("doc_id", "m.title", "m.author", "m.published", "m.thumbnail", "m.seconds", "cid")


def _origins(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    i = F.col("doc_id")
    unknown = identity.UNKNOWN
    url = F.concat(F.when(i % 5 != 0, "https://mp.weixin.qq.com/s/").otherwise("https://example.com/"), i.cast("string"))
    biz = F.concat(F.lit("b"), (i % 17).cast("string"))
    rows = docs.select(
        i.alias("id"), F.when(i % 3 == 0, "RSS_ITEM").otherwise("WEB_PAGE").alias("type"), url.alias("source_url"), F.lit(None).cast("string").alias("canonical_url"), F.timestamp_seconds(i % 97 * 60).alias("created_at"),
        F.when(i % 4 == 0, F.concat(F.lit("wechat:biz:"), biz)).when(i % 4 == 1, "wechat:unknown").when(i % 4 == 2, "wechat:nickname:x").alias("origin_key"),
        F.when(i % 7 < 3, unknown).when(i % 7 < 5, F.concat(F.lit("Label "), biz)).alias("origin_label"), F.when(i % 2 == 0, F.col("lang")).alias("author"),
    )
    metadata = docs.where("doc_id % 6 <> 0").select(i.alias("id"), biz.alias("biz"), F.when(i % 9 == 0, F.concat(F.lit("Name "), biz)).alias("nickname"), F.lit("page author").alias("author"))
    registry = docs.select(biz.alias("biz")).distinct().where("biz <> 'b3'").withColumn("display_name", F.concat(F.lit("Registered "), F.col("biz")))
    return rows, metadata, registry


_ORIGINS = """WITH d AS (SELECT doc_id AS id, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS own, doc_id % 97 AS created, 'b' || (doc_id % 17) AS biz, CASE doc_id % 4 WHEN 0 THEN 'wechat:biz:b' || (doc_id % 17) WHEN 1 THEN 'wechat:unknown' WHEN 2 THEN 'wechat:nickname:x' END AS key,
  CASE WHEN doc_id % 7 < 3 THEN '未识别公众号' WHEN doc_id % 7 < 5 THEN 'Label b' || (doc_id % 17) END AS label, CASE WHEN doc_id % 2 = 0 THEN lang END AS author FROM documents),
c AS (SELECT * FROM d WHERE own AND (key IS NULL OR (label = '未识别公众号' AND key <> 'wechat:unknown'))),
o AS (SELECT * FROM c ORDER BY created, id LIMIT 20),
m AS (SELECT o.*, id % 6 <> 0 AS met, CASE WHEN id % 6 <> 0 AND id % 9 = 0 THEN 'Name ' || biz END AS nick FROM o),
k AS (SELECT *, CASE WHEN met THEN 'wechat:biz:' || biz ELSE coalesce(key, 'wechat:unknown') END AS new FROM m) """


@query(_ORIGINS + """SELECT id, new AS origin_key, coalesce(nick, CASE WHEN key IS NOT DISTINCT FROM new AND label <> '未识别公众号' THEN label END, CASE WHEN met AND biz <> 'b3' THEN 'Registered ' || biz ELSE '未识别公众号' END) AS origin_label, coalesce(author, CASE WHEN met THEN 'page author' END) AS author FROM k""")
def origin_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch of the oldest 20 documents whose origin needs repair."""
    return jobs.origin_repairs(*_origins(_table(spark, sf_dir)))


@query(_ORIGINS + "SELECT (SELECT count(*) FROM c) > 20 AS has_more")
def origin_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.origin_candidates(_origins(_table(spark, sf_dir))[0])[1]


@query("""WITH l AS (SELECT doc_id AS id, 'wechat:biz:b' || (doc_id % 17) AS key, CASE WHEN doc_id % 2 = 0 THEN 'wechat:biz:b' || (doc_id % 17) END AS held, [NULL, ' ', '未识别公众号', ' mine '][(doc_id // 2 % 4 + 1)::INT] AS label, CASE WHEN doc_id % 5 = 0 THEN 'trusted' END AS said FROM documents)
SELECT id, coalesce(said, CASE WHEN held = key AND trim(label) NOT IN ('', '未识别公众号') THEN trim(label) END, 'registered') AS label FROM l""")
def origin_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    key = F.concat(F.lit("wechat:biz:b"), (i % 17).cast("string"))
    label = identity.origin_label(F.when(i % 2 == 0, key), _pick([None, " ", identity.UNKNOWN, " mine "], _div(i, 2) % 4), key, F.lit("registered"), F.when(i % 5 == 0, "trusted"))
    return _table(spark, sf_dir).select(i.alias("id"), label.alias("label"))


@query("SELECT DISTINCT 'b' || (doc_id % 17) AS biz FROM documents WHERE doc_id % 4 = 0")
def publication_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.distinct_publications(_origins(_table(spark, sf_dir))[0])


@query("SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN 'feed' ELSE 'domain' END AS kind, CASE WHEN doc_id % 2 = 0 THEN 'f' || (doc_id % 6) ELSE source || '.org' END AS value FROM documents WHERE doc_id % 5 <> 0")
def alias_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    kind = F.when(i % 5 == 0, "unknown").when(i % 2 == 0, "feed").otherwise("domain")
    return identity.alias_lookups(_table(spark, sf_dir).select(kind.alias("kind"), F.concat(F.lit("f"), (i % 6).cast("string")).alias("feed_id"), F.concat("source", F.lit(".org")).alias("host")))


@query("""WITH n AS (SELECT max(page_id) + 1 AS n FROM pages), p AS (SELECT page_id AS i, page_id // 10 * 10 AS b, n, page_id // 10 % 5 = 4 AND page_id // 10 * 10 + 9 < n AS ring FROM pages, n WHERE page_id % 10 <> 9 OR page_id // 10 % 5 = 4)
SELECT 'u' || i AS url, 'u' || CASE WHEN ring THEN b + (i - b + 9) % 10 ELSE least(b + 9, n) END AS final_url, CASE WHEN ring THEN 9 ELSE least(b + 9, n) - i END::INT AS hops FROM p""")
def redirect_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of ten pages, each of which leads to the next; every fifth chain closes to a ring."""
    i = F.col("page_id")
    ring = _div(i, 10) % 5 == 4
    to = F.when(i % 10 != 9, i + 1).when(ring, i - 9)
    named = lambda c: F.concat(F.lit("u"), c.cast("string"))
    return identity.follow_redirects(_table(spark, sf_dir, "pages").select(named(i).alias("url"), named(to).alias("target_url")))
