"""Queries of bookmark cards over documents: rendering Markdown, cards as documents, their merge into a library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.markdown import rendered
from lectern.operators.durable import stored
from lectern.plans.registry import query
from lectern.sources import bookmarks


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_SEPS = [".\n- ", ".\n\n> ", ".\n  - ", ".\n\n## ", ".\r\n\r\n- ", ". "]
_SEPS_SQL = "[" + ", ".join("'" + s.replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '") + "'" for s in _SEPS) + "]"
_WS = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;')"
_LINK_SQL = "'\\[([^\\]]+)\\]\\((https?://(?:[^\\s()]|\\([^)\\s]*\\))+)\\)'"
_HTML_SQL = (
    "regexp_replace(regexp_replace(regexp_replace(" + _ESC + ", " + _LINK_SQL + ", '<a href=\"\\2\" target=\"_blank\" rel=\"noreferrer\">\\1</a>', 'g'), "
    "'\\*\\*([^*]+)\\*\\*', '<strong>\\1</strong>', 'g'), '(^|[^*])\\*([^*]+)\\*', '\\1<em>\\2</em>', 'g')"
)
_TEXT_SQL = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, " + _LINK_SQL + ", '\\1', 'g'), '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '(^|[^*])\\*([^*]+)\\*', '\\1\\2', 'g'), '\\s+', ' ', 'g'))"
)


@query(f"""
WITH m AS (SELECT doc_id, {_WS.format("replace(CASE WHEN doc_id % 4 = 0 THEN '# Head [l](https://e.org/' || doc_id || ')' || chr(10) ELSE '' END || replace(text, '. ', " + _SEPS_SQL + "[(doc_id % 6 + 1)::INT]), chr(13) || chr(10), chr(10))")} AS md FROM documents),
l AS (SELECT doc_id, unnest(string_split(md, chr(10))) AS raw, unnest(range(len(string_split(md, chr(10))))) AS k FROM m WHERE md <> ''),
x AS (SELECT doc_id, k, {_WS.format("raw")} AS t, regexp_replace(raw, '\\s+$', '') AS r FROM l),
g AS (SELECT *, count(*) FILTER (t = '') OVER (PARTITION BY doc_id ORDER BY k) AS grp FROM x),
u AS (SELECT *, CASE WHEN regexp_matches(r, '^#{{1,6}}\\s+') THEN 'h' WHEN regexp_matches(r, '^[-*]\\s+') THEN 'ul' WHEN r LIKE '>%' THEN 'quote' END AS ku,
  CASE WHEN regexp_matches(t, '^[-*]\\s+') THEN 'ul' WHEN t LIKE '>%' THEN 'quote' END AS kt FROM g WHERE t <> ''),
b AS (SELECT *, ku IS NULL AND NOT coalesce(kt = lag(kt) OVER (PARTITION BY doc_id, grp ORDER BY k), false) AS bad FROM u),
f AS (SELECT *, min(k) FILTER (bad) OVER (PARTITION BY doc_id, grp) AS first_bad FROM b),
n AS (SELECT *, CASE WHEN k >= first_bad THEN 'p' ELSE coalesce(ku, kt) END AS kind FROM f),
s AS (SELECT *, kind = 'h' OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id, grp ORDER BY k) AS starts FROM n),
p AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id, grp ORDER BY k) AS blk, length(regexp_extract(r, '^#+')) AS depth,
  CASE kind WHEN 'h' THEN {_WS.format("substr(r, length(regexp_extract(r, '^#+')) + 1)")} WHEN 'ul' THEN regexp_replace(t, '^[-*]\\s+', '') WHEN 'quote' THEN regexp_replace(t, '^>\\s?', '') ELSE t END AS part FROM s),
o AS (SELECT doc_id, grp, blk, min(kind) AS kind, min(depth) AS depth, list(part ORDER BY k) AS parts FROM p GROUP BY doc_id, grp, blk),
w AS (SELECT doc_id, grp, blk, CASE kind WHEN 'ul' THEN '<ul>' || array_to_string(list_transform(parts, lambda y: '<li>' || {_HTML_SQL.format("y")} || '</li>'), '') || '</ul>'
    WHEN 'quote' THEN '<blockquote><p>' || {_HTML_SQL.format("array_to_string(parts, ' ')")} || '</p></blockquote>' WHEN 'h' THEN '<h' || depth || '>' || {_HTML_SQL.format("parts[1]")} || '</h' || depth || '>'
    ELSE '<p>' || {_HTML_SQL.format("array_to_string(parts, ' ')")} || '</p>' END AS html,
  CASE kind WHEN 'ul' THEN array_to_string(list_filter(list_transform(parts, lambda y: {_TEXT_SQL.format("y")}), lambda y: y <> ''), chr(10)) ELSE {_TEXT_SQL.format("array_to_string(parts, ' ')")} END AS txt FROM o)
SELECT m.doc_id, any_value(CASE WHEN md = '' THEN NULL ELSE 1 END) IS NOT NULL AS told, md5(string_agg(html, '' ORDER BY grp, blk)) AS html, md5(coalesce(string_agg(txt, chr(10) || chr(10) ORDER BY grp, blk) FILTER (txt <> ''), CASE WHEN any_value(md) <> '' THEN '' END)) AS txt
FROM m LEFT JOIN w USING (doc_id) GROUP BY m.doc_id
""")
def card_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as Markdown, by document with list items, quotes, indented items, headings or CRLF after its sentences, rendered to HTML and text."""
    i = F.col("doc_id")
    sep = F.get(F.array(*map(F.lit, _SEPS)), (i % 6).cast("int"))
    head = F.when(i % 4 == 0, F.concat(F.lit("# Head [l](https://e.org/"), i.cast("string"), F.lit(")\n"))).otherwise("")
    rows = _docs(spark, sf_dir).select("doc_id", rendered(F.concat(head, F.replace("text", F.lit(". "), sep))).alias("r"))
    md5 = lambda c: F.md5(F.col(c).cast("binary"))
    return rows.select("doc_id", F.col("r").isNotNull().alias("told"), md5("r.content_html").alias("html"), md5("r.plain_text").alias("txt"))


def _cards(docs: DataFrame) -> DataFrame:
    """A card of each document: titles, descriptions, URLs, texts and word counts that are there or not, by the id."""
    i = F.col("doc_id")
    s = i.cast("string")
    page = F.concat(F.lit("# H"), s, F.lit("\n- one\n  - **two**\n\nA paragraph with enough\nwords, number "), s)
    url = F.when(i % 5 < 3, F.concat(F.lit(" https://example.com/p/"), s, F.lit("#top"))).when(i % 5 == 3, F.concat(F.lit("https://mp.weixin.qq.com/s/Ab"), s))
    mark = lambda k, text: F.struct(F.lit(k).alias("id"), text.alias("text"), F.lit(None).cast("string").alias("image_url"), F.lit(" n ").alias("note"), F.lit(None).cast("string").alias("color"), F.lit("2024-01-02T03:04:05Z").alias("create_time"))
    return docs.select(
        F.concat(F.lit("c"), s).alias("id"), F.when(i % 3 == 0, F.when(i % 2 == 0, F.concat(F.lit("T"), s))).alias("title"), F.when(i % 3 != 0, F.left("text", F.lit(30))).alias("article_title"),
        F.when(i % 4 != 0, F.concat(F.lit("said at some length "), s)).alias("description"), url.alias("url"), F.lit("2024-01-01T00:00:00Z").alias("create_time"), F.lit("x").alias("update_time"), F.when(i % 9 == 0, 7).alias("word_count"),
        F.array(F.concat(F.lit("T"), (i % 3).cast("string")), F.lit(" u "), F.lit("u")).alias("tags"), F.array(mark("h1", F.concat(F.lit("q "), s)), mark("h2", F.lit(" "))).alias("highlights"), F.when(i % 6 != 0, page).alias("markdown"),
    )


def _library(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Cards' documents, and a library of those with even ids, which differ by id in one thing: title, excerpt, canonical URL, text, tags or highlights."""
    docs = _docs(spark, sf_dir)
    cards = _cards(docs)
    directory = spark.createDataFrame([("t0",), ("t1",)], "name string")
    made = bookmarks.cards_to_documents(cards, F.timestamp_seconds(F.lit(1_704_067_200)))
    new = made.join(bookmarks.tag_names(cards, directory).select(F.col("id").alias("external_id"), F.col("names").alias("tag_names")), "external_id", "left")
    new = stored(new, "cards")  # the library is made of them, so they are rendered once
    i = F.substr("external_id", F.lit(2)).cast("long")
    kind = F.col("id") % 7
    old = new.withColumn("id", i).where("id % 2 = 0")
    documents = old.select(
        "id", F.when(F.col("id") % 10 != 2, F.col("external_id")).alias("external_id"), "type", "dedupe_key", F.when(kind == 1, "old").otherwise(F.col("title")).alias("title"), "source_url", F.when(kind == 2, None).otherwise(F.col("excerpt")).alias("excerpt"),
        F.when(kind == 3, F.concat(F.lit("https://kept.org/"), F.col("id").cast("string"))).otherwise(F.col("canonical_url")).alias("canonical_url"), "author", "content_origin_key", "content_origin_label", "ingestion_status", "published_at",
        "published_at_kind", "created_at", "updated_at", F.lit("S").alias("ai_summary"), F.lit("READY").alias("ai_summary_status"), F.lit("READ").alias("read_state"), F.lit(True).alias("is_favorite"),
    )
    contents = old.where((F.col("plain_text").isNotNull()) | (kind == 4)).select(F.col("id").alias("document_id"), "content_html", F.when(kind == 4, "x").otherwise(F.col("plain_text")).alias("plain_text"), "text_hash", "word_count")
    tags = old.select(F.col("id").alias("document_id"), F.explode(F.when(kind == 5, F.array(F.lit("u"), F.lit("gone"))).otherwise(F.col("tag_names"))).alias("name"))
    marks = bookmarks.card_highlights(old).select(F.substr("external_id", F.lit(2)).cast("long").alias("document_id"), F.col("id").alias("external_id"), "quote_text", "note", "color", "created_at")
    odd = F.col("document_id") % 7 == 6
    marks = marks.where(~odd | (F.col("external_id") == "h1")).withColumn("note", F.when(odd, "other").otherwise(F.col("note")))
    own = old.where(kind == 6).select(F.col("id").alias("document_id"), F.lit(None).cast("string").alias("external_id"), F.lit("by hand").alias("quote_text"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("string").alias("color"), "created_at")
    return new, documents, contents, tags, marks.unionByName(own)


_CARD = r"""WITH c AS (SELECT doc_id AS id, doc_id % 2 = 0 AS old, doc_id % 7 AS kind, doc_id % 6 <> 0 AS told, CASE WHEN doc_id % 5 < 3 THEN 'https://example.com/p/' || doc_id WHEN doc_id % 5 = 3 THEN 'https://mp.weixin.qq.com/s/Ab' || doc_id END AS url,
  CASE WHEN doc_id % 4 <> 0 THEN 'said at some length ' || doc_id WHEN doc_id % 6 <> 0 THEN 'A paragraph with enough words, number ' || doc_id END AS excerpt, nullif(trim(regexp_replace(left(text, 30), '\s+', ' ', 'g')), '') AS head FROM documents),
t AS (SELECT *, CASE WHEN id % 3 <> 0 THEN head WHEN id % 2 = 0 THEN 'T' || id END AS named FROM c),
s AS (SELECT *, coalesce(named, CASE WHEN told THEN 'H' || id END, excerpt, 'Untitled import') AS title, CASE WHEN url LIKE '%weixin%' THEN 'wechat:s:Ab' || id WHEN url IS NOT NULL THEN 'web:url:' || url END AS key,
  CASE WHEN named IS NOT NULL OR excerpt IS NOT NULL OR told THEN 'READY' ELSE 'FAILED' END AS ready FROM t),
d AS (SELECT *, old AND (kind = 1 OR kind = 2 AND excerpt IS NOT NULL) AS document_changed, old AND kind = 4 AS content_changed FROM s),
m AS (SELECT *, CASE WHEN NOT old THEN 'imported' WHEN document_changed OR content_changed OR kind IN (5, 6) THEN 'updated' ELSE 'skipped' END AS status FROM d) """


@query(_CARD + "SELECT id, title, url AS source_url, key AS dedupe_key, excerpt, ready AS ingestion_status, CASE WHEN told THEN CASE WHEN id % 9 = 0 THEN 7 ELSE length(replace('H' || id || 'onetwoAparagraphwithenoughwords,number' || id, ' ', '')) END END::INT AS word_count FROM s")
def card_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _library(spark, sf_dir)[0]
    return new.select(F.substr("external_id", F.lit(2)).cast("long").alias("id"), "title", "source_url", "dedupe_key", "excerpt", "ingestion_status", F.col("word_count").cast("int").alias("word_count"))


@query(_CARD + "SELECT id, status FROM m")
def bookmark_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an import does with each card: a third of the library's documents match by key alone or by the card's id, messenger URLs among them."""
    rows = bookmarks.upsert(*_library(spark, sf_dir))
    return rows.select(F.substr("external_id", F.lit(2)).cast("long").alias("id"), "status")


@query(_CARD + """SELECT id, title, CASE WHEN old AND kind = 3 THEN 'https://kept.org/' || id ELSE url END AS canonical_url, excerpt, CASE WHEN old AND NOT document_changed AND NOT content_changed THEN 'S' END AS ai_summary, CASE WHEN old THEN 'READ' ELSE 'UNREAD' END AS read_state,
  told AS has_text, 2 AS tags, CASE WHEN old AND kind = 6 THEN 3 ELSE 2 END AS marks FROM m""")
def bookmark_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library once the cards are merged, with the numbers of each document's tags and highlights."""
    tables = _library(spark, sf_dir)
    docs, contents, tags, marks = bookmarks.merge_cards(bookmarks.upsert(*tables), *tables[1:], F.substr("external_id", F.lit(2)).cast("long"))
    count = lambda t, name: t.groupBy(F.col("document_id").alias("id")).agg(F.count("*").cast("int").alias(name))
    out = docs.join(contents.select(F.col("document_id").alias("id"), F.lit(True).alias("has_text")), "id", "left").join(count(tags, "tags"), "id", "left").join(count(marks, "marks"), "id", "left")
    return out.select("id", "title", "canonical_url", "excerpt", "ai_summary", "read_state", F.coalesce("has_text", F.lit(False)).alias("has_text"), "tags", "marks")


@query(_CARD + """SELECT count(*) FILTER (status = 'imported') AS imported, count(*) FILTER (status = 'updated') AS updated, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (id % 50 = 0) AS failed,
  count(*) FILTER (ready = 'READY' AND (told OR excerpt IS NOT NULL) AND (NOT old OR document_changed OR content_changed)) AS queued FROM m""")
def bookmark_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of an import, every fiftieth card of which could not be read once more."""
    tables = _library(spark, sf_dir)
    rows = bookmarks.upsert(*tables)
    docs, contents, _, _ = bookmarks.merge_cards(rows, *tables[1:], F.substr("external_id", F.lit(2)).cast("long"))
    named = docs.withColumn("external_id", F.concat(F.lit("c"), F.col("id").cast("string"))).join(contents.select(F.col("document_id").alias("id"), "plain_text"), "id", "left")
    return bookmarks.import_totals(rows, named, _docs(spark, sf_dir).where("doc_id % 50 = 0"))


@query(_CARD + "SELECT status, count(*) AS n FROM m GROUP BY status")
def bookmark_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bookmarks.status_totals(bookmarks.upsert(*_library(spark, sf_dir)))
