"""Queries over pages. Columns that the table lacks are derived from page_id, in the same way in the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import html_to_text
from lectern.functions.urls import dedupe_key, is_test_url, normalize_url, video_identity
from lectern.operators import dedupe, identity, jobs
from lectern.operators.filters import from_domain, from_nowhere
from lectern.plans.registry import query
from lectern.sources import pages as html_pages


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _captured(pages: DataFrame) -> DataFrame:
    """pages as a library: a minute apart, every 7th from a feed, every 10th without a URL."""
    none = F.lit(None).cast("string")
    url = F.when(F.col("page_id") % 10 != 0, F.col("url"))
    feed = (F.col("page_id") % 7 == 0) & (F.col("page_id") % 10 != 0)
    return pages.select(
        F.col("page_id").alias("id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id") * 60).alias("created_at"), none.alias("source_id"), none.alias("source_title"),
        F.when(feed, F.concat(F.lit("f"), (F.col("page_id") % 3).cast("string"))).alias("feed_id"), F.when(feed, F.concat(F.lit("Feed "), (F.col("page_id") % 3).cast("string"))).alias("feed_title"), url.alias("source_url"), none.alias("canonical_url"), "html",
    )


_URL = "case when page_id % 10 <> 0 then url end"
_HOST = "lower(regexp_extract(url, '^(?i)https?://(?:[^/?#@\\s]*@)?([^/?#:\\s]+)', 1))".replace("^(?i)", "(?i)^")


@query(f"""
WITH d AS (SELECT page_id AS id, 1704067200 + page_id * 60 AS t, nullif({_HOST.replace("url,", "u,")}, '') AS h, page_id % 7 = 0 AND page_id % 10 <> 0 AS fed FROM (SELECT page_id, {_URL} AS u FROM pages)),
x AS (SELECT id, t, CASE WHEN fed THEN 'source:feed:f' || (id % 3) WHEN h IS NOT NULL THEN 'source:domain:' || h ELSE 'source:unknown' END AS identity,
  CASE WHEN fed THEN 'Feed ' || (id % 3) WHEN h IS NOT NULL THEN h ELSE 'Unknown source' END AS label, CASE WHEN fed THEN 'feed' WHEN h IS NOT NULL THEN 'domain' ELSE 'unknown' END AS kind, h AS host FROM d)
SELECT identity, arg_max(label, id) AS label, arg_max(kind, id) AS kind, (array_agg(host ORDER BY id DESC))[1] AS host, count(*) AS n, max(t)::BIGINT AS latest FROM x GROUP BY identity
""")
def source_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by source, the latest first."""
    return identity.source_groups(identity.resolve_sources(_captured(_pages(spark, sf_dir)))).withColumn("latest", F.unix_seconds("latest"))


@query(f"""
WITH d AS (SELECT page_id AS id, nullif({_HOST}, '') AS h FROM pages), a AS (SELECT h, 'Alias of ' || h AS name FROM d WHERE h IS NOT NULL GROUP BY h HAVING min(id) % 2 = 0)
SELECT coalesce(a.name, d.h, 'Unknown source') AS label, count(*) AS n FROM d LEFT JOIN a USING (h) GROUP BY 1
""")
def source_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources under their aliases, which an alias log gives to every other host (and takes from the rest)."""
    docs = _captured(_pages(spark, sf_dir)).drop("feed_id", "feed_title", "source_url").join(_pages(spark, sf_dir).select(F.col("page_id").alias("id"), F.col("url").alias("source_url")), "id")
    docs = docs.withColumns({"feed_id": F.lit(None).cast("string"), "feed_title": F.lit(None).cast("string")})
    bare = identity.resolve_sources(docs)
    hosts = bare.where("host is not null").groupBy(F.col("host").alias("value")).agg(F.min("id").alias("first"))
    named = hosts.select(F.lit("domain").alias("kind"), "value", F.concat(F.lit("Alias of "), F.col("value")).alias("name"), F.lit(1).alias("seq"))
    dropped = hosts.where("first % 2 <> 0").select(F.lit("domain").alias("kind"), "value", F.lit(None).cast("string").alias("name"), F.lit(2).alias("seq"))
    return identity.resolve_sources(docs, jobs.aliases(named.union(dropped))).groupBy("label").agg(F.count("*").alias("n"))


_NORM = """
WITH p AS (SELECT page_id, url, regexp_extract(url, '(?i)^(https?://[^/?#\\s]+)([^?#\\s]*)(\\?[^#\\s]*)?(#\\S*)?$', 1) AS o, regexp_extract(url, '(?i)^(https?://[^/?#\\s]+)([^?#\\s]*)(\\?[^#\\s]*)?(#\\S*)?$', 2) AS path,
  regexp_extract(url, '(?i)^(https?://[^/?#\\s]+)([^?#\\s]*)(\\?[^#\\s]*)?(#\\S*)?$', 3) AS q, regexp_extract(url, '(?i)^(https?://[^/?#\\s]+)([^?#\\s]*)(\\?[^#\\s]*)?(#\\S*)?$', 4) AS frag FROM pages),
k AS (SELECT *, list_filter(string_split(q[2:], '&'), lambda x: x <> '' AND NOT regexp_matches(string_split(x, '=')[1], '^(utm_|qa_|codex_)') AND NOT list_contains(['fbclid','gclid','msclkid','mc_cid','mc_eid','_hsenc','_hsmi','ref','source'], string_split(x, '=')[1])) AS kept FROM p),
n AS (SELECT page_id, url, CASE WHEN o = '' THEN url ELSE regexp_replace(lower(o) || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END || frag, '/$', '') END AS norm FROM k)
""".replace("\\\\", "\\")


@query(_NORM + "SELECT page_id, norm AS normalized, CASE WHEN page_id % 5 = 0 THEN 'rss:g' || (page_id // 10) WHEN page_id % 5 = 1 THEN 'web:ext:e' || page_id ELSE 'web:url:' || norm END AS dedupe_key, regexp_matches(url, '[?&](qa_|codex_)') AS test FROM n")
def url_dedupe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical URLs and dedupe keys: every 5th page stands for a feed entry, and the next has an external id."""
    url, i = F.col("url"), F.col("page_id")
    kind = F.when(i % 5 == 0, "RSS_ITEM").otherwise("WEB_PAGE")
    ext = F.when(i % 5 == 0, F.concat(F.lit("g"), F.floor(i / 10).cast("string"))).when(i % 5 == 1, F.concat(F.lit("e"), i.cast("string")))
    return _pages(spark, sf_dir).select("page_id", normalize_url(url).alias("normalized"), dedupe_key(kind, url, F.lit(None).cast("string"), ext).alias("dedupe_key"), is_test_url(url).alias("test"))


_PLAIN_SQL = "url_decode(replace({0}, '+', ' '))"
_FORM_SQL = "replace(replace(replace(url_encode(" + _PLAIN_SQL + "), '%20', '+'), '~', '%7E'), '%2A', '*')"


@query(rf"""
WITH u AS (SELECT page_id, regexp_extract(url, '(?i)^https?://[^/?#]+') AS o, ['a b', 'x%7Ey~', 'p+q', '%C3%BCü', '100%', '%zz', 'u*-_.', ''][(page_id % 8 + 1)::INT] AS v, ['k', 'k%20k', '%75tm_x', 'ref', 'flag', 'qa%5Fx', 'source', 'é'][(page_id // 8 % 8 + 1)::INT] AS k FROM pages),
p AS (SELECT *, replace(v, ' ', '%20') AS w, page_id % 5 <> 0 AS valued FROM u),
n AS (SELECT *, {_PLAIN_SQL.format("k")} AS plain FROM p)
SELECT page_id, lower(o) || '/p' || CASE WHEN regexp_matches(plain, '^(utm_|qa_)') OR plain IN ('ref', 'source') THEN '' ELSE '?' || {_FORM_SQL.format("k")} || '=' || CASE WHEN valued THEN {_FORM_SQL.format("w")} ELSE '' END END
  || CASE WHEN regexp_matches(plain, '^(utm_|qa_)') OR plain IN ('ref', 'source') THEN '?' ELSE '&' END || 'z=1' AS url, plain = 'qa_x' AS test FROM n
""")
def url_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical URLs of pages' hosts with parameters whose names and values are encoded, partly encoded, broken, empty or lack a value."""
    i = F.col("page_id")
    pick = lambda xs, k: F.get(F.array(*map(F.lit, xs)), (k % len(xs)).cast("int"))
    value = pick(["a%20b", "x%7Ey~", "p+q", "%C3%BCü", "100%", "%zz", "u*-_.", ""], i)
    name = pick(["k", "k%20k", "%75tm_x", "ref", "flag", "qa%5Fx", "source", "é"], F.floor(i / 8))
    origin = F.regexp_extract("url", r"^(?i)https?://[^/?#]+", 0)
    url = F.concat(origin, F.lit("/p?"), name, F.when(i % 5 != 0, F.concat(F.lit("="), value)).otherwise(""), F.lit("&&z=1"))
    return _pages(spark, sf_dir).select("page_id", normalize_url(url).alias("url"), is_test_url(url).alias("test"))


@query(f"SELECT page_id FROM (SELECT page_id, {_URL} AS u FROM pages) WHERE u LIKE 'http://t%' OR u LIKE 'https://t%'")
def filter_source_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose URL starts with a host's first letter: the filter is a prefix."""
    return _captured(_pages(spark, sf_dir)).where(from_domain("t")).select(F.col("id").alias("page_id"))


@query("SELECT page_id FROM pages WHERE page_id % 10 = 0")
def filter_source_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _captured(_pages(spark, sf_dir)).where(from_nowhere()).select(F.col("id").alias("page_id"))


_BLOCKS = "p|section|article|li|ul|ol|h1|h2|h3|h4|h5|h6|blockquote|figure|figcaption|pre|tr|table|thead|tbody"


def _text_sql(html: str) -> str:
    t = f"regexp_replace(regexp_replace(regexp_replace({html}, '(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</({_BLOCKS})>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
    for name, char in (("nbsp", "' '"), ("amp", "'&'"), ("lt", "'<'"), ("gt", "'>'"), ("quot", "'\"'"), ("#39", "chr(39)"), ("#x27", "chr(39)")):
        t = f"regexp_replace({t}, '(?i)&{name};', {char}, 'g')"
    t = f"regexp_replace(regexp_replace(replace({t}, chr(13) || chr(10), chr(10)), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace(array_to_string(list_transform(string_split({t}, chr(10)), lambda x: trim(x, ' ')), chr(10)), '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT page_id, length(t)::BIGINT AS n_chars, sha256(t) AS text_hash FROM (SELECT page_id, {_text_sql('html')} AS t FROM pages)")
def html_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = html_to_text(F.col("html"))
    return _pages(spark, sf_dir).select("page_id", t.alias("t")).select("page_id", F.length("t").cast("long").alias("n_chars"), F.sha2(F.col("t").cast("binary"), 256).alias("text_hash"))


@query(f"""
SELECT page_id, pos::INT AS pos, h[3:3]::INT AS level, coalesce(nullif(trim(regexp_replace({_text_sql("h")}, '\\s+', ' ', 'g')), ''), '') AS text, 'section-' || (pos + 1) AS anchor
FROM (SELECT page_id, unnest(hs) AS h, unnest(range(len(hs))) AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-3][^>]*>.*?</h[1-3]>') AS hs FROM pages))
""")
def page_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_pages.headings(_pages(spark, sf_dir))


@query(r"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '(?i)^(https?://[^/?#\s]+)', 1) AS origin, regexp_extract(url, '(?i)^https?://[^/?#\s]+([^?#\s]*)', 1) AS path,
  list_append(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"', 1), repeat('../', (page_id % 5)::INT) || 'up/./' || page_id || '?a=../b') AS hs FROM pages),
f AS (SELECT *, string_split(CASE WHEN path = '' THEN '/' ELSE path END, '/') AS parts FROM p),
h AS (SELECT *, unnest(hs) AS href, unnest(range(len(hs))) AS pos FROM f)
SELECT page_id, pos::INT AS pos, href, CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN href LIKE '/%' THEN origin || href
  WHEN pos = len(hs) - 1 THEN origin || array_to_string(parts[:greatest(1, len(parts) - 1 - page_id % 5)], '/') || '/up/' || page_id || '?a=../b' END AS url FROM h
""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages, and one more of each that goes up to four steps up, on some pages above the root."""
    i = F.col("page_id")
    up = F.concat(F.repeat(F.lit("../"), (i % 5).cast("int")), F.lit("up/./"), i.cast("string"), F.lit("?a=../b"))
    return html_pages.links(_pages(spark, sf_dir).withColumn("html", F.concat("html", F.lit('<a href="'), up, F.lit('">'))))


_DAY = "make_timestamp(2000 + page_id % 50, 1 + page_id % 12, 1 + page_id % 28, page_id % 24, page_id % 60, 0)"
_TITLE = _text_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")


@query(f"""
SELECT page_id, nullif(trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')), '') AS title, lower(regexp_extract(html, '(?i)<html\\b[^>]*\\blang\\s*=\\s*"?([a-zA-Z-]+)', 1)) AS lang,
  CASE page_id % 3 WHEN 0 THEN regexp_extract(url, '(?i)^https?://[^/?#]+', 0) || '/c/' || page_id WHEN 1 THEN 'https://o.example/' || page_id END AS canonical_url,
  CASE WHEN page_id % 4 < 3 THEN 'Ann ' || chr((97 + page_id % 10)::INT) END AS author,
  CASE page_id % 4 WHEN 0 THEN epoch({_DAY})::BIGINT WHEN 1 THEN epoch({_DAY})::BIGINT WHEN 2 THEN 1704067200 + page_id * 60 END AS published,
  CASE WHEN page_id % 2 = 0 THEN 'Site & co ' || page_id END AS site_name
FROM pages
""")
def page_metadata_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of metadata() but kind (page_kinds has it), for every page with what the table's pages lack put into its head.

    By page: a meta author with a mark and a date; both in JSON-LD; unusable ones before usable ones; neither. A canonical link, a
    URL among the properties, or neither; a site's name with an entity, or none.
    """
    i = F.col("page_id")
    s, name = i.cast("string"), F.concat(F.lit("Ann "), F.char(97 + i % 10))
    day = F.format_string("%d-%02d-%02dT%02d:%02d:00Z", 2000 + i % 50, 1 + i % 12, 1 + i % 28, i % 24, i % 60)
    forms = [
        F.concat(F.lit('<meta name="author" content="By: '), name, F.lit(',"><meta property="article:published_time" content="'), day, F.lit('">')),
        F.concat(F.lit('<script type="application/ld+json">{"author": [{"@type": "Person", "name": "'), name, F.lit('"}], "datePublished": "'), day, F.lit('"}</script>')),
        F.concat(
            F.lit('<meta name="author" content="https://x.org/a"><meta name="byline" content="'), name, F.lit('"><meta name="date" content="soon"><time datetime="'),
            (F.lit(1_704_067_200) + i * 60).cast("string"), F.lit('"></time>'),
        ),
        F.lit(""),
    ]
    links = [F.concat(F.lit('<link rel="canonical" href="/c/'), s, F.lit('">')), F.concat(F.lit('<meta property="og:url" content="https://o.example/'), s, F.lit('">')), F.lit("")]
    site = F.when(i % 2 == 0, F.concat(F.lit('<meta property="og:site_name" content="Site &amp; co '), s, F.lit('">'))).otherwise("")
    one = lambda choices: F.coalesce(*[F.when(i % len(choices) == k, c) for k, c in enumerate(choices)])
    html = F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), one(forms), one(links), site))
    rows = html_pages.metadata(_pages(spark, sf_dir).withColumn("html", html))
    return rows.select("page_id", "title", "lang", "canonical_url", "author", F.unix_seconds("published_at").alias("published"), "site_name")


@query(f"""
SELECT page_id, nullif(trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')), '') AS title, lower(regexp_extract(html, '(?i)<html\\b[^>]*\\blang\\s*=\\s*"?([a-zA-Z-]+)', 1)) AS lang,
  nullif(regexp_extract(html, '<link rel="canonical" href="([^"]*)"', 1), '') AS canonical_url, nullif(regexp_extract(html, '<meta name="author" content="([^"]*)"', 1), '') AS author,
  nullif(regexp_extract(html, '<meta property="og:site_name" content="([^"]*)"', 1), '') AS site_name
FROM pages
""")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the pages as they are; page_metadata_whole has pages with more in their heads."""
    return html_pages.metadata(_pages(spark, sf_dir)).select("page_id", "title", "lang", "canonical_url", "author", "site_name")


@query("""
SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'Ann Graph' WHEN 1 THEN 'Bea List' WHEN 2 THEN 'Cy Person' WHEN 3 THEN 'Deep Down' WHEN 4 THEN 'Org Inc' WHEN 5 THEN 'Second Block' END AS author,
  CASE page_id % 7 WHEN 0 THEN 1704067200 WHEN 3 THEN 1704153600 WHEN 5 THEN 1704240000 END::BIGINT AS published, page_id % 7 = 4 AS video FROM pages
""")
def page_json_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors, dates and types of JSON-LD that pages are given: in graphs, lists and deep objects, after unusable names, in a second block after a broken one."""
    forms = [
        '{"@graph": [{"@type": "WebSite", "name": "no author"}, {"@type": "Article", "author": {"@id": "#a", "name": "Ann Graph"}, "datePublished": "2024-01-01T00:00:00Z"}]}',
        '[{"author": ["https://x.org/me", {"name": ""}, "By: Bea List,"]}, {"author": "Later"}]', '{"about": {"@type": ["Thing", "Person"], "name": "Cy Person"}, "datePublished": 20240101}',
        '{"a": [[{"b": {"c": {"creator": {"author": "Deep Down"}, "dateCreated": "2024-01-02T00:00:00Z", "datePublished": "soon"}}}]]}', '{"@type": "VideoObject", "publisher": {"@type": "NewsMediaOrganization", "name": "Org Inc"}}',
        '{"author": "Broken"', '{"name": "Nobody", "@type": "Thing"}',
    ]
    script = '<script type="application/ld+json">{}</script>'
    made = [script.format(f) + (script.format('{"author": "Second Block", "dateModified": "2024-01-03T00:00:00Z"}') if k == 5 else "") for k, f in enumerate(forms)]
    given = F.get(F.array(*map(F.lit, made)), (F.col("page_id") % 7).cast("int"))
    rows = html_pages.metadata(_pages(spark, sf_dir).withColumn("html", F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), given))))
    return rows.select("page_id", "author", F.unix_seconds("published_at").alias("published"), F.array_contains("types", "videoobject").alias("video"))


@query()
def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable content; it needs a parser, so it is tested on pages made by hand."""
    return html_pages.extract(_pages(spark, sf_dir)).select("page_id", "title", "lang", "units", "block_score", "text_hash", "error_code")


_IDENT = "left(md5(page_id::VARCHAR), 11)"
_VIDEO = f"""WITH u AS (SELECT page_id, page_id % 6 AS f, {_IDENT} AS y, 'BV' || left(md5(page_id::VARCHAR), 10) AS b, page_id % 4 AS m, page_id % 7 AS s, page_id % 4 * 60 + page_id % 7 AS t FROM pages),
v AS (SELECT page_id, CASE WHEN f < 4 THEN 'youtube' WHEN f = 4 THEN 'bilibili' END AS provider, CASE WHEN f < 4 THEN y WHEN f = 4 THEN b END AS ident,
  nullif(CASE f WHEN 0 THEN t WHEN 1 THEN CASE WHEN s > 0 THEN s ELSE t END WHEN 2 THEN 0 WHEN 3 THEN t WHEN 4 THEN s END, 0)::BIGINT AS start FROM u) """


@query(_VIDEO + """SELECT page_id, provider || ':' || ident AS external_id, CASE WHEN provider IS NOT NULL THEN start END AS start_seconds, CASE provider WHEN 'youtube' THEN 'https://www.youtube.com/embed/' || ident || '?enablejsapi=1&playsinline=1&rel=0' || coalesce('&start=' || start, '')
  WHEN 'bilibili' THEN 'https://player.bilibili.com/player.html?bvid=' || ident || '&page=1&high_quality=1' END AS embed_url FROM v""")
def video_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos of links in five forms, with start marks of all kinds and both at once; the pages' own URLs, every sixth, are none."""
    i = F.col("page_id")
    md5 = F.md5(i.cast("string").cast("binary"))
    y, b = F.left(md5, F.lit(11)), F.concat(F.lit("BV"), F.left(md5, F.lit(10)))
    t, s = F.concat((i % 4).cast("string"), F.lit("m"), (i % 7).cast("string"), F.lit("s")), (i % 7).cast("string")
    forms = [
        F.concat(F.lit("https://youtu.be/"), y, F.lit("?t="), t), F.concat(F.lit("https://www.youtube.com/watch?v="), y, F.lit("&t="), t, F.lit("&start="), s), F.concat(F.lit("https://m.youtube.com/shorts/"), y, F.lit("?t=0")),
        F.concat(F.lit("https://www.youtube.com/embed/"), y, F.lit("#t="), F.upper(t)), F.concat(F.lit("https://www.bilibili.com/video/"), b, F.lit("?t="), s), F.col("url"),
    ]
    v = video_identity(F.coalesce(*[F.when(i % 6 == k, f) for k, f in enumerate(forms)]))
    return _pages(spark, sf_dir).select("page_id", v.alias("v")).select("page_id", "v.external_id", "v.start_seconds", "v.embed_url")


@query(_NORM + """, b AS (SELECT page_id, 'h-' || coalesce(nullif(trim(regexp_replace(lower(regexp_extract(norm, '^https?://([^/?#:]+)', 1)), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'x') AS base FROM n),
r AS (SELECT page_id, base, row_number() OVER (PARTITION BY base ORDER BY page_id) AS k FROM b)
SELECT page_id, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS slug FROM r""")
def unique_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.functions.text import slug
    from lectern.functions.urls import hostname

    rows = _pages(spark, sf_dir).select(F.col("page_id").alias("id"), F.concat(F.lit("h-"), F.coalesce(slug(hostname(normalize_url(F.col("url")))), F.lit("x"))).alias("base"))
    return dedupe.numbered(rows, "base").select(F.col("id").alias("page_id"), "slug")


@query(_NORM + """, s AS (SELECT norm AS k, min(page_id) AS id FROM n WHERE page_id % 3 = 0 GROUP BY norm), c AS (SELECT page_id, CASE WHEN page_id % 6 = 1 THEN page_id - 1 END AS other, norm FROM n WHERE page_id % 3 <> 0),
m AS (SELECT c.page_id, s.id AS by_key, o.id AS by_url FROM c LEFT JOIN s ON c.norm = s.k LEFT JOIN (SELECT page_id AS id FROM n WHERE page_id % 3 = 0) o ON o.id = c.other)
SELECT CASE WHEN by_key IS NOT NULL THEN 'dedupe_key' WHEN by_url IS NOT NULL THEN 'url' ELSE 'new' END AS outcome, count(*) AS n FROM m GROUP BY 1""")
def capture_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third page is the library, and all others are captured, some of which name a neighbour's URL as a candidate."""
    pages = _pages(spark, sf_dir)
    none = F.lit(None).cast("string")
    key = normalize_url(F.col("url"))
    stored = pages.where("page_id % 3 = 0").select(F.col("page_id").alias("id"), key.alias("dedupe_key"), none.alias("external_id"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("source_url"), none.alias("canonical_url"), none.alias("content_hash"))
    other = F.when(F.col("page_id") % 6 == 1, F.concat(F.lit("p"), (F.col("page_id") - 1).cast("string")))
    new = pages.where("page_id % 3 <> 0").select(F.col("page_id").alias("id"), key.alias("dedupe_key"), none.alias("external_id"), F.array(other).alias("urls"), none.alias("final_key"), none.alias("content_hash"))
    return dedupe.match_captures(new, stored).groupBy(F.coalesce("matched_by", F.lit("new")).alias("outcome")).agg(F.count("*").alias("n"))


_KINDS = [
    "<p>当前环境异常</p>", "<div id='js_article' class='a share_content_page'>x</div>", "<p>该公众号已迁移</p>", "<p>Please verify you are human</p>", "<h1>404 Not Found</h1>", "<div id='js_content'>该公众号已迁移</div>", "",
]
_KIND_ROWS = """WITH k AS (SELECT page_id, page_id % 7 AS f, page_id // 7 % 3 AS g, CASE WHEN page_id // 7 % 3 = 0 THEN 'https://mp.weixin.qq.com/s/' || page_id ELSE url END AS url, html FROM pages),
m AS (SELECT page_id, url, CASE WHEN g = 2 THEN regexp_replace(html, '(?is)(<body[^>]*>).*$', '\\1') || {0}[(f + 1)::INT] || '</body></html>' ELSE regexp_replace(html, '(?i)(<body[^>]*>)', '\\1' || {0}[(f + 1)::INT]) END AS h, g = 0 AS here FROM k),
b AS (SELECT page_id, h, here, left({1}, 1500) AS t FROM (SELECT *, CASE WHEN regexp_matches(h, '(?i)<body[^>]*>') THEN regexp_extract(h, '(?is)<body\\b[^>]*>(.*)$', 1) ELSE h END AS body FROM m)),
c AS (SELECT *, regexp_matches(h, '(?i)id=.js_content') AS content, len(regexp_extract_all(t, '[一-鿿]')) + len(regexp_extract_all(t, '[A-Za-z0-9]+(?:[._''’-][A-Za-z0-9]+)*')) AS units FROM b) """


@query(
    _KIND_ROWS.replace("\\\\", "\\").format([k.replace("'", '"') for k in _KINDS], _text_sql("body"))
    + """SELECT page_id, CASE WHEN here AND regexp_matches(t, '当前环境异常|完成验证后即可继续访问|去验证|环境异常') THEN 'messenger_verification' WHEN here AND NOT content AND regexp_matches(h, 'share_content_page') THEN 'share_shell'
  WHEN here AND NOT content AND units < 180 AND regexp_matches(t, '该公众号已迁移') THEN 'migration' WHEN regexp_matches(t, '(?i)verify you are human|captcha|当前环境异常') AND length(t) < 800 THEN 'verification' WHEN regexp_matches(t, '(?i)404 not found') AND length(t) < 600 THEN 'shell' END AS kind FROM c"""
)
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of pages, each of which is given a phrase or an element; every third page is on the messenger's host, and every third has nothing else."""
    i = F.col("page_id")
    phrase = F.get(F.array(*[F.lit(k.replace("'", '"')) for k in _KINDS]), (i % 7).cast("int"))
    group = F.floor(i / 7) % 3
    url = F.when(group == 0, F.concat(F.lit("https://mp.weixin.qq.com/s/"), i.cast("string"))).otherwise(F.col("url"))
    alone = F.concat(F.regexp_replace("html", r"(?is)(<body[^>]*>).*$", "$1"), phrase, F.lit("</body></html>"))
    html = F.when(group == 2, alone).otherwise(F.regexp_replace(F.col("html"), F.lit(r"(?i)(<body[^>]*>)"), F.concat(F.lit("$1"), phrase)))
    return html_pages.metadata(_pages(spark, sf_dir).select("page_id", url.alias("url"), html.alias("html"))).select("page_id", "kind")
