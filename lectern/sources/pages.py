"""Pages: metadata, links, headings and readable content from HTML.

Metadata, links and headings are columns. Choosing the readable block needs the tree (readable.py), so extract() passes html
through a function over Arrow batches.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from lectern.functions.columns import let
from lectern.functions.dates import page_date
from lectern.functions.text import author, collapse, html_to_text, page_excerpt, paragraph_html, readable_text, readable_units, text_hash, unescape_js
from lectern.functions.urls import VIDEO_HOSTS, WECHAT_HOST, hostname, resolve_url
from lectern.operators.batches import text_batches
from lectern.operators.filters import CONTENT_ELEMENTS, KIND_CODES, page_kind, unreadable_extract
from lectern.sources.readable import readable_all
from lectern.sources.scripts import json_ld


def _meta_tags(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))


def _content(tags: Column, *names: str) -> Column:
    """The content of the first of a page's meta tags with one of these names. Each tag is bound, so its content is read once."""

    def content(tag: Column) -> Column:
        quoted = [F.nullif(F.regexp_extract(tag, p, 1), F.lit("")) for p in (r'(?is)\bcontent\s*=\s*"([^"]*)"', r"(?is)\bcontent\s*=\s*'([^']*)'")]
        return collapse(html_to_text(F.coalesce(*quoted)))

    def one(name: str) -> Column:
        named = F.filter(tags, lambda t: t.rlike(rf"(?i)\b(?:name|property|itemprop)\s*=\s*[\"']?{re.escape(name)}[\"'\s/>]"))
        return F.get(F.transform(F.slice(named, 1, 1), content), 0)

    return F.coalesce(*map(one, names))


def meta(html: Column, *names: str) -> Column:
    """The content of the first meta element with one of these names or properties, in the order of the names."""
    return _content(_meta_tags(html), *names)


def _json_ld_blocks(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))


#: Names under which pages tell their author and their date, in this order.
AUTHOR_NAMES = ["author", "article:author", "og:article:author", "og:author", "twitter:creator", "parsely-author", "dc.creator", "dc:creator", "byline"]
DATE_NAMES = ["article:published_time", "og:article:published_time", "og:published_time", "published_time", "publishdate", "pubdate", "date", "dc.date"]


def metadata(pages: DataFrame, *keep: str) -> DataFrame:
    """page_id, title, lang, canonical_url, author, published_at, site_name, kind and types (of JSON-LD) of pages (page_id, url, html), and
    the columns to keep.

    The first usable value counts: an author or a date that does not parse gives way to the next one. What several columns read of
    a page (its meta tags, JSON-LD, links and text) is a projection of its own, which Catalyst does not merge, so each is found once.
    """
    html, tags, told, text, href = map(F.col, ("html", "_meta_tags", "_json_ld", "_body_text", "_canonical"))
    canonical = F.get(F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"(?i)\brel\s*=\s*[\"']?canonical")), 0)
    body = F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*)$", 1)
    read = pages.select(
        *dict.fromkeys(["page_id", *keep, "url", "html"]), _meta_tags(html).alias("_meta_tags"), json_ld(_json_ld_blocks(html)).alias("_json_ld"),
        html_to_text(F.when(body == "", html).otherwise(body)).alias("_body_text"), F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1).alias("_title"),
        F.regexp_extract(canonical, r"(?i)\bhref\s*=\s*[\"']([^\"']+)[\"']", 1).alias("_canonical"), F.regexp_extract(html, r"(?i)<time\b[^>]*\bdatetime\s*=\s*[\"']([^\"']+)", 1).alias("_time"),
    )
    dates = F.concat(F.array(*[_content(tags, n) for n in DATE_NAMES], F.nullif("_time", F.lit(""))), told["dates"])
    names = F.concat(F.array(*[_content(tags, n) for n in AUTHOR_NAMES]), told["authors"])
    first = lambda values, parse: F.get(F.filter(F.transform(values, parse), lambda x: x.isNotNull()), 0)
    return read.select(
        "page_id", *keep,
        F.coalesce(collapse(html_to_text(F.col("_title"))), _content(tags, "og:title", "twitter:title")).alias("title"),
        F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-zA-Z-]+)", 1)), F.lit("")).alias("lang"),
        F.coalesce(resolve_url(F.nullif(href, F.lit("")), F.col("url")), _content(tags, "og:url")).alias("canonical_url"),
        first(names, author).alias("author"), first(dates, page_date).alias("published_at"), _content(tags, "og:site_name").alias("site_name"),
        page_kind(html, text, F.col("url"), inline=inline_text(html, F.col("url")).isNotNull()).alias("kind"),
        told["types"].alias("types"),
    )


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos, href and url (resolved; null for other schemes) of each anchor."""
    hrefs = F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*?href\s*=\s*\"([^\"]*)\""), F.lit(1))
    rows = pages.select("page_id", F.col("url").alias("base"), F.posexplode(hrefs).alias("pos", "href"))
    return rows.select("page_id", "pos", "href", resolve_url(F.col("href"), F.col("base")).alias("url"))


def headings(pages: DataFrame) -> DataFrame:
    """page_id, pos, level, text and anchor of each heading from h1 to h3."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<h[1-3][^>]*>.*?</h[1-3]>"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("pos", "h"))
    text = F.coalesce(collapse(html_to_text(F.col("h"))), F.lit(""))
    return rows.select("page_id", "pos", F.substr("h", F.lit(3), F.lit(1)).cast("int").alias("level"), text.alias("text"), F.concat(F.lit("section-"), (F.col("pos") + 1).cast("string")).alias("anchor"))


@F.pandas_udf(StructType().add("content_html", StringType()).add("block_score", DoubleType()))
def readable_block(html: pd.Series, url: pd.Series, title: pd.Series, given: pd.Series) -> pd.DataFrame:
    """Clean HTML and score of the readable part of pages, in Arrow batches: it needs the tree of a page."""
    none = lambda s: s.astype(object).where(s.notna(), None)
    return pd.DataFrame(readable_all(*map(none, (html, url, title, given))), columns=["content_html", "block_score"])


def inline_text(html: Column, url: Column) -> Column:
    """The text that a page of the messenger has in a script and not in an element; null for others."""
    kind = F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in (r"""(?i)\b(?:window\.)?item_show_type\s*=\s*['"]?(\d+)['"]?""", r"""(?i)\bitem_show_type\s*:\s*['"]?(\d+)['"]?""")])
    raw = F.regexp_extract(html, r"(?is)\bcontent_noencode\s*:\s*JsDecode\(\s*'(.*?)'\s*\)\s*,\s*source_url\b", 1)
    content = html.rlike(CONTENT_ELEMENTS[0]) | html.rlike(CONTENT_ELEMENTS[1])
    return F.when((kind == "10") & (hostname(url) == WECHAT_HOST) & ~content, readable_text(unescape_js(raw)))


def video_text(html: Column, url: Column, types: Column) -> Column:
    """What stands for the text of a page of a video: its description and its URL; null for other pages. types are those of its JSON-LD."""

    def told(tags: Column) -> Column:
        kind = F.lower(_content(tags, "og:type")).startswith("video")
        listed = F.array_contains(types, "videoobject")
        here = F.coalesce(hostname(url).isin(*VIDEO_HOSTS["www.youtube.com"]), F.lit(False)) | F.coalesce(kind, F.lit(False)) | F.coalesce(listed, F.lit(False))
        text = readable_text(_content(tags, "og:description", "twitter:description", "description"))
        return F.when(here, F.concat_ws("\n\n", text, F.concat(F.lit("Video URL: "), url)))

    return let(_meta_tags(html), told)


def extract(pages: DataFrame) -> DataFrame:
    """metadata() of pages with content_html, plain_text, excerpt, units, text_hash and error_code (null for readable pages).

    Each row of pages gives one row, in one pass. A null html counts as empty. Pages without a text of their own have that of a
    script, or, for videos, their description. The error code is by the page's kind, else for an empty or an unreadable text.
    """
    html = F.coalesce("html", F.lit(""))
    out = text_batches(pages).select("page_id", "url", html.alias("html"))
    given = inline_text(F.col("html"), F.col("url"))
    out = metadata(out, "html", "url").withColumn("_given", F.when(given.isNotNull(), paragraph_html(given)))
    out = out.withColumn("_b", readable_block("html", "url", "title", "_given")).select("*", "_b.content_html", "_b.block_score")
    told = paragraph_html(video_text(F.col("html"), F.coalesce("canonical_url", "url"), F.col("types")))
    empty = html_to_text(F.col("content_html")) == ""
    out = out.withColumn("content_html", F.when(empty & told.isNotNull(), told).otherwise(F.col("content_html")))
    out = out.withColumn("plain_text", F.nullif(html_to_text(F.col("content_html")), F.lit("")))
    code = F.create_map(*[F.lit(x) for pair in KIND_CODES.items() for x in pair])[F.col("kind")]
    unreadable = F.when(unreadable_extract(F.col("url"), F.col("plain_text")), "EXTRACTION_UNREADABLE")
    out = out.withColumns({
        "excerpt": page_excerpt(F.col("plain_text")), "units": readable_units(F.col("plain_text")), "text_hash": text_hash(F.col("plain_text")),
        "error_code": F.coalesce(code, F.when(F.col("plain_text").isNull(), "EXTRACTION_EMPTY"), unreadable),
    })
    return out.drop("html", "url", "types", "_given", "_b")
