"""Text columns: normalisers, HTML to text, counts, excerpts, slugs, YAML."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.functions.columns import let

#: Tags whose end breaks a line.
BLOCK_ENDS = "p|section|article|li|ul|ol|h1|h2|h3|h4|h5|h6|blockquote|figure|figcaption|pre|tr|table|thead|tbody"
#: Entities that text has decoded, in this order.
ENTITIES = [("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("#x27", "'")]
#: Escapes of scripts' strings, replaced in this order.
JS_ESCAPES = [("\\x5c", "\\"), ("\\x0d", "\r"), ("\\x0a", "\n"), ("\\x22", '"'), ("\\x26", "&"), ("\\x27", "'"), ("\\x3c", "<"), ("\\x3e", ">")]


def collapse(c: Column) -> Column:
    """One space for each run of white space, none at the ends; blank gives null."""
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def html_to_text(html: Column) -> Column:
    """Plain text by rules: line breaks after blocks, tags dropped, entities decoded, spaces squeezed."""
    t = F.regexp_replace(html, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, rf"(?i)</({BLOCK_ENDS})>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    for name, char in ENTITIES:
        t = F.regexp_replace(t, f"(?i)&{name};", char)
    t = F.regexp_replace(F.regexp_replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(F.array_join(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), "\n"), r"^\s+|\s+$", "")


def readable_text(c: Column) -> Column:
    """Line ends unified, lines trimmed, at most one blank line."""
    t = F.regexp_replace(c, "\r\n?", "\n")
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " ")))
    return F.nullif(F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), r"^\s+|\s+$", ""), F.lit(""))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape_js(c: Column) -> Column:
    for a, b in JS_ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


#: Scripts whose letters count as units of their own; none of them is below U+1100.
_IDEOGRAPHS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
#: A sign that stands for a token while tokens are counted.
_TOKEN = "\u0001"


def readable_units(c: Column, joiners: str = "._'’-") -> Column:
    """Ideographs and kana plus Latin tokens.

    Ideographs are what is left once runs of other characters are gone. Tokens are counted by a sign that replaces them, which makes
    no array of them; texts that hold the sign are counted one by one.
    """
    latin = rf"[A-Za-z0-9]+(?:[{joiners}][A-Za-z0-9]+)*"
    ideographs = lambda t: F.length(F.regexp_replace(F.regexp_replace(t, r"[\x00-\x{10FF}]+", ""), f"[^{_IDEOGRAPHS}]+", ""))
    signs = lambda t: F.length(t) - F.length(F.replace(t, F.lit(_TOKEN), F.lit("")))
    tokens = lambda t: F.when(F.contains(t, F.lit(_TOKEN)), F.regexp_count(t, F.lit(latin))).otherwise(let(F.regexp_replace(t, latin, _TOKEN), signs))
    return let(F.coalesce(c, F.lit("")), lambda t: ideographs(t) + tokens(t)).cast("int")


def video_units(c: Column) -> Column:
    return readable_units(c, "’'_:-")


def bookmark_words(given: Column, text: Column) -> Column:
    """The given count, not under 0, else characters that are not white space; null if there are none."""
    return F.coalesce(F.when(given.isNotNull(), F.greatest(F.lit(0), given)), F.nullif(F.length(F.regexp_replace(text, r"\s+", "")), F.lit(0)))


def reading_minutes(words: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(words / 350)).cast("int")


def feed_excerpt(text: Column, most: int = 220) -> Column:
    """The text, or its first characters and an ellipsis if it is longer."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most))), F.lit("…"))).otherwise(text)


def page_excerpt(text: Column) -> Column:
    return F.nullif(F.left(text, F.lit(240)), F.lit(""))


def is_noise(text: Column) -> Column:
    """Excerpts that say nothing: bylines, bare URLs, and runs of four or more dots, bars and spaces."""
    return text.rlike(r"^(?i)(?:文|作者|来源|by)[:：]") | text.rlike(r"^(?i)https?://\S+$") | text.rlike(r"^[.。…·_\-\s]{4,}$")


def block_excerpt(blocks: Column) -> Column:
    """Of a list of texts the first of 20 characters that says something, else the first that says something, else the first; at most 240 characters."""
    clean = F.filter(F.transform(blocks, collapse), lambda x: x.isNotNull())
    told = F.filter(clean, lambda x: ~is_noise(x))
    return F.left(F.coalesce(F.get(F.filter(told, lambda x: F.length(x) >= 20), 0), F.get(told, 0), F.get(clean, 0)), F.lit(240))


def bookmark_excerpt(description: Column, rendered: Column) -> Column:
    """The description if there is nothing rendered, or if it has 20 characters and says something; else what is rendered."""
    d, r = collapse(description), collapse(rendered)
    return F.when(r.isNull() | ((F.length(d) >= 20) & ~is_noise(d)), d).otherwise(r)


def text_hash(c: Column, family: str = "page") -> Column:
    """SHA-1 for feeds and SHA-256 for pages, bookmarks and videos, so hashes never meet across families."""
    return F.sha1(c.cast("binary")) if family == "feed" else F.sha2(c.cast("binary"), 256)


def fallback_id(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", *parts).cast("binary"))


def slug(c: Column) -> Column:
    """Lower-case letters, digits and ideographs joined by hyphens; null if none is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9一-鿿]+", "-"), "^-+|-+$", ""), F.lit(""))


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """The compatibility form of texts, for which Spark has no function."""
    return values.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def file_name(title: Column) -> Column:
    """A title in compatibility form as a file's name: forbidden characters are spaces; null and blank give an empty one."""
    t = F.regexp_replace(nfkc(F.coalesce(title, F.lit(""))), r'[\\/:*?"<>|]', " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def author(c: Column) -> Column:
    """An author's name without mark, @ and closing punctuation; what is no name gives null."""
    t = F.trim(F.regexp_replace(collapse(c), r"^(?i)(?:原创|转载)?\s*(?:作者|文|撰文|By)\s*[:：]\s*", ""))
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"^@\s*", ""), r"[，,。.!！?？;；:：\s]+$", ""))
    shell = t.rlike(r"^(?i)(?:微信扫一扫|使用小程序|向上滑动看下一个|点击下方按钮|访问原文章)$")
    bad = t.rlike(r"(?i)https?://") | t.rlike(r"^(?i)data-[a-z0-9_-]+$") | shell | t.rlike(r"^\d{4}[/.-]\d{1,2}[/.-]\d{1,2}") | (t.rlike("[。！？]") & (F.length(t) > 20))
    return F.when((t != "") & (F.length(t) <= 60) & ~bad, t)


def byline_author(c: Column) -> Column:
    """The author that a line names after a mark and a colon, or after by and a space."""
    t = collapse(c)
    found = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    return author(F.coalesce(found(r"^(?i)(?:文|作者|撰文|By)\s*[:：]\s*(.+)$"), found(r"^(?i)(?:作者|By)\s+(.+)$")))


#: Fixed value: what ends a text that was cut.
TRUNCATED = "\n\n[内容过长，已截断]"


def body_text(c: Column) -> Column:
    """A text with line feeds alone, at most one blank line and no white space at its ends; blank gives null."""
    t = F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\n{3,}", "\n\n")
    return F.nullif(F.regexp_replace(t, r"^\s+|\s+$", ""), F.lit(""))


def summary_input(content: Column, excerpt: Column, title: Column, author: Column, published: Column, url: Column) -> Column:
    """source and text that a summary is made from: content up to 12,000 characters, else excerpt up to 1,500, else metadata."""

    def cut(c: Column, most: int) -> Column:
        return F.when(F.length(c) > most, F.concat(F.regexp_replace(F.left(c, F.lit(most)), r"\s+$", ""), F.lit(TRUNCATED))).otherwise(c)

    line = lambda mark, c: F.concat(F.lit(mark), F.when(c != "", c))
    day = F.date_format(published, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    told = body_text(F.concat_ws("\n", F.concat(F.lit("标题："), F.coalesce(title, F.lit(""))), line("作者：", author), F.concat(F.lit("发布时间："), day), line("来源链接：", url)))
    whole, short = body_text(content), body_text(excerpt)
    source = F.when(whole.isNotNull(), "content").when(short.isNotNull(), "excerpt").when(told.isNotNull(), "metadata")
    return F.struct(source.alias("source"), F.coalesce(cut(whole, 12_000), cut(short, 1_500), told).alias("text"))


def clean_summary(c: Column) -> Column:
    """A summary on one line without quotes around it, at most 180 characters; blank gives null."""
    t = F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "^[\"'“”]+|[\"'“”]+$", ""))
    return F.nullif(F.rtrim(F.left(t, F.lit(180))), F.lit(""))


def json_string(c: Column) -> Column:
    """A string as JSON writes it, with its quotes."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def yaml_line(key: str, value: Column, text: bool = True) -> Column:
    shown = json_string(value) if text else value.cast("string")
    return F.concat(F.lit(f"{key}: "), F.when(value.isNull(), "null").otherwise(shown))


def yaml_list(key: str, values: Column) -> Column:
    items = F.array_join(F.transform(values, lambda v: F.concat(F.lit("\n  - "), json_string(v))), "")
    return F.when(F.size(values) > 0, F.concat(F.lit(f"{key}:"), items)).otherwise(f"{key}: []")


def quoted(c: Column) -> Column:
    return F.regexp_replace(c, "(?m)^", "> ")


def paragraph_html(c: Column) -> Column:
    """Paragraphs of a plain text as HTML."""
    parts = F.filter(F.transform(F.split(c, "\n{2,}"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.lit("<p>"), F.replace(escape_html(x), F.lit("\n"), F.lit("<br />")), F.lit("</p>"))), "")


def markdown_text(c: Column) -> Column:
    """Plain text of Markdown: images go, links, emphasis, headings, quotes and list marks leave their text."""
    for pattern, to in ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^[ \t]{0,3}(?:#{1,6}|>|[-*+]|\d+\.)[ \t]+", ""), (r"\*\*([^*]+)\*\*|__([^_]+)__", "$1$2"), (r"\*([^*\n]+)\*|`([^`\n]+)`", "$1$2")):
        c = F.regexp_replace(c, pattern, to)
    return readable_text(c)


def categories(c: Column) -> Column:
    """A list of categories from text: split at commas and line feeds, folded, the first spelling of each kept in order."""
    return distinct_folded(F.filter(F.transform(F.split(c, "[\n,，]"), lambda x: collapse(x)), lambda x: x.isNotNull()))


def category_key(c: Column) -> Column:
    """What categories are compared by: case and white space folded, and review counts as reviews."""
    k = F.lower(collapse(c))
    return F.when(k == "review", "reviews").otherwise(k)


def distinct_folded(values: Column) -> Column:
    """The first of each value that differs only in case, in order."""
    none = F.array().cast("array<string>")
    return F.aggregate(values, none, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))


def categories_match(entry: Column, include: Column) -> Column:
    """Whether an entry's categories meet a source's; an empty list lets all pass."""
    return F.coalesce(F.size(include) <= 0, F.lit(True)) | F.coalesce(F.arrays_overlap(F.transform(entry, category_key), F.transform(include, category_key)), F.lit(False))
