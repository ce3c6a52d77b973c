"""Markdown columns: HTML as Markdown, and Markdown as HTML and text."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from lectern.functions.columns import let
from lectern.functions.text import ENTITIES, block_excerpt, text_hash

#: Names of inline elements, the elements and what stands for them, in the order in which they are replaced.
_INLINE = [
    ("img", r"(?is)<img\b(?=[^>]*\bsrc=\"([^\"]*)\")(?=[^>]*\balt=\"([^\"]*)\")[^>]*>", "![$2]($1)"), ("img", r"(?is)<img\b[^>]*\bsrc=\"([^\"]*)\"[^>]*>", "![]($1)"),
    ("strong b", r"(?is)<(?:strong|b)(?:\s[^>]*)?>\s*(.*?)\s*</(?:strong|b)>", "**$1**"), ("em i", r"(?is)<(?:em|i)(?:\s[^>]*)?>\s*(.*?)\s*</(?:em|i)>", "_$1_"), ("del s", r"(?is)<(?:del|s)(?:\s[^>]*)?>\s*(.*?)\s*</(?:del|s)>", "~~$1~~"),
    ("a", r"(?is)<a\b[^>]*\bhref=\"([^\"]*)\"[^>]*>\s*(.*?)\s*</a>", "[$2]($1)"),
]
#: Elements that stand between blank lines.
_BLOCKS = "p div section article figure figcaption table thead tbody tr"
#: Signs that stand for the ends of quotes and of preformatted text while other elements are replaced; texts lose them.
_QUOTE, _CODE, _END = "", "", ""


def _if(found: Column, c: Column, then: Callable[[Column], Column]) -> Column:
    """then(c) where found is true, else c; c is computed once."""
    return let(c, lambda x: F.when(found, then(x)).otherwise(x))


def _untagged(c: Column, source: Column) -> Column:
    """c without tags, and with entities decoded if source, of which c was made, has any."""

    def decoded(t: Column) -> Column:
        for name, char in [*[e for e in ENTITIES if e[0] != "amp"], ("amp", "&")]:
            t = F.regexp_replace(t, f"(?i)&{name};", char)
        return t

    return _if(F.contains(source, F.lit("&")), F.regexp_replace(c, r"(?s)<[^>]+>", ""), decoded)


def _squeezed(c: Column) -> Column:
    """Blank lines one at a time, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[ \t]*\n[ \t]*\n\s*", "\n\n"), r"^\s+|\s+$", ""), "\n{3,}", "\n\n")


def _lists(c: Column) -> Column:
    """Items of ordered lists with their numbers, and those of others with a star."""
    item = r"(?is)<li(?:\s[^>]*)?>\s*(.*?)\s*</li>"

    def ordered(piece: Column) -> Column:
        items = F.transform(F.regexp_extract_all(piece, F.lit(item), F.lit(1)), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
        return F.concat(F.lit("\n\n"), F.array_join(items, "\n"), F.lit("\n\n"))

    pieces = F.split(c, r"(?i)(?=<ol[\s>])|(?<=</ol>)")
    told = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("(?i)^<ol"), ordered(p)).otherwise(p)), "")
    return F.regexp_replace(F.regexp_replace(told, r"(?is)</?ul(?:\s[^>]*)?>", "\n\n"), item + r"\s*", "* $1\n")


def html_markdown(html: Column) -> Column:
    """Markdown of clean HTML: headings, paragraphs, lists, quotes, preformatted text, rules, links, images and emphasis; null for null.

    Elements of one kind inside each other count as one; other elements leave their text. A kind of elements is only replaced where the
    text has a tag of it: no replacement makes tags.
    """
    t = F.translate(html, _QUOTE + _CODE + _END, "")

    def has(tags: Column, *names: str) -> Column:
        return F.arrays_overlap(tags, F.array(*map(F.lit, names)))

    # preformatted text first: its lines stay as they are
    pre = r"(?is)<pre(?:\s[^>]*)?>\s*(?:<code(?:\s[^>]*)?>)?\n?(.*?)\s*(?:</code>)?\s*</pre>"
    t = let(t, lambda x: F.when(x.rlike("<[Pp][Rr][Ee]"), F.regexp_replace(x, pre, f"\n\n{_CODE}$1{_END}\n\n")).otherwise(x))

    def prose(piece: Column) -> Column:
        return let(F.array_distinct(F.transform(F.regexp_extract_all(piece, F.lit("</?([A-Za-z][A-Za-z0-9]*)"), F.lit(1)), F.lower)), lambda tags: replaced(piece, tags))

    def replaced(piece: Column, tags: Column) -> Column:
        def each(p: Column, names: str, pattern: str, to: str) -> Column:
            return _if(has(tags, *names.split()), p, lambda x: F.regexp_replace(x, pattern, to))

        p = F.regexp_replace(piece, r"\s{2,}|[\t\n\x0B\f\r]", " ")
        p = each(p, "code", r"(?is)<code(?:\s[^>]*)?>(.*?)</code>", "`$1`")
        for name, pattern, to in _INLINE:
            p = each(p, name, pattern, to)
        p = each(each(p, "br", r"(?i)\s*<br\s*/?>\s*", "  \n"), "hr", r"(?i)<hr\s*/?>", "\n\n---\n\n")
        for level in range(1, 7):
            p = each(p, f"h{level}", rf"(?is)<h{level}(?:\s[^>]*)?>\s*(.*?)\s*</h{level}>", f"\n\n{'#' * level} $1\n\n")
        p = _if(has(tags, "li", "ul", "ol"), p, _lists)
        p = each(p, _BLOCKS, rf"(?is)\s*</?(?:{_BLOCKS.replace(' ', '|')})(?:\s[^>]*)?>\s*", "\n\n")
        p = each(p, "blockquote", r"(?is)<blockquote(?:\s[^>]*)?>\s*(.*?)\s*</blockquote>", f"\n\n{_QUOTE}$1{_END}\n\n")

        def quote(x: Column) -> Column:
            return F.when(x.startswith(_QUOTE), F.regexp_replace(_squeezed(F.translate(x, _QUOTE + _END, "")), "(?m)^", "> ")).otherwise(x)

        parts = F.transform(F.split(p, f"(?={_QUOTE})|(?<={_END})"), quote)
        return F.array_join(parts, "")

    def piece(x: Column) -> Column:
        code = F.concat(F.lit("```\n"), F.translate(x, _CODE + _END, ""), F.lit("\n```"))
        return _untagged(F.when(x.startswith(_CODE), code).otherwise(prose(x)), x)

    pieces = F.split(t, f"(?={_CODE})|(?<={_END})")
    marked = F.transform(pieces, lambda x: F.struct(x.startswith(_CODE).alias("code"), let(x, piece).alias("t")))
    told = F.transform(marked, lambda m: F.when(m["code"], m["t"]).otherwise(_squeezed(m["t"])))
    return F.array_join(F.filter(told, lambda x: x != ""), "\n\n")


#: How blocks of Markdown begin, and what links and images look like.
HEADING, MARKS = re.compile(r"#{1,6}\s+"), {"ul": re.compile(r"[-*]\s+"), "quote": re.compile(r">\s?")}
_URL = r"https?:\/\/(?:[^\s()]|\([^)\s]*\))+"
IMAGE, LINK = re.compile(rf"!\[([^\]]*)\]\(({_URL})\)"), re.compile(rf"\[([^\]]+)\]\(({_URL})\)")
BOLD, ITALIC = re.compile(r"\*\*([^*]+)\*\*"), re.compile(r"(^|[^*])\*([^*]+)\*")


def line_blocks(text: str) -> Iterator[tuple[str, list[str]]]:
    """kind (h1 to h6, ul, quote or p) and parts of each block, in one pass over the lines.

    A heading is a line; a list or a quote goes on while its mark begins lines, which may then be indented; all else is a paragraph, which
    goes on to the next blank line whatever its lines look like.
    """
    kind, parts = None, []
    for line in [*text.replace("\r\n", "\n").strip().split("\n"), ""]:
        inner, line = line.strip(), line.rstrip()
        if kind == "p" and inner:
            parts.append(inner)
            continue
        mark = MARKS[kind].match(inner) if kind in MARKS else None
        if mark:
            parts.append(inner[mark.end() :])
            continue
        if kind:
            yield kind, parts
        kind, parts = None, []
        if HEADING.match(line):
            depth = len(line) - len(line.lstrip("#"))
            yield f"h{depth}", [line[depth:].strip()]
        elif inner:
            kind = next((k for k, m in MARKS.items() if m.match(line)), "p")
            parts = [MARKS[kind].sub("", inner, count=1) if kind in MARKS else inner]


def _collapsed(text: str) -> str:
    return " ".join(text.split())


def inline_html(text: str) -> str:
    """A line's images, links and emphasis as HTML."""
    made = html.escape(text).replace("&#x27;", "&#39;")
    made = IMAGE.sub(lambda m: f'<img src="{m[2]}" alt="{html.escape(_collapsed(m[1]))}" />', made)
    made = LINK.sub(r'<a href="\2" target="_blank" rel="noreferrer">\1</a>', made)
    return ITALIC.sub(r"\1<em>\2</em>", BOLD.sub(r"<strong>\1</strong>", made))


def inline_text(text: str) -> str:
    """A line without its marks."""
    made = LINK.sub(r"\1", IMAGE.sub(lambda m: _collapsed(m[1]), text))
    return _collapsed(ITALIC.sub(r"\1\2", BOLD.sub(r"\1", made)))


def _block(kind: str, parts: list[str]) -> tuple[str, str]:
    """A block's HTML and text."""
    if kind == "ul":
        return f"<ul>{''.join(f'<li>{inline_html(x)}</li>' for x in parts)}</ul>", "\n".join(filter(None, map(inline_text, parts)))
    text = " ".join(parts)
    before, after = ("<blockquote><p>", "</p></blockquote>") if kind == "quote" else (f"<{kind}>", f"</{kind}>")
    return before + inline_html(text) + after, inline_text(text)


@F.pandas_udf(StructType().add("content_html", StringType()).add("texts", ArrayType(StringType())))
def _rendered(values: pd.Series) -> pd.DataFrame:
    made = [[_block(*b) for b in line_blocks(x)] if isinstance(x, str) else None for x in values]
    return pd.DataFrame({"content_html": ["".join(h for h, _ in x) if x is not None else None for x in made], "texts": [[t for _, t in x if t] if x is not None else None for x in made]})


def rendered(markdown: Column) -> Column:
    """content_html, plain_text, excerpt and text_hash of Markdown; null for blank texts. Lines are folded by a helper over Arrow batches."""

    def fields(r: Column) -> Column:
        text = F.array_join(r["texts"], "\n\n")
        return F.struct(r["content_html"].alias("content_html"), text.alias("plain_text"), block_excerpt(r["texts"]).alias("excerpt"), text_hash(text).alias("text_hash"))

    return F.when(markdown.rlike(r"\S"), let(_rendered(markdown), fields))
