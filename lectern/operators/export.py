"""Exports: Markdown, notes and HTML of documents, and batches of them, as one row for each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.markdown import html_markdown
from lectern.functions.text import collapse, escape_html, file_name, quoted, yaml_line, yaml_list
from lectern.operators.dedupe import numbered

_BASE = ["title", "source_url", "canonical_url", "author", "published_at"]
_LAST = [("document_type", "type"), ("ingestion_status", "ingestion_status")]
#: Headings, marks and notes of exported files.
SUMMARY_HEADING, HIGHLIGHTS_HEADING, BODY_HEADING = "## AI 摘要", "## 高亮与批注", "## 正文"
NO_HIGHLIGHTS, NO_BODY = "（暂无高亮）", "（无可导出的正文内容）"
HIGHLIGHT_MARK, NOTE_MARK, COLOR_MARK, CREATED_MARK = "### 高亮 ", "- 批注：", "- 颜色：", "- 创建时间："
HTML_ROWS = [
    ("作者", "author"), ("发布时间", "published_at"), ("原始链接", "source_url"), ("规范链接", "canonical_url"), ("文档类型", "type"), ("抓取状态", "ingestion_status"),
]
EXPORTED_ROW = "导出时间"
#: What follows a title in a file's name.
EXTENSIONS = {"markdown": ".md", "note": ".obsidian.md", "html": ".html"}


def iso(c: Column) -> Column:
    """A timestamp as ISO text with milliseconds, in UTC; the session's zone must be UTC."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _dated(docs: DataFrame) -> DataFrame:
    """docs with published_at as text."""
    return docs.withColumn("published_at", iso(F.col("published_at"))) if docs.schema["published_at"].dataType.typeName().startswith("timestamp") else docs


def _ends(c: Column) -> Column:
    """A text without white space at its ends; blank gives null."""
    return F.when(c.rlike(r"\S"), F.regexp_replace(c, r"^\s+|\s+$", ""))


def front_matter(exported_at: str) -> Column:
    """YAML front matter of a document."""
    lines = [yaml_line(k, F.col(k)) for k in _BASE] + [yaml_line(k, F.col(c)) for k, c in _LAST]
    return F.concat_ws("\n", F.lit("---"), *lines, yaml_line("exported_at", F.lit(exported_at)), F.lit("---"))


def note_matter(exported_at: str) -> Column:
    """Front matter of a note, with reading state, origin and tags (an array of slugs)."""
    progress = F.least(F.greatest(F.floor(F.coalesce("reading_progress", F.lit(0.0)) + 0.5), F.lit(0)), F.lit(100)).cast("int")
    lines = [yaml_line(k, F.col(k)) for k in _BASE] + [yaml_line(k, F.col(c)) for k, c in _LAST]
    lines += [yaml_line("read_state", F.col("read_state")), yaml_line("reading_progress", progress, False), yaml_line("is_favorite", F.col("is_favorite"), False), yaml_line("content_origin", F.col("origin_label")), yaml_list("tags", F.col("tags"))]
    return F.concat_ws("\n", F.lit("---"), *lines, yaml_line("exported_at", F.lit(exported_at)), F.lit("---"))


def markdown_body() -> Column:
    """A document's HTML as Markdown, else its plain text; empty if it has neither."""
    return F.coalesce(html_markdown(_ends(F.col("content_html"))), _ends(F.col("plain_text")), F.lit(""))


def _name(kind: str) -> Column:
    title = file_name(F.col("title"))
    return F.concat(F.when(title == "", F.concat(F.lit("document-"), F.col("id").cast("string"))).otherwise(title), F.lit(EXTENSIONS[kind]))


def _file(kind: str, body: Column) -> list[Column]:
    return [F.col("id"), _name(kind).alias("name"), F.regexp_replace(body, r"\s+$", "").alias("body")]


def markdown(docs: DataFrame, exported_at: str) -> DataFrame:
    """id, name and body of each document's Markdown file: front matter and text."""
    return _dated(docs).select(*_file("markdown", F.concat_ws("\n\n", front_matter(exported_at), markdown_body())))


def highlight_sections(highlights: DataFrame) -> DataFrame:
    """id and section of the highlights of each document, numbered by time; those without a quote are left out."""
    quote = _ends(F.col("quote_text"))
    entry_of = F.struct("created_at", F.col("id").alias("h"), quote.alias("quote"), _ends(F.col("note")).alias("note"), _ends(F.col("color")).alias("color"))
    rows = highlights.where(quote.isNotNull()).groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_list(entry_of)).alias("hs"))

    def entry(h: Column, i: Column) -> Column:
        return F.concat_ws(
            "\n", F.concat(F.lit(HIGHLIGHT_MARK), (i + 1).cast("string")), quoted(h["quote"]), F.concat(F.lit(NOTE_MARK), h["note"]),
            F.concat(F.lit(COLOR_MARK), h["color"]), F.concat(F.lit(CREATED_MARK), iso(h["created_at"])),
        )

    return rows.select("id", F.concat(F.lit(f"{HIGHLIGHTS_HEADING}\n\n"), F.array_join(F.transform("hs", entry), "\n\n")).alias("section"))


def notes(docs: DataFrame, highlights: DataFrame, exported_at: str) -> DataFrame:
    """id, name and body of each document's note: front matter, summary (if it has one), highlights and text."""
    out = _dated(docs).join(highlight_sections(highlights), "id", "left").withColumn("_body", markdown_body())  # used twice, found once
    summary = F.concat(F.lit(f"{SUMMARY_HEADING}\n\n"), _ends(F.col("ai_summary")))
    text = F.when(F.col("_body") == "", NO_BODY).otherwise(F.col("_body"))
    body = F.concat_ws(
        "\n\n", note_matter(exported_at), summary, F.coalesce("section", F.lit(f"{HIGHLIGHTS_HEADING}\n\n{NO_HIGHLIGHTS}")), F.concat(F.lit(f"{BODY_HEADING}\n\n"), text)
    )
    return out.select(*_file("note", body))


def html(docs: DataFrame, exported_at: str) -> DataFrame:
    """id, name and body of each document's HTML file; metadata that is missing has no row, a text without HTML is preformatted."""

    def row(label: str, c: Column) -> Column:
        value = F.nullif(c, F.lit(""))
        return F.coalesce(F.concat(F.lit(f"<dt>{label}</dt><dd>"), escape_html(value), F.lit("</dd>")), F.lit(""))

    rows = F.concat(*[row(label, F.col(c).cast("string")) for label, c in HTML_ROWS], row(EXPORTED_ROW, F.lit(exported_at)))
    title = escape_html(F.coalesce("title", F.lit("")))
    plain = F.concat(F.lit('<pre class="document-export__plain-text">'), escape_html(_ends(F.col("plain_text"))), F.lit("</pre>"))
    text = F.coalesce(_ends(F.col("content_html")), plain, F.lit(""))
    body = F.concat(
        F.lit('<!doctype html>\n<html lang="zh-CN">\n<head>\n  <meta charset="utf-8" />\n  <title>'), title, F.lit("</title>\n</head>\n<body>\n  <main>\n    <header>\n      <h1>"),
        title, F.lit("</h1>\n      <dl>"), rows, F.lit("</dl>\n    </header>\n    <article>"), text, F.lit("</article>\n  </main>\n</body>\n</html>"),
    )
    return _dated(docs).select(*_file("html", body))


def files_of(docs: DataFrame, highlights: DataFrame, kind: str, exported_at: str) -> DataFrame:
    """id, name and body of each document's file of a kind: markdown, note or html."""
    if kind == "note":
        return notes(docs, highlights, exported_at)
    return markdown(docs, exported_at) if kind == "markdown" else html(docs, exported_at)


def batch(ids: DataFrame, docs: DataFrame, highlights: DataFrame, kind: str, exported_at: str, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """Files of the documents asked for (id, pos), each name once, and the ids that are missing (id, pos). The number of ids is the
    feature's limit. Of equal names the first asked for keeps it, later ones are numbered before the extension."""
    asked = ids.groupBy("id").agg(F.min("pos").alias("pos")).orderBy("pos", "id").limit(most)
    end = EXTENSIONS[kind]
    files = files_of(docs.join(asked.select("id"), "id", "left_semi"), highlights, kind, exported_at).join(asked, "id")
    rows = files.select(F.struct("pos", "id").alias("id"), F.substr("name", F.lit(1), F.length("name") - len(end)).alias("base"), "body")
    named = numbered(rows, "base", "unique", "%s (%d)")
    return named.select("id.id", F.concat("unique", F.lit(end)).alias("name"), "body"), asked.join(docs.select("id"), "id", "left_anti")


def write_plan(members: DataFrame, path: str) -> None:
    """Full duplicate groups as JSON, before a merge."""
    members.write.json(path)
