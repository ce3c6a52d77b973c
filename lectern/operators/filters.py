"""Filters over a library of documents. Each clause is a Column; where_all() joins those that are set."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import readable_units
from lectern.functions.urls import WECHAT_HOST, hostname


@dataclass(frozen=True)
class ListQuery:
    """Arguments of a listing; None leaves a clause out."""

    surface: str = "source"
    q: str | None = None
    type: str | None = None
    read_state: str | None = None
    is_favorite: bool | None = None
    tag: str | None = None
    source_id: str | None = None
    feed_id: str | None = None
    domain: str | None = None
    unknown_source: bool = False
    sort: str = "latest"
    page: int = 1
    page_size: int = 20


def where_all(*clauses: Column | None) -> Column:
    """All clauses that are set; true if none is."""
    return reduce(Column.__and__, [c for c in clauses if c is not None], F.lit(True))


def text_search(q: str) -> Column:
    """A literal, case-insensitive substring of title or URLs, or of excerpt and text where ingestion did not fail."""
    has = lambda c: F.coalesce(F.contains(F.lower(F.col(c)), F.lit(q.lower())), F.lit(False))
    deep = F.coalesce(F.col("ingestion_status") != "FAILED", F.lit(False)) & (has("excerpt") | has("plain_text"))
    return has("title") | has("source_url") | has("canonical_url") | deep


def on_surface(surface: str, read_state: str | None) -> Column | None:
    """The reading surface has documents that were opened for reading and, unless a state is asked for, are not read."""
    if surface != "reading":
        return None
    opened = F.col("entered_reading_at").isNotNull()
    return opened if read_state else opened & (F.col("read_state") != "READ")


def from_domain(host: str) -> Column:
    """URLs that start with the host under either scheme; as a prefix, so longer hosts that start with it match too."""
    return reduce(Column.__or__, [F.coalesce(F.col(c).startswith(f"{s}://{host}"), F.lit(False)) for c in ("source_url", "canonical_url") for s in ("https", "http")])


def from_nowhere() -> Column:
    return reduce(Column.__and__, [F.col(c).isNull() for c in ("source_id", "feed_id", "source_url", "canonical_url")])


def select_documents(docs: DataFrame, query: ListQuery, tags: DataFrame | None = None) -> DataFrame:
    """docs that meet a query; tags (document_id, slug) is read only where the query names a tag."""
    eq = lambda c, v: None if v is None else F.col(c) == v
    out = docs.where(
        where_all(
            eq("source_id", query.source_id), eq("feed_id", query.feed_id), eq("type", query.type), eq("read_state", query.read_state), eq("is_favorite", query.is_favorite),
            from_domain(query.domain) if query.domain else None, from_nowhere() if query.unknown_source else None, on_surface(query.surface, query.read_state), text_search(query.q) if query.q else None,
        )
    )
    return with_tag(out, tags, query.tag) if query.tag else out


def with_tag(docs: DataFrame, tags: DataFrame, slug: str) -> DataFrame:
    """docs that have the tag, whatever its case."""
    return docs.join(tags.where(F.lower("slug") == slug.lower()).select(F.col("document_id").alias("id")), "id", "left_semi")


def recent(latest: Column, now: Column, days: int = 7) -> Column:
    """Less than so many days old; a time in the future counts as now."""
    age = F.greatest(F.lit(0), F.unix_micros(now) - F.unix_micros(latest))
    return age < days * 86_400_000_000


def published_since(bound: Column) -> Column:
    """Dated entries from the bound on, and all undated ones."""
    return F.col("published_at").isNull() | bound.isNull() | (F.col("published_at") >= bound)


def _trimmed(name: str) -> Column:
    """A column without white space at its ends; null where nothing is left."""
    return F.nullif(F.regexp_replace(name, r"^\s+|\s+$", ""), F.lit(""))


def summary_due(first: bool) -> Column:
    """Documents with a text or an excerpt for a summary: never tried, or for a retry any without one that is not waiting."""
    ready, none = F.col("ingestion_status") == "READY", F.col("ai_summary").isNull()
    text = F.coalesce(_trimmed("plain_text"), _trimmed("excerpt")).isNotNull()
    state = F.col("ai_summary_status")
    return ready & none & text & (state.isNull() if first else ~state.eqNullSafe("PENDING"))


def highlightable() -> Column:
    return (F.col("ingestion_status") == "READY") & (F.coalesce(_trimmed("plain_text"), F.col("content_html")).isNotNull())


def transcript_due() -> Column:
    """Documents whose video is unknown, or whose own transcript is not there, not ready, empty or without a text."""
    ready = F.col("video_provider").isNotNull() & F.col("video_url").isNotNull() & (F.col("transcript_source") == "NATIVE") & (F.col("transcript_status") == "READY")
    whole = (F.coalesce(F.size("transcript_segments"), F.lit(0)) > 0) & _trimmed("plain_text").isNotNull()
    return ~F.coalesce(ready & whole, F.lit(False))


def preview() -> Column:
    """Summary or excerpt, whichever is not blank first; none for failed documents."""
    return F.when(F.col("ingestion_status") != "FAILED", F.coalesce(_trimmed("ai_summary"), _trimmed("excerpt")))


#: Labels and notes of a document's lead.
LEAD_LABEL, WAITING_LABEL, FAILED_LABEL = "原文导语", "AI 摘要生成中", "AI 摘要未就绪"
WAITING_NOTE, FAILED_NOTE = "AI 摘要正在生成中。", "AI 摘要暂时没有生成出来。"


def lead() -> Column:
    """Label, text and note that open a document: its excerpt, or else the state of its summary; nothing for failed documents."""
    excerpt = _trimmed("excerpt")
    waiting, failed = F.col("ai_summary_status") == "PENDING", F.col("ai_summary_status") == "FAILED"
    note = F.when(waiting, WAITING_NOTE).when(failed, FAILED_NOTE)
    made = lambda label, text, note: F.struct(label.cast("string").alias("label"), text.cast("string").alias("text"), note.cast("string").alias("note"))
    none = F.lit(None)
    return (
        F.when(F.col("ingestion_status") == "FAILED", made(none, none, none))
        .when(excerpt.isNotNull(), made(F.lit(LEAD_LABEL), excerpt, note))
        .when(waiting, made(F.lit(WAITING_LABEL), F.lit(WAITING_NOTE), none))
        .when(failed, made(F.lit(FAILED_LABEL), F.lit(FAILED_NOTE), none))
        .otherwise(made(none, none, none))
    )


#: Codes of capture errors that have a state of their own.
FAILURE_CODES = [
    "VIDEO_SUBTITLE_UNAVAILABLE", "VIDEO_METADATA_FETCH_FAILED", "VIDEO_FETCH_FAILED", "VIDEO_URL_UNSUPPORTED", "SOURCE_VERIFICATION_REQUIRED",
    "EXTRACTION_EMPTY", "EXTRACTION_UNREADABLE",
]
#: What messages of unreadable pages say of moved accounts and of share pages.
MIGRATION_MESSAGE, SHELL_MESSAGE = "迁移|跳转说明", "分享壳页面|壳页面|异常或壳页面"


def failure_class(code: Column, message: Column) -> Column:
    """A failed document's state by its error's code; unreadable ones by their message also: MIGRATION_NOTICE or SHARE_SHELL. Others are UNKNOWN."""
    unreadable = code == "EXTRACTION_UNREADABLE"
    return (
        F.when(unreadable & message.rlike(MIGRATION_MESSAGE), "MIGRATION_NOTICE")
        .when(unreadable & message.rlike(SHELL_MESSAGE), "SHARE_SHELL")
        .when(code.isin(FAILURE_CODES), code)
        .otherwise("UNKNOWN")
    )


def reading_view() -> Column:
    return F.when(F.col("is_favorite"), "starred").when(F.col("read_state") == "READ", "archive").otherwise("queue")


def facet_enabled(source_url: Column, item_urls: Column, host: str) -> Column:
    """Whether a source's own URL or one of its items' is on the facet's host."""
    return F.coalesce(hostname(source_url) == host, F.lit(False)) | F.exists(item_urls, lambda u: F.coalesce(hostname(u) == host, F.lit(False)))


#: What pages say that are no content.
VERIFICATION_TEXT = "(?i)verify you are human|security check|enable javascript and cookies|checking if the site connection is secure|captcha|安全验证|请完成验证|当前环境异常|完成验证后即可继续访问"
SHELL_TEXT = "(?i)access denied|403 forbidden|404 not found|page not found|temporarily unavailable|service unavailable|redirecting|正在跳转|请先登录|login required|sign in to continue"
MESSENGER_VERIFICATION_TEXT = "当前环境异常|完成验证后即可继续访问|去验证|环境异常"
MESSENGER_SHELL_TEXT = "微信扫一扫|使用小程序|向上滑动看下一个|使用完整服务|在小说阅读器|去阅读|沉浸阅读"
MIGRATION_TEXT = "账号已迁移|该公众号已迁移|已迁移至新的账号|原账号已回收|若需访问原文章链接|访问原文章|点击下方按钮|在小说阅读器中沉浸阅读"
#: The path of the messenger's verification page, its content elements, and those of its share pages.
VERIFICATION_PATH = "/mp/wappoc_appmsgcaptcha"
_WITH = r"""(?i)<[a-z][^>]*\b{0}\s*=\s*["']?(?:[^"'>]*\s)?(?:{1})["'\s>]"""
CONTENT_ELEMENTS = (_WITH.format("id", "img-content|js_content"), _WITH.format("class", "rich_media_content"))
SHARE_ELEMENTS = (_WITH.format("class", "img_swiper_area|share_media_swiper"), _WITH.format("id", "js_jump_wx_qrcode_dialog"))
SHARE_ARTICLE = r"""(?i)<[a-z](?=[^>]*\bid\s*=\s*["']?js_article["'\s>])(?=[^>]*\bclass\s*=\s*["']?(?:[^"'>]*\s)?share_content_page["'\s>])"""
#: Kinds of pages and the error code of each.
KIND_CODES = {
    "messenger_verification": "SOURCE_VERIFICATION_REQUIRED", "share_shell": "EXTRACTION_UNREADABLE", "migration": "EXTRACTION_UNREADABLE",
    "verification": "SOURCE_VERIFICATION_REQUIRED", "shell": "EXTRACTION_UNREADABLE",
}


def page_kind(html: Column, text: Column, url: Column, request_url: Column | None = None, inline: Column | None = None) -> Column:
    """The kind of a page that is no content, one of KIND_CODES; null for readable ones.

    text is the plain text of the body, of which the first 1,500 characters count; inline tells whether the page has its text in
    a script. The messenger's pages are told by host, path, elements and phrases; other pages by phrases in short texts.
    """
    t = F.left(text, F.lit(1500))
    here = F.coalesce(hostname(url) == WECHAT_HOST, F.lit(False))
    asked = F.coalesce(hostname(request_url) == WECHAT_HOST, F.lit(False)) if request_url is not None else F.lit(False)
    path = F.regexp_extract(url, r"^(?i)https?://[^/?#]+([^?#]*)", 1) == VERIFICATION_PATH
    checked = (here | asked) & (F.coalesce(path, F.lit(False)) | t.rlike(MESSENGER_VERIFICATION_TEXT) | html.rlike("(?i)wappoc_appmsgcaptcha"))
    content = html.rlike(CONTENT_ELEMENTS[0]) | html.rlike(CONTENT_ELEMENTS[1])
    shared = here & ~content & (html.rlike(SHARE_ARTICLE) | html.rlike(SHARE_ELEMENTS[0]) | html.rlike(SHARE_ELEMENTS[1]))
    shared = shared if inline is None else shared & ~inline
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    moved = here & ~content & (readable_units(t) < 180) & (title.rlike(MIGRATION_TEXT) | t.rlike(MIGRATION_TEXT))
    return (
        F.when(checked, "messenger_verification").when(shared, "share_shell").when(moved, "migration")
        .when(t.rlike(VERIFICATION_TEXT) & (F.length(t) < 800), "verification").when(t.rlike(SHELL_TEXT) & (F.length(t) < 600), "shell")
    )


def unreadable_extract(url: Column, text: Column) -> Column:
    """Whether what was extracted of a page of the messenger only says that an account moved, or is the shell of a share page."""
    units = readable_units(text)
    here = F.coalesce(hostname(url) == WECHAT_HOST, F.lit(False))
    return here & (((units < 180) & text.rlike(MIGRATION_TEXT)) | ((units < 80) & text.rlike(MESSENGER_SHELL_TEXT)))
