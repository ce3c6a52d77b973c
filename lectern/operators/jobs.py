"""Job logs, reading states, queues, bounds on dates, cleanup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.urls import WECHAT_HOST
from lectern.operators.filters import MESSENGER_VERIFICATION_TEXT, from_domain, summary_due
from lectern.operators.identity import UNKNOWN, origin_label
from lectern.operators.scans import with_last


def payload_error(payload: Column, message: Column) -> Column:
    """code and message of a failed job: those of its payload if it has both, else CAPTURE_FAILED and the job's message."""
    code, said = F.get_json_object(payload, "$.error.code"), F.get_json_object(payload, "$.error.message")
    whole = code.isNotNull() & said.isNotNull()
    return F.struct(F.when(whole, code).when(message.isNotNull(), "CAPTURE_FAILED").alias("code"), F.when(whole, said).otherwise(message).alias("message"))


def latest_failures(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """id and job_id of the latest failed job of each document, matched by its id or its URL. An unfinished job comes before finished ones.

    Two equi joins stand for the OR, which would be a nested loop. Jobs are reduced to the latest of each id and of each URL
    before they are joined, so a URL that many share gives each document one row.
    """
    order = F.struct(F.col("finished_at").isNull().alias("open"), "finished_at", "created_at", F.col("id").alias("job_id"))
    failed = jobs.where("status = 'FAILED'").select("document_id", "source_url", order.alias("o"))
    latest = lambda key: failed.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("o").alias("o"))
    by_id = docs.select("id").join(latest("document_id").withColumnRenamed("document_id", "id"), "id").select("id", "o")
    by_url = docs.select("id", "source_url").join(latest("source_url"), "source_url").select("id", "o")
    return by_id.union(by_url).groupBy("id").agg(F.max("o").alias("o")).select("id", F.col("o.job_id").alias("job_id"))


def outcomes(jobs: DataFrame) -> DataFrame:
    return jobs.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("generated", "failed", "skipped", "deferred")])


def queue_depth(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count_if(F.col("ai_summary_status") == "PENDING").alias("pending"))


def enqueue(docs: DataFrame, jobs: DataFrame, first: bool = True) -> DataFrame:
    """Ids of documents due for a summary that have no active job, oldest first."""
    active = jobs.where(F.col("status").isin("PENDING", "PROCESSING")).select(F.col("document_id").alias("id"))
    return docs.where(summary_due(first)).join(active, "id", "left_anti").orderBy("created_at", "id").select("id")


def reading_states(events: DataFrame) -> DataFrame:
    """document_id, entered_at, progress and read_state from events (document_id, ts, kind, progress) of kind open, progress and read.

    The first opening counts, the latest progress (clamped to 0 to 100), and a document once read has progress 100.
    """
    read = F.bool_or(F.col("kind") == "read")
    clamped = F.least(F.greatest(F.col("progress"), F.lit(0.0)), F.lit(100.0))
    last = F.max_by(F.when(F.col("kind") == "progress", clamped), F.when(F.col("kind") == "progress", F.struct("ts", "event_id")))
    out = events.groupBy("document_id").agg(F.min(F.when(F.col("kind") == "open", F.col("ts"))).alias("entered_at"), last.alias("p"), read.alias("read"))
    state = F.when(F.col("read"), "READ").when((F.col("p") > 0) & (F.col("p") < 100), "READING").otherwise("UNREAD")
    return out.select("document_id", "entered_at", F.when(F.col("read"), 100.0).otherwise(F.coalesce("p", F.lit(0.0))).alias("progress"), state.alias("read_state"))


def upper_bounds(pages: DataFrame) -> DataFrame:
    """id, bound and kind (BEFORE) of undated pages: the date of the earliest later-captured dated page of their host.

    pages has id, host, captured (µs) and published. A host may hold any part of the rows: it is scanned from the latest page down.
    """
    found = with_last(pages.select("id", "host", "captured", "published"), "host", "captured", "published", "bound", down=True)
    return found.where("published is null and bound is not null").select("id", "bound", F.lit("BEFORE").alias("kind"))


def host_bounds(docs: DataFrame) -> DataFrame:
    """upper_bounds() of documents (id, source_url, canonical_url, captured, published, ingestion_status, capture_kind).

    A host is the scheme and host with which a URL starts, as the source URL has it, else the canonical one. Failed documents get no
    bound, and only page and video captures (PAGE, VIDEO) give one.
    """
    start = lambda c: F.nullif(F.lower(F.regexp_extract(c, r"^(?i)https?://([^/?#]+)(?:[/?#]|$)", 1)), F.lit(""))
    host = F.coalesce(start("source_url"), start("canonical_url"))
    anchors = F.when(F.col("capture_kind").isin("PAGE", "VIDEO"), F.col("published"))
    rows = docs.where(host.isNotNull()).select("id", host.alias("host"), "captured", anchors.alias("published"), "ingestion_status", F.col("published").isNotNull().alias("dated"))
    found = with_last(rows, "host", "captured", "published", "bound", down=True)
    due = ~F.col("dated") & (F.col("ingestion_status") != "FAILED") & F.col("bound").isNotNull()
    return found.where(due).select("id", "bound", F.lit("BEFORE").alias("kind"))


def aliases(changes: DataFrame) -> DataFrame:
    """kind, value, name after a log of changes (kind, value, name, seq); a null name deletes."""
    return changes.groupBy("kind", "value").agg(F.max_by(F.struct("name"), "seq").alias("x")).select("kind", "value", "x.name").where("name is not null")


def export_overview(docs: DataFrame, highlights: DataFrame) -> DataFrame:
    """Numbers of starred, summarised and highlighted documents, in one pass."""
    marked = highlights.select(F.col("document_id").alias("id")).distinct().withColumn("m", F.lit(True))
    return docs.join(marked, "id", "left").agg(F.count_if("is_favorite").alias("starred"), F.count_if(F.col("ai_summary").isNotNull()).alias("summarised"), F.count_if(F.coalesce("m", F.lit(False))).alias("highlighted"))


#: The messenger's pages in URLs, and the error that a cleaned-up document's jobs get.
VERIFICATION_URL = "%/mp/wappoc_appmsgcaptcha%"
CLEANED_SHELL_TEXT = "微信扫一扫|使用小程序|向上滑动看下一个|使用完整服务"
CLEANUP_CODES = {
    "verification": ("SOURCE_VERIFICATION_REQUIRED", "来源站点触发验证或环境异常，当前无法稳定抓取正文。"),
    "share_shell": ("EXTRACTION_UNREADABLE", "来源站点返回了微信分享壳页面，无法提取可阅读正文。"),
}


def _verification() -> Column:
    said = lambda c: F.coalesce(F.col(c), F.lit("")).rlike(MESSENGER_VERIFICATION_TEXT)
    return F.coalesce(F.col("canonical_url").like(VERIFICATION_URL), F.lit(False)) | said("excerpt") | said("plain_text")


def _of_messenger(pattern: str) -> Column:
    at = lambda c: F.coalesce(F.col(c).like(pattern), F.lit(False))
    return (F.col("type") == "WEB_PAGE") & (at("source_url") | at("canonical_url"))


def invalid_documents(docs: DataFrame) -> DataFrame:
    """id and source_url of pages of the messenger that only ask for a verification, whatever their status (the first cleanup)."""
    return docs.where(_of_messenger(f"%{WECHAT_HOST}%") & _verification()).select("id", "source_url").distinct()


def cleanup_reason() -> Column:
    """Why a document that counts as ready is not readable, or null. Documents have a content, with plain_text and word_count, or neither."""
    shell = (F.coalesce("word_count", F.lit(0)) <= 30) & F.coalesce("plain_text", F.lit("")).rlike(CLEANED_SHELL_TEXT)
    reason = F.when(_verification(), "verification").when(shell, "share_shell")
    return F.when(_of_messenger(f"https://{WECHAT_HOST}/%") & (F.col("ingestion_status") == "READY") & F.col("has_content"), reason)


def with_contents(docs: DataFrame, contents: DataFrame) -> DataFrame:
    """docs with plain_text and word_count of their contents (document_id, plain_text, word_count), and whether they have one."""
    own = contents.select(F.col("document_id").alias("id"), "plain_text", "word_count", F.lit(True).alias("has_content"))
    return docs.drop("plain_text", "word_count").join(own, "id", "left").withColumn("has_content", F.coalesce("has_content", F.lit(False)))


def unreadable_documents(docs: DataFrame, contents: DataFrame) -> DataFrame:
    """id, source_url and reason of the documents that the second cleanup resets."""
    return with_contents(docs, contents).withColumn("reason", cleanup_reason()).where("reason is not null").select("id", "source_url", "reason")


def cleanup_histogram(bad: DataFrame) -> DataFrame:
    """Number of documents by reason."""
    return bad.groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason")


def cleanup_check(bad: DataFrame, docs: DataFrame, contents: DataFrame) -> DataFrame:
    """After a cleanup: how many of its documents are failed, and how many contents they still have."""
    left = contents.select(F.col("document_id").alias("id"), F.lit(1).alias("content"))
    rows = bad.select("id").join(docs.select("id", "ingestion_status"), "id").join(left, "id", "left")
    return rows.agg(F.count_if(F.col("ingestion_status") == "FAILED").alias("failed_documents"), F.count("content").alias("remaining_content_rows"))


def clean_up(docs: DataFrame, contents: DataFrame, jobs: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, contents and jobs once unreadable ready documents are reset: contents go, fields are emptied, page jobs fail, by id or URL.

    A reset document is titled by the host of its source URL, if it has one. The match by id or URL is two equi joins.
    """
    bad = unreadable_documents(docs, contents)
    reset = docs.join(bad.select("id", "reason"), "id", "left")
    is_bad = F.col("reason").isNotNull()
    host = F.when(F.col("source_url").isNotNull(), F.regexp_replace("source_url", r"^https?://([^/]+).*$", "$1")).otherwise(F.col("title"))
    emptied = [c for c in ("lang", "canonical_url", "excerpt", "author", "published_at") if c in docs.columns]
    reset = reset.withColumns({
        "title": F.when(is_bad, host).otherwise(F.col("title")), "ingestion_status": F.when(is_bad, "FAILED").otherwise(F.col("ingestion_status")),
        **{c: F.when(~is_bad, F.col(c)) for c in emptied},
    }).drop("reason")
    gone = contents.join(bad.select(F.col("id").alias("document_id")), "document_id", "left_anti")
    pages = jobs.where("kind = 'FETCH_WEB_PAGE'")
    by_id = pages.join(bad.select(F.col("id").alias("document_id"), "reason"), "document_id").select("id", "reason")
    by_url = pages.join(bad.where("source_url is not null").groupBy("source_url").agg(F.max("reason").alias("reason")), "source_url").select("id", "reason")
    hit = by_id.union(by_url).groupBy("id").agg(F.max("reason").alias("reason"))
    said = {k: F.create_map(*[F.lit(x) for r, v in CLEANUP_CODES.items() for x in (r, v[i])])[F.col("reason")] for i, k in enumerate(("code", "message"))}
    is_hit = F.col("reason").isNotNull()
    payload = F.to_json(F.struct(F.struct(said["code"].alias("code"), said["message"].alias("message")).alias("error")))
    marked = jobs.join(hit, "id", "left").withColumns({
        "status": F.when(is_hit, "FAILED").otherwise(F.col("status")), "error_message": F.when(is_hit, said["message"]).otherwise(F.col("error_message")),
        "payload_json": F.when(is_hit, payload).otherwise(F.col("payload_json")),
        "finished_at": F.when(is_hit, F.coalesce("finished_at", F.current_timestamp() if now is None else now)).otherwise(F.col("finished_at")),
    }).drop("reason")
    return reset, gone, marked


def backfill(docs: DataFrame) -> DataFrame:
    """Columns that later versions added, filled from what older rows have."""
    return docs.withColumns({
        "entered_reading_at": F.coalesce("entered_reading_at", "created_at"), "published_at_kind": F.coalesce("published_at_kind", F.when(F.col("published_at").isNull(), "UNKNOWN").otherwise("EXACT")),
        "ai_summary_status": F.coalesce("ai_summary_status", F.when(F.nullif(F.trim("ai_summary"), F.lit("")).isNotNull(), "READY")),
    })


def origin_candidates(docs: DataFrame, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """The oldest n pages of the messenger whose origin needs repair, and whether there are more (has_more, one row): those without a
    key, or with the label of an unknown publication under a known one's key."""
    unlabelled = (F.col("origin_label") == UNKNOWN) & (F.col("origin_key") != "wechat:unknown")
    rows = docs.where((F.col("type") == "WEB_PAGE") & from_domain(WECHAT_HOST) & (F.col("origin_key").isNull() | unlabelled))
    oldest = rows.orderBy("created_at", "id").limit(n + 1)
    return oldest.orderBy("created_at", "id").limit(n), oldest.agg((F.count("*") > n).alias("has_more"))


def origin_repairs(docs: DataFrame, metadata: DataFrame, registry: DataFrame, n: int = 20) -> DataFrame:
    """id, origin_key, origin_label and author of origin_candidates() by page metadata (id, biz, nickname, author) and registry (biz, display_name)."""
    rows = origin_candidates(docs, n)[0].join(metadata.select("id", "biz", "nickname", F.col("author").alias("page_author")), "id", "left").join(registry, "biz", "left")
    key = F.coalesce(F.concat(F.lit("wechat:biz:"), F.col("biz")), "origin_key", F.concat(F.lit("wechat:nickname:"), F.col("nickname")), F.lit("wechat:unknown"))
    label = origin_label(F.col("origin_key"), F.col("origin_label"), key, F.coalesce("display_name", F.lit(UNKNOWN)), F.col("nickname"))
    return rows.select("id", key.alias("origin_key"), label.alias("origin_label"), F.coalesce("author", "page_author").alias("author"))


def summary_batch(docs: DataFrame, n: int = 5) -> DataFrame:
    """id and queued of the oldest n ready pages without a summary that never had one or failed: queued if they have a text for it."""
    n = min(max(1, n), 20)
    state = F.col("ai_summary_status")
    rows = docs.where((F.col("type") == "WEB_PAGE") & (F.col("ingestion_status") == "READY") & F.col("ai_summary").isNull() & (state.isNull() | (state == "FAILED")))
    return rows.orderBy("created_at", "id").limit(n).select("id", summary_due(False).alias("queued"))
