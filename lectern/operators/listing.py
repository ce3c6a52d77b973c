"""Ordered, paged and searched listings, lookups and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.columns import let
from lectern.functions.urls import video_identity
from lectern.operators.filters import ListQuery, lead, preview, select_documents, text_search
from lectern.operators.scans import with_next

MAX_PAGE = 50


def ordering(surface: str = "source", sort: str = "latest") -> list[Column]:
    """Sort keys of a surface. Undated documents come last both ways, and the id breaks ties."""
    down = sort != "earliest"
    way = lambda c: F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last()
    if surface == "source":
        return [way("created_at"), way("id")]
    return [way("published_at"), way("entered_reading_at" if surface == "reading" else "created_at"), way("id")]


def page_of(docs: DataFrame, keys: list[Column], page: int = 1, size: int = 20) -> DataFrame:
    """One page of docs. Far pages cost a sort of all before them; after_key() reads on from a known row instead."""
    size = min(max(1, size), MAX_PAGE)
    return docs.orderBy(*keys).offset((max(1, page) - 1) * size).limit(size)


def page_counts(total: int, page: int, size: int = 20) -> tuple[int, int]:
    """The page clamped to the last, and the number of pages."""
    pages = max(1, -(-total // size))
    return min(max(1, page), pages), pages


def list_documents(docs: DataFrame, query: ListQuery, tags: DataFrame | None = None) -> DataFrame:
    """One page of the documents that meet a query; text columns are read only where it searches them."""
    return page_of(select_documents(docs, query, tags), ordering(query.surface, query.sort), query.page, query.page_size)


def quick_search(docs: DataFrame, q: str, n: int = 6) -> DataFrame:
    """The latest documents that hold a text."""
    return docs.where(text_search(q)).orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc()).limit(n)


def next_documents(docs: DataFrame, group: str, keys: list[Column]) -> DataFrame:
    """docs with next_id, what follows in their group's order (its keys must make it total); a group may hold any part of the rows."""
    return with_next(docs, group, keys, "id", "next_id")


def after_key(docs: DataFrame, at, doc_id, n: int = 1) -> DataFrame:
    """The documents after a known one, latest first, by a key instead of an offset."""
    behind = (F.col("created_at") < F.lit(at)) | ((F.col("created_at") == F.lit(at)) & (F.col("id") < F.lit(doc_id)))
    return docs.where(behind).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def in_order_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs of ids (id, pos), in the caller's order."""
    return docs.join(ids, "id").orderBy("pos")


def missing_ids(ids: DataFrame, docs: DataFrame) -> DataFrame:
    return ids.join(docs.select("id"), "id", "left_anti")


def with_details(docs: DataFrame, contents: DataFrame, tags: DataFrame) -> DataFrame:
    """docs with their content and an array of their tags; a missing child leaves nulls or an empty array."""
    own = tags.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("slug", "name"))).alias("tags"))
    joined = docs.join(contents.withColumnRenamed("document_id", "id"), "id", "left").join(own, "id", "left")
    return joined.withColumn("tags", F.coalesce("tags", F.array().cast(own.schema["tags"].dataType)))


_SHOWN = ["id", "type", "title", "source_url", "canonical_url", "ai_summary", "ai_summary_status", "excerpt", "author", "read_state", "reading_progress", "is_favorite", "ingestion_status"]
_TIMES = ["published_at", "entered_reading_at"]
_SOURCE = ["source_id", "source_title", "site_url"]


def _iso(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias(c)


def _source() -> Column:
    """The document's source as a struct; null if it has none."""
    return F.when(F.col("source_id").isNotNull(), F.struct(F.col("source_id").alias("id"), F.col("source_title").alias("title"), "site_url")).alias("source")


def list_items(docs: DataFrame) -> DataFrame:
    """What a list shows of documents (as with_details() and a source give them): no text, its number of words, and what opens them."""
    return docs.select(
        *_SHOWN, "lang", *map(_iso, [*_TIMES, "created_at", "updated_at"]), F.col("word_count"), F.coalesce("tags", F.array().cast("array<struct<slug: string, name: string>>")).alias("tags"), _source(),
        preview().alias("preview"), lead().alias("lead"),
    )


def _video() -> Column:
    """provider and embed_url of the first of a document's URLs that is a video's; null for others."""
    found = F.coalesce(*[video_identity(F.col(c)) for c in ("video_url", "canonical_url", "source_url")])
    return let(found, lambda v: F.when(v.isNotNull(), F.struct(v["provider"].alias("provider"), v["embed_url"].alias("embed_url")))).alias("video")


def detail_items(docs: DataFrame) -> DataFrame:
    """All that a document's page shows: the list's columns, its origin (if key and label are there), content, video and latest error (error_code, error_message)."""
    origin = F.when(F.col("content_origin_key").isNotNull() & F.col("content_origin_label").isNotNull(), F.struct(F.col("content_origin_key").alias("key"), F.col("content_origin_label").alias("label")))
    error = F.when(F.col("error_code").isNotNull(), F.struct(F.col("error_code").alias("code"), F.col("error_message").alias("message")))
    content = F.when(F.col("plain_text").isNotNull() | F.col("content_html").isNotNull(), F.struct("content_html", "plain_text", "word_count"))
    return docs.select(*_SHOWN, "lang", *map(_iso, [*_TIMES, "created_at", "updated_at"]), "tags", _source(), origin.alias("origin"), error.alias("error"), content.alias("content"), _video())


def reader_items(docs: DataFrame) -> DataFrame:
    """What the reader shows: HTML and its number of words, not the plain text; the origin's label alone; no tags, source or language."""
    content = F.when(F.col("plain_text").isNotNull() | F.col("content_html").isNotNull(), F.struct("content_html", "word_count"))
    return docs.select(*_SHOWN, *map(_iso, _TIMES), F.col("content_origin_label").alias("origin"), content.alias("content"), _video())


def relation_counts(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """parents with the number of their children, 0 for none. Children are counted before they are joined."""
    counts = children.groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name))
    return parents.join(counts, "id", "left").na.fill(0, [name])


def due_sources(sources: DataFrame, n: int = 10) -> DataFrame:
    """Active scheduled sources with a feed, longest without a sync first, never synced ones before them."""
    due = sources.where((F.col("status") == "ACTIVE") & F.col("scheduled") & F.col("feed_id").isNotNull())
    return due.orderBy(F.col("last_synced_at").asc_nulls_first(), "id").limit(n)


def source_list(sources: DataFrame) -> DataFrame:
    return sources.orderBy(F.col("last_synced_at").desc_nulls_last(), F.col("created_at").desc(), "id")


def count_of(docs: DataFrame, query: ListQuery, tags: DataFrame | None = None) -> DataFrame:
    """The number of documents that meet a query, as one row (total)."""
    return select_documents(docs, query, tags).agg(F.count("*").alias("total"))


def page_by_origin(docs: DataFrame, assigned: DataFrame, origin: str, query: ListQuery) -> DataFrame:
    """One page of the documents that meet a query and whose origin, as assigned (id, origin), is the given one: one plan, no list of ids."""
    mine = assigned.where(F.col("origin") == origin).select("id")
    return page_of(select_documents(docs, query).join(mine, "id", "left_semi"), ordering(query.surface, query.sort), query.page, query.page_size)


def export_candidates(docs: DataFrame, highlights: DataFrame, n: int = 50) -> DataFrame:
    """The n ready documents that are starred, summarised or highlighted, the last updated first."""
    marked = highlights.select(F.col("document_id").alias("id")).distinct().withColumn("marked", F.lit(True))
    rows = docs.where("ingestion_status = 'READY'").join(marked, "id", "left")
    chosen = rows.where(F.col("is_favorite") | F.col("ai_summary").isNotNull() | F.col("marked"))
    return chosen.orderBy(F.col("updated_at").desc(), F.col("id").desc()).limit(n).drop("marked")


def highlights_in_order(highlights: DataFrame) -> DataFrame:
    """Highlights (document_id, created_at, id) by document, the first made first."""
    return highlights.orderBy("document_id", "created_at", "id")
