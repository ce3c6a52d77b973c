"""Bookmark cards: documents from cards, upsert with change detection, tags and highlights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.dates import page_date
from lectern.functions.markdown import rendered
from lectern.functions.text import bookmark_excerpt, bookmark_words, collapse
from lectern.functions.urls import capture_url, dedupe_key, normalize_url
from lectern.operators.durable import stored
from lectern.operators.filters import summary_due

#: Columns of a document that a card overwrites, also by null, and those in which what is stored stays.
OVERWRITTEN = ["title", "source_url", "excerpt", "ingestion_status", "published_at", "published_at_kind"]
KEPT = ["canonical_url", "author", "content_origin_key", "content_origin_label"]
#: Columns of a content, of which a card has all or, without a text, none.
CONTENT = ["content_html", "plain_text", "text_hash", "word_count"]
#: Columns of a highlight that tell whether it changed.
HIGHLIGHT = ["quote_text", "note", "color", "created_at"]
#: Fixed value: the title of a card that tells none.
UNTITLED = "Untitled import"


def cards_to_documents(cards: DataFrame, imported_at: Column, metadata: DataFrame | None = None) -> DataFrame:
    """Documents of cards (id, title, article_title, description, url, create_time, update_time, word_count, tags, highlights, markdown).

    metadata (id, canonical_url, final_url, author, published_at, content_origin_key, content_origin_label) is what the cards' pages tell,
    where they could be read. Cards without an id or with a blank one give none.
    """
    told = ["canonical_url", "final_url", "author", "content_origin_key", "content_origin_label"]
    rows = cards.withColumn("id", collapse(F.col("id"))).where("id is not null").withColumn("_made", rendered(F.col("markdown")))
    if metadata is None:
        rows = rows.withColumns({f"_{c}": F.lit(None).cast("string") for c in told} | {"_published_at": F.lit(None).cast("timestamp")})
    else:
        rows = rows.join(metadata.select("id", *[F.col(c).alias(f"_{c}") for c in [*told, "published_at"]]), "id", "left")
    text = F.col("_made.plain_text")
    rows = rows.withColumns({"_excerpt": bookmark_excerpt(F.col("description"), F.col("_made.excerpt")), "_url": capture_url(F.col("url"))})
    lines = F.concat_ws("\n", F.coalesce(text, F.lit("")), F.coalesce("_excerpt", F.lit("")))
    first = F.get(F.filter(F.transform(F.split(lines, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), 0)
    named = F.coalesce(collapse(F.col("article_title")), collapse(F.col("title")))
    usable = named.isNotNull() | F.col("_excerpt").isNotNull() | (F.coalesce(text, F.lit("")) != "")
    canonical = F.coalesce("_canonical_url", "_final_url", "_url")
    none = F.lit(None).cast("string")
    return rows.select(
        F.col("id").alias("external_id"), F.lit("WEB_PAGE").alias("type"), F.coalesce(named, first, F.lit(UNTITLED)).alias("title"), F.col("_url").alias("source_url"), canonical.alias("canonical_url"),
        dedupe_key(F.lit("WEB_PAGE"), F.col("_url"), canonical, none).alias("dedupe_key"), F.col("_excerpt").alias("excerpt"), F.col("_author").alias("author"), F.col("_content_origin_key").alias("content_origin_key"),
        F.col("_content_origin_label").alias("content_origin_label"), F.when(usable, "READY").otherwise("FAILED").alias("ingestion_status"), F.col("_published_at").alias("published_at"),
        F.when(F.col("_published_at").isNotNull(), "EXACT").otherwise("UNKNOWN").alias("published_at_kind"), F.col("_made.content_html"), text.alias("plain_text"), F.col("_made.text_hash"),
        F.when(text.isNotNull(), bookmark_words(F.col("word_count"), text)).alias("word_count"), imported_at.alias("created_at"), imported_at.alias("updated_at"),
        page_date(F.col("create_time")).alias("card_created_at"), page_date(F.col("update_time")).alias("card_updated_at"), "tags", "highlights",
    )


#: Fixed value: what stands for the text of a highlighted image.
IMAGE_MARK = "[Image highlight]"


def quote_text(text: Column, image: Column) -> Column:
    """A highlight's text, else the mark of an image and its normalised URL, or the mark alone."""
    url = normalize_url(capture_url(image))
    return F.coalesce(collapse(text), F.concat(F.lit(f"{IMAGE_MARK} "), url), F.lit(IMAGE_MARK))


def tag_names(cards: DataFrame, directory: DataFrame) -> DataFrame:
    """id and names of cards (id, tags): tags in a directory (name) take its spelling, others stay; distinct and sorted."""
    rows = cards.select("id", F.explode("tags").alias("tag")).select("id", collapse(F.col("tag")).alias("tag")).where("tag is not null")
    known = directory.groupBy(F.lower("name").alias("k")).agg(F.min("name").alias("name"))
    return rows.join(known, F.lower("tag") == F.col("k"), "left").groupBy("id").agg(F.array_sort(F.collect_set(F.coalesce("name", "tag"))).alias("names"))


def card_highlights(documents: DataFrame) -> DataFrame:
    """external_id of each document's card, and id, quote_text, note, color and created_at of its highlights; those without an id are left out.

    highlights is an array of (id, text, image_url, note, color, create_time); a time that is missing is the import's.
    """
    rows = documents.select("external_id", "updated_at", F.explode("highlights").alias("h"))
    return rows.select(
        "external_id", collapse(F.col("h.id")).alias("id"), quote_text(F.col("h.text"), F.col("h.image_url")).alias("quote_text"), collapse(F.col("h.note")).alias("note"), collapse(F.col("h.color")).alias("color"),
        F.coalesce(page_date(F.col("h.create_time")), "updated_at").alias("created_at"),
    ).where("id is not null").dropDuplicates(["external_id", "id"])


def _differs(names: list[str], new: str = "", old: str = "old_") -> Column:
    return reduce(Column.__or__, [~F.col(f"{new}{c}").eqNullSafe(F.col(f"{old}{c}")) for c in names])


def matched(new: DataFrame, documents: DataFrame) -> DataFrame:
    """new with stored_id: the stored page with the card's id, else the one with its dedupe key; of several the smallest id. Equi joins."""
    pages = documents.where("type = 'WEB_PAGE' and external_id is not null")
    by_ext = pages.groupBy("external_id").agg(F.min("id").alias("_by_ext"))
    by_key = documents.where("dedupe_key is not null").groupBy("dedupe_key").agg(F.min("id").alias("_by_key"))
    out = new.join(by_ext, "external_id", "left").join(by_key, "dedupe_key", "left")
    return out.withColumn("stored_id", F.coalesce("_by_ext", "_by_key")).drop("_by_ext", "_by_key")


def upsert(new: DataFrame, documents: DataFrame, contents: DataFrame, tags: DataFrame, highlights: DataFrame) -> DataFrame:
    """new cards' documents with stored_id, the merged values of their columns, document_changed, content_changed, tags_changed,
    highlights_changed and status: imported, updated or skipped.

    Of OVERWRITTEN columns the card's value counts, also a null; of KEPT ones the stored value if there is one. Stored tables are
    documents (id, type, external_id, dedupe_key and these columns), contents (document_id and CONTENT), tags (document_id, name) and
    highlights (document_id, external_id, null for those made by hand, and HIGHLIGHT). new has tag_names, an array, and highlights.
    """
    met = stored(matched(new, documents), "matched-cards")
    old = documents.select(F.col("id").alias("stored_id"), *[F.col(c).alias(f"old_{c}") for c in [*OVERWRITTEN, *KEPT]])
    old_content = contents.select(F.col("document_id").alias("stored_id"), F.lit(True).alias("had_content"), *[F.col(c).alias(f"old_{c}") for c in CONTENT])
    out = met.join(old, "stored_id", "left").join(old_content, "stored_id", "left")
    out = out.withColumns({c: F.coalesce(f"old_{c}", c) for c in KEPT})
    has = F.col("plain_text").isNotNull()
    changed = {
        "document_changed": _differs([*OVERWRITTEN, *KEPT]),
        "content_changed": F.when(has & F.coalesce("had_content", F.lit(False)), _differs(CONTENT)).otherwise(has | F.coalesce("had_content", F.lit(False))),
    }
    out = out.withColumns(changed)
    # tags and highlights change if a full outer join by key finds a row to create, update or delete
    ids = met.where("stored_id is not null").select("stored_id", "external_id")
    own = ids.withColumnRenamed("external_id", "card")
    wanted = met.select("external_id", F.explode("tag_names").alias("name")).join(ids, "external_id").select("stored_id", "name").distinct()
    there = tags.select(F.col("document_id").alias("stored_id"), "name").join(ids.select("stored_id").distinct(), "stored_id", "left_semi").distinct()
    tag_actions = sync_rows(wanted, there, ["stored_id", "name"], [])
    marks = card_highlights(met).withColumnRenamed("external_id", "card").join(own, "card").select("stored_id", F.col("id").alias("external_id"), *HIGHLIGHT)
    held = highlights.where("external_id is not null").select(F.col("document_id").alias("stored_id"), "external_id", *HIGHLIGHT).join(ids.select("stored_id").distinct(), "stored_id", "left_semi")
    mark_actions = sync_rows(marks, held, ["stored_id", "external_id"], HIGHLIGHT)
    for name, actions in (("tags_changed", tag_actions), ("highlights_changed", mark_actions)):
        out = out.join(actions.where("action <> 'keep'").select("stored_id").distinct().withColumn(name, F.lit(True)), "stored_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    new_row = F.col("stored_id").isNull()
    any_change = F.col("document_changed") | F.col("content_changed") | F.col("tags_changed") | F.col("highlights_changed")
    status = F.when(new_row, "imported").when(any_change, "updated").otherwise("skipped")
    return out.withColumn("status", status).drop(*[f"old_{c}" for c in [*OVERWRITTEN, *KEPT, *CONTENT]], "had_content")


def merge_cards(upserted: DataFrame, documents: DataFrame, contents: DataFrame, tags: DataFrame, highlights: DataFrame, new_id: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """documents, contents, tags and highlights once upsert()'s cards are merged; new_id names the documents that are new.

    A document that changed, or whose content did, loses its summary. Highlights made by hand stay. Rows of other documents are as
    they were; columns that a card does not tell are null in new rows, which are unread and no favourites.
    """
    rows = stored(upserted.withColumn("id", F.coalesce("stored_id", new_id)), "upserted-cards")
    touched = rows.select("id")
    told = [*OVERWRITTEN, *KEPT]
    none = {f.name: F.lit(None).cast(f.dataType) for f in documents.schema.fields}
    start = {"read_state": F.lit("UNREAD"), "is_favorite": F.lit(False)}
    given = {c: F.col(c) for c in ["id", "type", "external_id", "dedupe_key", "created_at", "updated_at", *told]}
    fresh = rows.where("stored_id is null").select(*[(given.get(c) if c in given else start.get(c, none[c])).cast(documents.schema[c].dataType).alias(c) for c in documents.columns])
    reset = F.col("c.document_changed") | F.col("c.content_changed")
    found = documents.alias("d").join(rows.where("stored_id is not null").alias("c"), F.col("d.id") == F.col("c.id"), "left")

    def merged(c: str) -> Column:
        if c in told:
            return F.when(F.col("c.id").isNotNull(), F.col(f"c.{c}")).otherwise(F.col(f"d.{c}")).alias(c)
        return (F.when(F.coalesce(reset, F.lit(False)), None).otherwise(F.col(f"d.{c}")) if c.startswith("ai_summary") else F.col(f"d.{c}")).alias(c)

    docs = found.select(*[merged(c) for c in documents.columns]).unionByName(fresh)
    by_doc = touched.withColumnRenamed("id", "document_id")
    body = rows.where("plain_text is not null").select(F.col("id").alias("document_id"), *CONTENT)
    left = lambda t: t.join(by_doc, "document_id", "left_anti")
    new_tags = rows.select(F.col("id").alias("document_id"), F.explode("tag_names").alias("name")).distinct()
    marks = card_highlights(rows).withColumnRenamed("external_id", "card").join(rows.select(F.col("external_id").alias("card"), F.col("id").alias("document_id")), "card")
    by_hand = highlights.join(by_doc, "document_id", "left_semi").where("external_id is null")
    marks = marks.select("document_id", F.col("id").alias("external_id"), *HIGHLIGHT)
    return (
        docs, left(contents).select("document_id", *CONTENT).unionByName(body), left(tags).select("document_id", "name").unionByName(new_tags),
        left(highlights).unionByName(by_hand).select("document_id", "external_id", *HIGHLIGHT).unionByName(marks),
    )


def write_touched(spark: SparkSession, path: str, changed: DataFrame, gone: DataFrame, key: str, bucket: str) -> None:
    """Merges changed rows and the keys that go (gone) into a table that is partitioned by a bucket of its key: only the partitions of
    these keys are read and rewritten, the others stay as they are. changed has the bucket, gone has key and bucket."""
    names = changed.columns
    keys = stored(changed.select(key, bucket).union(gone.select(key, bucket)).distinct(), "touched-keys")
    table = spark.read.parquet(path)
    parts = [r[0] for r in keys.select(bucket).distinct().collect()]  # buckets, whose number is fixed
    kept = table.where(F.col(bucket).isin(parts)).join(keys.select(key), key, "left_anti").select(names)
    made = stored(kept.unionByName(changed), "touched-rows")  # a table cannot be overwritten while it is read
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(bucket).parquet(path)


def status_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def import_totals(upserted: DataFrame, documents: DataFrame, failed: DataFrame) -> DataFrame:
    """imported, updated, skipped, failed and queued of a batch, as one row: failed has the cards that gave no document, and queued are the
    documents (as merged) that are due for a summary."""
    one = upserted.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("imported", "updated", "skipped")])
    ids = upserted.select("external_id").distinct()
    queued = documents.where(summary_due(False)).join(ids, "external_id", "left_semi").agg(F.count("*").alias("queued"))
    return one.crossJoin(failed.agg(F.count("*").alias("failed"))).crossJoin(queued)  # one row each


def sync_rows(wanted: DataFrame, have: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys and action (create, update, delete or keep) from the rows wanted and those there: a full outer join by key.

    For highlights, have must hold imported ones only, so those made by hand are never deleted.
    """
    a = wanted.select(*keys, F.struct(F.lit(1).alias("_"), *values).alias("w"))
    b = have.select(*keys, F.struct(F.lit(1).alias("_"), *values).alias("h"))
    same = F.col("w").eqNullSafe(F.col("h"))
    return a.join(b, keys, "full").select(*keys, F.when(F.col("h").isNull(), "create").when(F.col("w").isNull(), "delete").when(same, "keep").otherwise("update").alias("action"))


def after_cursor(cards: DataFrame, update_time, card_id, n: int) -> DataFrame:
    """The next n cards after a cursor, by update time and id."""
    later = (F.col("update_time") > F.lit(update_time)) | ((F.col("update_time") == F.lit(update_time)) & (F.col("id") > F.lit(card_id)))
    return cards.where(later).orderBy("update_time", "id").limit(n)
