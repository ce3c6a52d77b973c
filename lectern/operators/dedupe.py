"""Duplicates by key: audit, winners, merge, capture and cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.durable import Stored, stored
from lectern.operators.scans import ranked


def audit(rows: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """key, n and extra (rows beyond one) of each key that repeats; counts only, so a hot key is one row of partial counts."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").withColumn("extra", F.col("n") - 1)


def audit_report(rows: DataFrame, key: str = "dedupe_key", sample: int = 10) -> DataFrame:
    """One row: keys that repeat, rows beyond the first of each, and the smallest keys of a sample with their ids, at most sample of each.

    The ids are those of the sample's keys alone, and a key's are cut to the smallest while they are counted, so none is gathered whole.
    """
    repeated = audit(rows, key)
    few = repeated.orderBy(F.desc("n"), key).limit(sample)
    members = rows.join(F.broadcast(few.select(key)), key).groupBy(key, F.pmod(F.xxhash64("id"), F.lit(64)).alias("part"))
    some = members.agg(F.slice(F.array_sort(F.collect_set("id")), 1, sample).alias("ids")).groupBy(key).agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, sample).alias("ids"))
    totals = repeated.agg(F.count("*").alias("conflicts"), F.coalesce(F.sum("extra"), F.lit(0)).alias("extra"))
    listed = some.agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), "ids"))).alias("sample"))
    return totals.crossJoin(listed)  # one row each


def winners(rows: DataFrame, key: str = "dedupe_key", summary: bool = True) -> DataFrame:
    """key, winner and n of each key that repeats: most highlights, then a summary, then the earliest, then the smallest id.

    A minimum of one struct, not a window: it is combined before the shuffle, so a hot key needs no large task.
    """
    rank = F.struct((-F.col("highlights")).alias("h"), *([(~F.col("has_summary")).alias("s")] if summary else []), F.col("created_at"), F.col("id"))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(rank)["id"].alias("winner"), F.count("*").alias("n")).where("n > 1")


def merge_plan(rows: DataFrame, tags: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """What a merge does per key: winner, losers, highlights that move, new tags, and whether the winner becomes read."""
    won = winners(rows, key)
    members = rows.join(won.select(key, "winner"), key)
    loses = F.col("id") != F.col("winner")
    sums = members.groupBy(key, "winner").agg(
        F.count_if(loses).alias("losers"),
        F.sum(F.when(loses, F.col("highlights")).otherwise(0)).alias("moved"),
        F.coalesce(F.bool_or(loses & (F.col("read_state") == "READ")) & ~F.bool_or(~loses & (F.col("read_state") == "READ")), F.lit(False)).alias("becomes_read"),
    )
    own = members.select(key, "id", "winner").join(tags.select(F.col("document_id").alias("id"), "slug"), "id")
    added = own.groupBy(key, "slug").agg(F.bool_or(~loses).alias("had")).where("not had").groupBy(key).agg(F.count("*").alias("new_tags"))
    return sums.join(added, key, "left").na.fill(0, ["new_tags"])


def merge_totals(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count("*").alias("groups"), F.coalesce(F.sum("losers"), F.lit(0)).alias("losers"), F.coalesce(F.sum("moved"), F.lit(0)).alias("moved"), F.coalesce(F.sum("new_tags"), F.lit(0)).alias("new_tags"), F.count_if("becomes_read").alias("become_read"))


def merge(docs: DataFrame, highlights: DataFrame, tags: DataFrame, key: str = "dedupe_key") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, highlights and tags once duplicates are merged: children move to winners, read winners stay or become read."""
    won = winners(docs, key)
    moves = docs.join(won.select(key, "winner"), key).where("id <> winner").select(F.col("id").alias("document_id"), "winner")
    read = docs.join(won.select(key, "winner"), key).where("read_state = 'READ'").select(F.col("winner").alias("id")).distinct().withColumn("was_read", F.lit(True))
    kept = docs.join(moves.select(F.col("document_id").alias("id")), "id", "left_anti").join(read, "id", "left")
    kept = kept.withColumn("read_state", F.when(F.col("was_read"), "READ").otherwise(F.col("read_state"))).drop("was_read")
    moved = lambda t: t.join(moves, "document_id", "left").withColumn("document_id", F.coalesce("winner", "document_id")).drop("winner")
    return kept, moved(highlights), moved(tags).dropDuplicates(["document_id", "slug"])


def delete_documents(gone: DataFrame, docs: DataFrame, children: dict[str, DataFrame], jobs: DataFrame) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """docs and children (document_id) without the documents of gone (id); their jobs stay without a reference."""
    ids = gone.select("id").distinct()
    by_doc = ids.withColumnRenamed("id", "document_id")
    left = {name: t.join(by_doc, "document_id", "left_anti") for name, t in children.items()}
    marked = jobs.join(by_doc.withColumn("gone", F.lit(True)), "document_id", "left")
    return docs.join(ids, "id", "left_anti"), left, marked.withColumn("document_id", F.when(F.col("gone").isNull(), F.col("document_id"))).drop("gone")


#: Lookups of a capture, in order.
STAGES = ["dedupe_key", "external_id", "url", "final_key", "content_hash"]


def match_captures(captured: DataFrame, stored: DataFrame) -> DataFrame:
    """captured with match_id and matched_by: the stored document that the first of the lookups finds, or nulls.

    captured has id, dedupe_key, external_id, urls (array), final_key and content_hash; stored has id, dedupe_key,
    external_id, source_url, canonical_url and content_hash. Each lookup is an equi join, and the lowest stage wins.
    """
    def hits(stage: int, left: Column | str, right: DataFrame) -> DataFrame:
        mine = captured.select("id", (F.col(left) if isinstance(left, str) else left).alias("k")).where("k is not null")
        return mine.join(right.where("k is not null"), "k").select("id", F.lit(stage).alias("stage"), "match_id")

    by = lambda c: stored.select(F.col(c).alias("k"), F.col("id").alias("match_id"))
    urls = by("source_url").union(by("canonical_url"))
    found = hits(0, "dedupe_key", by("dedupe_key")).union(hits(1, "external_id", by("external_id"))).union(hits(2, F.explode("urls"), urls)).union(hits(3, "final_key", by("dedupe_key"))).union(hits(4, "content_hash", by("content_hash")))
    first = found.groupBy("id").agg(F.min(F.struct("stage", "match_id")).alias("x")).select("id", "x.match_id", F.get(F.array(*map(F.lit, STAGES)), F.col("x.stage")).alias("matched_by"))
    return captured.join(first, "id", "left")


def capture(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows to insert: captured pages that match no stored document; unreadable ones as failed placeholders."""
    new = match_captures(pages, stored).where("match_id is null")
    failed = F.col("error_code").isNotNull()
    return new.withColumn("ingestion_status", F.when(failed, "FAILED").otherwise("READY")).withColumn("plain_text", F.when(~failed, F.col("plain_text"))).drop("match_id", "matched_by")


def numbered(rows: DataFrame, base: str, out: str = "slug", pattern: str = "%s-%d", taken: DataFrame | None = None) -> DataFrame:
    """rows with a unique name, as a pass in the order of id gives them: the base if it is free, else the first number from 2 that makes a
    free name. taken (name) has the names that are not free from the start.

    A row's first proposal is its place among the rows of its base, found without a window. Then names that several bases propose
    go to the smallest id, and the later rows of a base that lost one move on by one, until no name is proposed twice. That is the
    pass's result, since all names prefer the smaller id. Rounds are as many as the names that one base loses to others.
    """
    spark = rows.sparkSession
    held = Stored(spark)

    def named(table: DataFrame) -> DataFrame:
        return table.withColumn(out, F.when(F.col("_n") == 1, F.col(base)).otherwise(F.format_string(pattern, F.col(base), F.col("_n"))))

    made = held.keep("names", named(ranked(rows, base, [F.col("id").asc()], "_n")))
    used = taken.select(F.col("name").alias(out)).distinct().withColumn("_used", F.lit(True)) if taken is not None else None
    while True:
        clash = made.groupBy(out).agg(F.min("id").alias("_first"), F.count("*").alias("_many"))
        clash = clash.withColumn("_used", F.lit(None).cast("boolean")) if used is None else clash.join(used, out, "left")
        clash = clash.where("_many > 1 or _used")
        lost = made.join(clash, out).where((F.col("id") > F.col("_first")) | F.col("_used")).groupBy(F.col(base).alias("_base")).agg(F.min("_n").alias("_from"))
        lost = stored(lost, "lost-names")
        if lost.isEmpty():
            return made.drop("_n")
        moved = made.join(lost, F.col(base) == F.col("_base"), "left").withColumn("_n", F.col("_n") + F.when(F.col("_n") >= F.col("_from"), 1).otherwise(0))
        made = held.keep("names", named(moved.select(*rows.columns, "_n")))


def register_sources(new: DataFrame, known: DataFrame) -> DataFrame:
    """new (id, feed_url, locator_url) with existing_id: the known source of the same feed, else of the same locator, else null."""
    feed = known.where("feed_url is not null").groupBy("feed_url").agg(F.min("id").alias("by_feed"))
    locator = known.where("locator_url is not null").groupBy("locator_url").agg(F.min("id").alias("by_locator"))
    return new.join(feed, "feed_url", "left").join(locator, "locator_url", "left").withColumn("existing_id", F.coalesce("by_feed", "by_locator")).drop("by_feed", "by_locator")
