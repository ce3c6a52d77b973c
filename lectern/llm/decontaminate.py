"""Benchmark decontamination by a prefix-filtered set join (dealt operator 2), in DataFrame operations only.

An item is cut into windows of 10 consecutive words; a shorter item is one window. A window occurs where a document holds
all of its words in its order, which is containment of 1, so the necessary prefix of a window is one shingle, its rarest.
Shingles are pairs of neighbouring words, ordered by their counts over all documents. Documents are joined with the
prefixes by shingle, the position of the shingle in the window and the lengths bound where the window can lie, and the words
there are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import is_small, let, letter_words, small, stored, text_key

WIDTH = 10


def _shingle(words: Column, at: Column) -> Column:
    """Key of the word pair at a place from 0; of the one word where there is no next."""
    return F.xxhash64(F.get(words, at), F.get(words, at + 1))


def windows(bench: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id and win (its words) of each distinct window of each item of bench (item_id, text)."""
    items = bench.select("item_id", letter_words(F.col("text")).alias("w")).withColumn("len", F.least(F.size("w"), F.lit(width))).where("len > 0")
    placed = items.select("item_id", "len", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("len"))).alias("i"))
    return placed.select("item_id", F.slice("w", F.col("i") + 1, F.col("len")).alias("win")).distinct()


def _places(docs: DataFrame, single: bool, *keep: str) -> DataFrame:
    """A row for each key at each place of each document, and one with a null key after the last place."""
    # the single-word key matters only if some window is one word
    placed = docs.select(*keep, "words", "n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("at"))
    pair = F.when(F.col("at") < F.col("n"), _shingle(F.col("words"), F.col("at")))
    if not single:
        return placed.withColumn("key", pair)
    one = F.when(F.col("at") < F.col("n") - 1, F.xxhash64(F.get("words", "at")))
    return placed.withColumn("key", F.explode(F.when(one.isNull(), F.array(pair)).otherwise(F.array(pair, one))))


def _prefixes(texts: DataFrame, wins: DataFrame, single: bool) -> DataFrame:
    """key, off (its place in the window) and win: the rarest shingle of each window that can occur."""
    last = F.greatest(F.size("win") - 2, F.lit(0))
    each = F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: _shingle(F.col("win"), i))).alias("off", "key")
    shingles = stored(wins.select("win").distinct().select("win", each), "shingles")
    keys = stored(shingles.select("key").distinct(), "shingle-keys")
    if is_small(keys):
        counts = _places(texts, single).select("key").join(F.broadcast(keys), "key", "left_semi").groupBy("key").count()
    else:
        counts = _places(texts, single).groupBy("key").count().join(keys, "key", "left_semi")
    ranked = shingles.join(counts, "key", "left").groupBy("win")
    ranked = ranked.agg(F.min(F.struct("count", "off", "key")).alias("rarest"), F.min(F.coalesce("count", F.lit(0))).alias("least"))
    # a window with a shingle that no document has does not occur
    return stored(ranked.where("least > 0").select("rarest.key", "rarest.off", "win"), "prefixes")


def occurrences(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """Of each row of docs: doc_id, text_key, n; with start, end and win of each of wins (win) that occurs, and once without.

    A prefix table that is small is broadcast, and words are compared where they are met. A larger one is joined by shuffle
    with places that carry no words; the candidates of a text then join it once more. Both are linear in the words.
    """
    single = not wins.where(F.size("win") == 1).isEmpty()
    texts = docs.select("doc_id", "text").withColumn("words", letter_words(F.col("text"))).withColumn("n", F.size("words"))
    prefixes = _prefixes(texts, wins, single)
    texts = texts.withColumn("text_key", text_key(F.col("text"))).drop("text")
    start, size = F.col("at") - F.col("off"), F.size("win")
    inside = (start >= 0) & (start + size <= F.col("n"))
    if is_small(prefixes):
        placed = _places(texts, single, "doc_id", "text_key")
        met = placed.join(F.broadcast(prefixes), "key", "left").where(F.col("win").isNotNull() | (F.col("at") == F.col("n")))
        same = F.when(inside, F.slice("words", F.greatest(start, F.lit(0)) + 1, size) == F.col("win"))
        met = met.where(F.col("win").isNull() | same).withColumn("start", F.when(F.col("win").isNotNull(), start))
    else:
        placed = _places(texts, single, "doc_id", "text_key").select("doc_id", "text_key", "n", "at", "key").where("key is not null")
        found = placed.join(prefixes, "key").where(inside).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct(start.alias("start"), "win")).alias("found"))
        own = F.col("t.doc_id").eqNullSafe(F.col("f.doc_id")) & F.col("t.text_key").eqNullSafe(F.col("f.text_key"))
        met = texts.alias("t").join(found.alias("f"), own, "left").select("t.doc_id", "t.text_key", "n", "words", "found")
        right = let(F.col("words"), lambda w: F.filter("found", lambda x: F.slice(w, x["start"] + 1, F.size(x["win"])) == x["win"]))
        none = F.array(F.lit(None).cast(met.schema["found"].dataType.elementType))
        met = met.select("doc_id", "text_key", "n", F.explode(F.concat(none, F.coalesce(right, F.array().cast(met.schema["found"].dataType)))).alias("x"))
        met = met.select("doc_id", "text_key", "n", "x.start", "x.win")
    return met.select("doc_id", "text_key", "n", "start", (F.col("start") + size).alias("end"), "win")


def contamination(docs: DataFrame, bench: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs (doc_id, text, ...).

    Null and empty texts have no words. Rows that repeat an id are judged by their own text, and equal rows each give a
    row. Items without words have no windows; an item without an id marks words but is not counted or listed. Other
    columns are ignored. An empty docs gives no rows; with an empty bench nothing is hit.
    """
    wins = stored(windows(bench, width), "windows")
    # rows without a window get a key that no window has, since their null would be one hot key
    key = F.coalesce("win", F.array(F.lit(""), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    met = occurrences(docs, wins).withColumn("win", key).join(small(wins), "win", "left")
    by_doc = met.groupBy("doc_id", "text_key", "n").agg(
        F.count_if(F.col("start").isNull()).alias("copies"),
        F.sort_array(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "end")))).alias("spans"),
        F.collect_set("item_id").alias("items"),
    )
    none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    fresh = lambda a, s: F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))
    n_hit = F.aggregate("spans", none, lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + fresh(a, s)).alias("n")), lambda a: a["n"])
    said = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    out = by_doc.withColumn("n_hit", n_hit.cast("long")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(
        "doc_id", F.col("n").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(said, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs, whatever its other columns, without the rows in which a window of bench occurs.

    Null and empty texts stay. Rows that repeat an id are judged by their own text, and equal rows stay or go together.
    With an empty bench all rows stay; an empty docs gives no rows.
    """
    wins = stored(windows(bench, width), "windows")
    bad = stored(occurrences(docs, wins).where("start is not null").select("doc_id", "text_key").distinct(), "contaminated")
    met = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & text_key(F.col("d.text")).eqNullSafe(F.col("b.text_key"))
    return docs.alias("d").join(small(bad).alias("b"), met, "left_anti")
