"""License scans by an exact set-similarity join (dealt operator 8).

Text blocks are windows of 64 words, 32 apart; templates are short notices. A block meets a template if it holds at least
0.8 of the template's distinct words. Words of templates are ordered by their counts over all documents, rarest first, and
a block is the list of the template words that it holds, in this order. A block that meets the threshold t of a template of
n words holds one of its n - ceil(t n) + 1 first words (prefix filter) and ceil(t n) template words (length filter). Where the
first one that they share is the i-th of the template and the j-th of the block, counted from 0, they share no more words than
the template has from its i-th and the block has from its j-th on (positional filter). What passes is verified. Phrases go
the same way with a threshold of 1, and then all words must stand in order, side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.shared import let, letter_words, stored, text_key

THRESHOLD, BLOCK, STRIDE = 0.8, 64, 32

#: Fixed values of the contract: phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices in common use and the labels of this operator for them. A template has 32 words at most, so that a block holds it whole.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "gpl-3.0": "licensed under the gnu general public license version 3",
    "gpl-2.0": "licensed under the gnu general public license version 2",
    "lgpl": "licensed under the gnu lesser general public license version",
    "cc-by-4.0": "licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "mit-notice": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "bsd-clause": "redistribution and use in source and binary forms with or without modification are permitted",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "public-domain": "this is free and unencumbered software released into the public domain",
    "reserved": "copyright all rights reserved",
}

#: Templates that are versions of one license; any other is a family of its own.
FAMILIES = {"gpl-2.0": "gpl", "gpl-3.0": "gpl", "lgpl": "gpl", "cc-by-4.0": "cc", "cc-by-nc-4.0": "cc"}


def patterns(spark: SparkSession, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """label, exact, toks (in the pattern's order): a row for each phrase and template."""
    rows = [(label, True, text.split()) for text, label in phrases.items()]
    rows += [(label, False, list(dict.fromkeys(text.split()))) for label, text in templates.items()]
    return spark.createDataFrame(rows, "label string, exact boolean, toks array<string>")


def _ranked(words: DataFrame, known: DataFrame) -> DataFrame:
    """tok and rank (from 0) of each word of the patterns, the rarest of the documents first."""
    toks = known.select(F.explode("toks").alias("tok")).distinct()
    counts = words.select(F.explode("words").alias("tok")).join(F.broadcast(toks), "tok", "left_semi").groupBy("tok").count()
    counts = toks.join(counts, "tok", "left").na.fill(0, ["count"])
    order = F.sort_array(F.collect_list(F.struct("count", "tok")))  # of the fixed patterns' words
    return stored(counts.agg(order.alias("o")).select(F.posexplode("o").alias("rank", "x")).select(F.col("x.tok").alias("tok"), "rank"), "ranks")


def _prefixes(known: DataFrame, ranks: DataFrame, threshold: float) -> DataFrame:
    """tok and the patterns whose prefix holds it: label, exact, toks, size (distinct words), need, and i, its place in the prefix."""
    each = known.select("label", "exact", "toks", F.explode(F.array_distinct("toks")).alias("tok")).join(F.broadcast(ranks), "tok")
    rows = each.groupBy("label", "exact", "toks").agg(F.sort_array(F.collect_list(F.struct("rank", "tok"))).alias("r")).withColumn("size", F.size("r"))
    rows = rows.withColumn("need", F.when(F.col("exact"), F.col("size")).otherwise(F.ceil(F.col("size") * F.lit(threshold) - 1e-9)).cast("int"))
    rows = rows.select("label", "exact", "toks", "size", "need", F.posexplode(F.slice("r", 1, F.col("size") - F.col("need") + 1)).alias("i", "x"))
    return stored(rows.select(F.col("x.tok").alias("tok"), "label", "exact", "toks", "size", "need", "i"), "prefixes")


def candidates(words: DataFrame, known: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of words (words: array) by block and pattern that pass the filters, with start, w (the block's words), shared and the
    pattern's columns; and each row once without them."""
    ranks = _ranked(words, known)
    order = [r["tok"] for r in ranks.orderBy("rank").collect()]  # words of the fixed patterns
    prefixes = _prefixes(known, ranks, threshold)
    least = prefixes.agg(F.min("need").alias("m")).first()["m"] or 1
    first_toks = sorted({r["tok"] for r in prefixes.select("tok").collect()})

    def block(w, at):
        whole = F.slice(w, at + 1, F.lit(BLOCK))
        return F.struct(at.alias("start"), whole.alias("w"), F.array_intersect(F.lit(order), whole).alias("held"))

    # a word stands in its own block and in the one before; only blocks with a word of some prefix are built
    of_word = lambda i: F.array_distinct(F.array(i - i % STRIDE, F.greatest(i - i % STRIDE - STRIDE, F.lit(0))))
    hits = lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(first_toks))
    starts = lambda w: F.when(F.size(w) > 0, F.array_distinct(F.flatten(F.transform(hits(w), of_word)))).otherwise(F.array().cast("array<int>"))
    blocks = let(F.col("words"), lambda w: F.transform(starts(w), lambda at: block(w, at)))
    some = F.filter(blocks, lambda b: F.size(b["held"]) >= least)
    none = F.array(F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("array<string>").alias("w"), F.lit(None).cast("array<string>").alias("held")))
    rows = words.withColumn("_b", F.explode(F.concat(none, some))).drop("words")
    rows = rows.select("*", F.posexplode_outer("_b.held").alias("_j", "tok"))
    met = rows.join(F.broadcast(prefixes), "tok", "left").where(F.col("label").isNotNull() | F.col("_b").getField("start").isNull())
    held = F.size("_b.held")
    passed = (held >= F.col("need")) & (F.least(F.col("size") - F.col("i"), held - F.col("_j")) >= F.col("need"))
    met = met.where(F.col("label").isNull() | passed)
    return met.select("*", "_b.start", "_b.w", F.size(F.array_intersect("toks", "_b.held")).alias("shared")).drop("_b", "_j", "tok", "i")


def matches(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Of each row of docs: doc_id, key, n; with start, label, exact and part (the containment) of each match, and once without.

    start is a phrase's first word, or a block's. A phrase in two blocks is given twice. Null and empty texts have no match;
    each of equal rows has its own, and other columns are ignored.
    """
    if any(len(t.split()) > STRIDE for t in [*templates.values(), *phrases]) or not 0 < threshold <= 1:
        raise ValueError("templates and phrases have at most 32 words, and the threshold is over 0 and at most 1")
    words = docs.select("doc_id", text_key(F.col("text")).alias("key"), letter_words(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    met = candidates(words, patterns(docs.sparkSession, phrases, templates), threshold)
    met = met.where(F.col("label").isNull() | (F.col("shared") >= F.col("need")))
    at = F.sequence(F.lit(0), F.greatest(F.size("w") - F.size("toks"), F.lit(0)))
    places = F.filter(at, lambda k: F.slice("w", k + 1, F.size("toks")) == F.col("toks"))
    own = F.when(F.col("exact"), F.transform(places, lambda k: k + F.col("start"))).otherwise(F.array("start"))
    met = met.select("doc_id", "key", "n", "label", "exact", F.explode(own).alias("start"), (F.col("shared") / F.col("size")).alias("part"))
    return met


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, families: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of docs (doc_id, text, ...).

    The score is the largest containment that a match has, 1 for a phrase and 0 without a match. Null and empty texts have no
    words and no labels. Rows that repeat an id are judged by their own text, and equal rows each give a row. Other columns
    are ignored; an empty table gives no rows. A template's label goes where a better match of its family is within 32 words;
    without families, where one of any template is.
    """
    family = F.lit("") if families is None else F.coalesce(*[F.when(F.col("label") == label, name) for label, name in families.items()], F.col("label"))
    exact = F.col("exact") & F.col("label").isNotNull()
    place = F.when(exact, F.struct("start", "label"))
    met = matches(docs, phrases, templates, threshold).withColumn("family", F.when(~F.col("exact"), family))
    # of notices in one place, such as two versions of one license, the label is that of the best match; a document's notices are sorted
    near = Window.partitionBy("doc_id", "key", "n", "family").orderBy("start").rangeBetween(-STRIDE, STRIDE)
    met = met.withColumn("best", F.col("part") >= F.max("part").over(near))
    out = met.groupBy("doc_id", "key", "n").agg(
        F.count_if(F.col("label").isNull()).alias("copies"),
        F.collect_set(place).alias("places"),
        F.max(F.col("part")).alias("score"),
        F.collect_set(F.when(~F.col("exact") & F.col("best"), F.col("label"))).alias("notices"),
    )
    joined = lambda x: F.array_join(F.array_sort(x), ",")
    starts = F.transform("places", lambda p: p["start"].cast("long"))
    labels = F.array_distinct(F.concat(F.transform("places", lambda p: p["label"]), F.col("notices")))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(
        "doc_id", F.col("n").cast("long").alias("n_words"), F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(F.array_distinct(F.transform("places", lambda p: p["label"]))).alias("base_labels"), joined(labels).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
