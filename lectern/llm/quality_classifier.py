"""Quality classifier with hierarchical empirical Bayes over sites (dealt operator 4).

A logistic classifier judges each text by its form. Sites are hosts and paths below them: a path's share of good documents
is shrunk towards its host's, and a host's towards the share of all documents. How far depends on the prior's strength,
which the method of moments finds from the spread of the sites themselves. Labels of training rows and the classifier's
evidence of the others are summed by grouped aggregation. A document's score adds its own log odds to the difference
between its site's log odds and the global ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.logistic import fit_logistic
from lectern.llm.shared import crc_fold, let, small, space_words, stored

#: A document is kept from this score on.
CUT = 0.5
#: Bound of the training sample, for each class.
SAMPLE = 4000
#: A label counts as one document, the classifier's evidence of an unlabelled one as this part of it.
EVIDENCE = 0.25
#: Bounds of the strength of a prior, in documents.
STRENGTH = (10.0, 10_000.0)
FEATURES = ["length", "symbols", "bars", "marks", "capitals", "variety", "word_length", "repeats"]


def features(docs: DataFrame) -> DataFrame:
    """docs with the array _x of the features of text, all in 0 to about 10. Columns of docs called _w, _n or _x are not kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("_w", space_words(F.col("text"))).withColumn("_n", F.size("_w"))
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    n = F.greatest(F.col("_n"), F.lit(1))
    per_word = lambda x: F.least(x / n, F.lit(3.0))
    letters = F.length(text) - without(" \t\n\x0b\f\r")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ", ""))
    next_same = let(F.col("_w"), lambda ws: F.size(F.filter(F.transform(ws, lambda w, i: w == F.get(ws, i + 1)), lambda x: x)))
    values = [F.log1p(F.col("_n")), per_word(without("#*$%&<>")), per_word(without("|")), per_word(without("!?")), capitals / F.greatest(letters, F.lit(1)), F.size(F.array_distinct("_w")) / n, F.least(letters / n, F.lit(40)) / 10, next_same / n]
    return out.withColumn("_x", F.array(*[v.cast("double") for v in values])).drop("_w", "_n")


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> tuple[float, ...]:
    """The classifier's curve from at most per_class labelled rows of each class, chosen by a hash of the id, never of the held-out fold."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id")) != 1))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    chosen = [known.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_class) for y in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1]).select("doc_id", "y")), "doc_id")
    # an id may repeat, so the bound counts again after the join
    order = F.struct(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    bounded = [sample.where(F.col("y") == y).withColumn("_o", order).orderBy("_o").limit(per_class).drop("_o") for y in (0, 1)]
    told = features(bounded[0].union(bounded[1])).select("_x", "y").toPandas()  # at most 2 * per_class rows
    whole = {r["quality"]: r["count"] for r in labels.where(crc_fold(F.col("doc_id")) != 1).groupBy("quality").count().collect()}
    import numpy as np

    return fit_logistic(np.array(told["_x"].tolist()).reshape(-1, len(FEATURES)), told["y"].to_numpy(), whole)


def chance(curve: tuple[float, ...]) -> Column:
    """The classifier's probability from the column _x."""
    k = len(FEATURES)
    total = F.lit(curve[3 * k])
    for i in range(k):
        total = total + (F.get("_x", i) - curve[i]) / curve[k + i] * curve[2 * k + i]
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(good: float, n: float, spread: float, sites: int) -> float:
    """Prior documents of a level by moments: good and n are sums over its sites, spread that of n (share - mean)^2."""
    mean = good / n if n else 0.5
    within = mean * (1 - mean)
    between = spread / n - within * (sites - 1) / n if n else 0.0
    return min(max(within / between - 1 if between > 0 else math.inf, STRENGTH[0]), STRENGTH[1])


def site_posteriors(evidence: DataFrame) -> tuple[DataFrame, float]:
    """From host, path, good and n of each path: host, path, posterior; and the global share."""
    paths = stored(evidence, "sites")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    whole = hosts.agg(F.sum("host_good").alias("good"), F.sum("host_n").alias("n"), F.count("*").alias("sites")).first()
    n = whole["n"] or 0.0
    mean = whole["good"] / n if n else 0.5
    share = F.col("host_good") / F.col("host_n")
    spread = hosts.agg(F.sum(F.col("host_n") * (share - mean) ** 2).alias("s")).first()["s"] or 0.0
    k = _strength(whole["good"] or 0.0, n, spread, whole["sites"])
    hosts = hosts.withColumn("host_posterior", (F.col("host_good") + k * mean) / (F.col("host_n") + k))
    joined = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"])
    inner = joined.agg(F.sum(F.col("n") * (F.col("good") / F.col("n") - F.col("host_posterior")) ** 2).alias("s"), F.count("*").alias("sites")).first()
    k = _strength(whole["good"] or 0.0, n, inner["s"] or 0.0, inner["sites"])
    posterior = (F.col("good") + k * F.col("host_posterior")) / (F.col("n") + k)
    return joined.select("host", "path", posterior.alias("posterior")), mean


def _evidence(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """host, path, good, n from rows (doc_id, host, path, p) and training labels."""
    known = labels.where(F.col("quality").isin(0, 1) & (crc_fold(F.col("doc_id")) != 1)).groupBy("doc_id").agg(F.min("quality").alias("y"))
    weight = F.when(F.col("y").isNull(), EVIDENCE).otherwise(1.0)
    return rows.join(known, "doc_id", "left").groupBy("host", "path").agg(F.sum(weight * F.coalesce("y", "p")).alias("good"), F.sum(weight).alias("n"))


def _judged(rows: DataFrame, sites: DataFrame, mean: float) -> DataFrame:
    """rows with posterior and score."""
    met = rows["host"].eqNullSafe(sites["host"]) & rows["path"].eqNullSafe(sites["path"])
    joined = rows.join(small(sites), met, "left").drop(sites["host"]).drop(sites["path"])
    odds = _logit(F.col("p")) + _logit(F.coalesce("posterior", F.lit(mean))) - _logit(F.lit(mean))
    return joined.withColumn("score", 1 / (1 + F.exp(-odds)))


def quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, held_out, chance (the classifier's), site (the posterior), score, predicted of each row of docs.

    Labels are learned only outside the held-out fold. Null texts count as empty. A null host or path is a site of its own.
    Repeated rows and ids are judged one by one; a null id has no label and no fold. Other columns are ignored; an empty
    table gives no rows.
    """
    curve = train(docs, labels)
    kept = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text")
    rows = stored(features(kept).select("doc_id", "host", "path", chance(curve).alias("p")), "chances")
    sites, mean = site_posteriors(_evidence(rows, labels))
    out = _judged(rows, stored(sites, "posteriors"), mean)
    held = F.coalesce(crc_fold(F.col("doc_id")) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("p").alias("chance"), F.coalesce("posterior", F.lit(mean)).alias("site"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def drop_poor(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """docs, whatever its other columns, without the rows that score under CUT.

    Null texts count as empty; a null host or path is a site of its own; repeated rows and ids are judged one by one, so equal
    rows stay or go together. An empty table gives no rows. Texts are judged once and written with their chances.
    """
    curve = train(docs, labels)
    # the row travels as one column, so no name of docs can clash with those made here
    named = docs.select(F.struct("*").alias("row"), "doc_id", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text")
    rows = stored(features(named).select("row", "doc_id", "host", "path", chance(curve).alias("p")), "chances")
    sites, mean = site_posteriors(_evidence(rows.drop("row"), labels))
    return _judged(rows, stored(sites, "posteriors"), mean).where(F.col("score") >= CUT).select("row.*")
