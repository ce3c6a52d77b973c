"""Toxicity by a weighted lexicon matched with Aho-Corasick (dealt operator 6).

Texts are folded first: lower case, look-alike letters to Latin ones, digits and symbols inside words to the letters that
they stand for. The lexicon has whole words and beginnings of words; a term's weight is the lower bound of its log odds
between toxic and other training texts. A word counts with the heaviest term that it matches, unless it stands in an
exception phrase, and once however often a text repeats it. A text's total is normalised by its length, and a logistic curve
makes it a score.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.logistic import fit_logistic, probability
from lectern.llm.shared import crc_fold, each_text, stored, text_batches

CUT = 0.7
#: Bound of the training sample, for each class.
SAMPLE = 3000
#: Different texts that a term needs, its least weight, and how often a toxic row counts in the curve. Chosen by four-fold
#: cross-validation over training rows, near copies in one fold: 283 of 305 toxic rows found, 2 of 2,331 others rejected.
SUPPORT, LEAST, COUNTS = 3, 1.5, 3

#: Letters that look like Latin ones, and what digits and symbols stand for inside words.
LOOKALIKES = dict(zip("аеорсухіѕјԁһӏкмтвнαοεινρτυχκ", "aeopcyxisjdhlkmtbhaoeivptuxk", strict=True))
DIGITS = dict(zip("0134578", "oieastb", strict=True))
MARKS = dict(zip("@$!", "asi", strict=True))
#: Phrases in which a term isn't an insult.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown", "scum line", "pond scum", "idiot proof")

_LOOKS = str.maketrans({k: v for k, v in LOOKALIKES.items()})
_DIGIT = re.compile(r"(?<=[^\W\d_])[0134578]+(?![\d])|(?<![\w])[0134578](?=[^\W\d_])")
_MARK = re.compile(r"(?<=[^\W\d_])[@$!](?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")


def folded_words(text: str | None) -> list[str]:
    """Words of letters of the folded text."""
    text = (text or "").lower().translate(_LOOKS)
    text = _DIGIT.sub(lambda m: "".join(map(DIGITS.__getitem__, m[0])), text)
    return _WORD.findall(_MARK.sub(lambda m: MARKS[m[0]], text))


def terms_of(word: str) -> list[str]:
    """Terms that a word can match: itself and its first 3 to 6 letters. A space marks where a word starts or ends."""
    return [f" {word} ", *(f" {word[:n]}" for n in range(3, 7) if len(word) > n)]


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float]
    curve: tuple[float, ...]  # means, deviations, weights and the intercept of the logistic curve
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.lexicon.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, 0.0))
        if len(found):
            found.make_automaton()
        return found


def _joined(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of spans, those that overlap or touch as one, in order."""
    firsts: list[int] = []
    lasts: list[int] = []
    for a, b in sorted(spans):
        if lasts and a <= lasts[-1]:
            lasts[-1] = max(lasts[-1], b)
        else:
            firsts.append(a)
            lasts.append(b)
    return firsts, lasts


def evidence(words: list[str], automaton: ahocorasick.Automaton) -> tuple[float, float, float, float]:
    """Total, total by length, total by the root of the length, and heaviest term of a text's distinct words."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    if len(automaton):
        line = " " + " ".join(words) + " "
        for end, (length, weight) in automaton.iter(line):
            start = end - length + 1
            if weight and line[end] != " " and line[end + 1] == " ":
                continue  # a beginning is not the whole word
            if weight:
                best[start] = max(weight, best.get(start, 0.0))
            else:
                spared.append((start, end))
    if spared:
        firsts, lasts = _joined(spared)
        best = {s: w for s, w in best.items() if (i := bisect_right(firsts, s) - 1) < 0 or s >= lasts[i]}
    distinct = {line[s : line.index(" ", s + 1)]: w for s, w in best.items()} if best else {}
    total, n = sum(distinct.values()), max(20, len(words))
    return np.log1p(total), total / n, total / n**0.5, max(distinct.values(), default=0.0)


def _with_text(docs: DataFrame, run, schema: str, *columns: str) -> DataFrame:
    return text_batches(docs).select(*columns, "text").mapInPandas(run, schema)


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> DataFrame:
    """text, y of at most per_class labelled rows of each class, chosen by a hash of the id; rows of the held-out fold never."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id")) != 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    chosen = [known.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_class) for y in (0, 1)]
    met = docs.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1]).select("doc_id", "y")), "doc_id")
    # an id may repeat, so the bound counts again after the join
    met = met.withColumn("o", F.struct(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")))
    bounded = [met.where(F.col("y") == y).orderBy("o").limit(per_class) for y in (0, 1)]
    # a limit leaves one task, and a text gives many terms
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bounded[0].union(bounded[1]).select("text", "y").repartition(tasks, F.xxhash64("text"))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> ToxicityModel:
    """A model from labelled rows. Without rows of both classes its lexicon is empty and its scores are low.

    A term's support is a number of different texts: near copies share the smallest hash of their words, and one hash is
    counted once.
    """
    sample = stored(training_sample(docs, labels, per_class), "toxic-sample")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, y in zip(batch["text"], batch["y"], strict=True):
                words = set(folded_words(text))
                sig = min((xxhash.xxh64_intdigest(w) for w in words), default=0) >> 1
                out += [(t, sig, y) for w in words for t in terms_of(w)] + [("", sig, y)]
                if len(out) >= 50_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    names = ["term", "sig", "y"]
    counts = _with_text(sample, features, "term string, sig long, y int", "y").distinct().groupBy("term").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    counts = stored(counts.where((F.col("t") >= SUPPORT) | (F.col("term") == "")), "toxic-terms")
    totals = counts.where("term = ''").first() or {"t": 0, "c": 0}
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    weight = F.log(t / (totals["t"] + 1)) - F.log(c / (totals["c"] + 1)) - F.sqrt(1 / t + 1 / c)
    rows = counts.where("term <> ''").select("term", weight.alias("w")).where(F.col("w") > LEAST).orderBy(F.desc("w"), "term").collect()  # words of the sample
    lexicon = {r["term"]: r["w"] for r in rows}
    bare = ToxicityModel(lexicon, ())

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = bare.automaton()
        for batch in batches:
            yield pd.DataFrame([(*evidence(folded_words(x), automaton), y) for x, y in zip(batch["text"], batch["y"], strict=True)], columns=list("abcdy"))

    told = _with_text(sample, measured, "a double, b double, c double, d double, y int", "y").toPandas()  # at most 2 * per_class rows
    seen = labels.where(crc_fold(F.col("doc_id")) != 1).groupBy("toxic").count().collect()
    whole = {r["toxic"]: r["count"] * (COUNTS if r["toxic"] == 1 else 1) for r in seen}
    return ToxicityModel(lexicon, fit_logistic(told[list("abcd")].to_numpy(), told["y"].to_numpy(), whole))


def toxicity(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text, ...).

    Labels are learned only outside the held-out fold; a label, language, source or id is never an input of a score. Null
    texts count as empty and get the score of a text without terms. Repeated rows and ids are scored one by one; a null
    id is in no fold. Other columns are ignored; an empty table gives no rows.
    """
    model = model or train(docs, labels)
    out = text_batches(docs).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    held = F.coalesce(crc_fold(F.col("doc_id")) == 1, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            x = np.array([evidence(folded_words(t), automaton) for t in each_text(batch.column(1))]).reshape(-1, 4)
            yield pa.record_batch([batch.column(0), pa.array(probability(x, model.curve))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType
    got = out.mapInArrow(run, "doc_id string, score double").withColumn("doc_id", F.col("doc_id").cast(kind))
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """docs, whatever its other columns, without the rows that score CUT or more.

    Null texts count as empty and stay where texts without terms do. Repeated rows and ids are scored one by one, so equal rows
    stay or go together; an empty table gives no rows.
    """
    model = model or train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            x = np.array([evidence(folded_words(t), automaton) for t in each_text(batch.column(at))]).reshape(-1, 4)
            yield batch.filter(pa.array(probability(x, model.curve) < CUT))

    at = docs.columns.index("text")
    return text_batches(docs).mapInArrow(run, docs.schema)  # Arrow keeps every column's type and nulls
