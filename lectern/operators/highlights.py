"""Highlights: anchoring quotes, paragraphs, segments, groups by day."""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.batches import text_batches

#: Quotes and dashes that count as one.
SINGLE, DOUBLE, DASHES = "‘’‚‛′`´", "“”„‟″«»", "-‐‑‒–—―−"
#: White space, which is left out of what is searched.
SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)


def searchable(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The text without white space, quotes folded and runs of dashes as one, and where each character starts and ends in the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    dash = np.isin(codes, np.array([ord(c) for c in DASHES], np.uint32))
    codes[dash] = ord("-")
    for signs, one in ((SINGLE, "'"), (DOUBLE, '"')):
        codes[np.isin(codes, np.array([ord(c) for c in signs], np.uint32))] = ord(one)
    goes_on = np.append(dash[1:] & dash[:-1], False) if len(codes) else dash  # a dash that another one follows
    first = dash & ~np.append(False, dash)[:-1]
    keep = np.where(dash, first, ~np.isin(codes, SPACES))
    starts = np.flatnonzero(keep)
    run_ends = np.flatnonzero(~goes_on)
    ends = run_ends[np.searchsorted(run_ends, starts)] + 1
    return codes[keep].tobytes().decode("utf-32-le", "surrogatepass"), starts, ends


class Spans:
    """A set of spans as its sorted, disjoint parts."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def meets(self, a: int, b: int) -> bool:
        i = bisect_right(self.ends, a)
        return i < len(self.starts) and self.starts[i] < b

    def add(self, a: int, b: int) -> None:
        i, j = bisect_left(self.ends, a), bisect_right(self.starts, b)
        if i < j:
            a, b = min(a, self.starts[i]), max(b, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [a], [b]


def occurrences(flat: str, wanted: set[str]) -> dict[str, array]:
    """Where each of the wanted texts starts, in order: one pass of an automaton over the text, whatever their number."""
    import ahocorasick

    automaton, found = ahocorasick.Automaton(), {w: array("q") for w in wanted}
    for w in wanted:
        automaton.add_word(w, w)
    if wanted:
        automaton.make_automaton()
        for end, w in automaton.iter(flat):
            found[w].append(end - len(w) + 1)
    return found


def anchor_all(text: str, marks: list[tuple]) -> list[tuple]:
    """(id, start, end) of marks (id, quote, start, end) in order: given offsets stay, other quotes take the first free match.

    A place that was taken stays taken, so each quote goes through its places once, however many marks have it.
    """
    flat, starts, ends = searchable(text)
    given = lambda m: m[2] is not None and m[3] is not None and 0 <= m[2] < m[3]
    wanted = [None if given(m) else searchable(m[1] or "")[0] for m in marks]
    places = {w: iter(at) for w, at in occurrences(flat, {w for w in wanted if w}).items()}
    taken, out = Spans(), []
    for (ident, _, start, end), w in zip(marks, wanted, strict=True):
        if w is None:
            taken.add(start, end)
            out.append((ident, start, end))
        for at in places.get(w, ()):
            a, b = int(starts[at]), int(ends[at + len(w) - 1])
            if not taken.meets(a, b):
                taken.add(a, b)
                out.append((ident, a, b))
                break
    return out


def anchor_quotes(docs: DataFrame, highlights: DataFrame) -> DataFrame:
    """document_id, highlight_id, start, end of the highlights that anchor in their document.

    docs has id and text; highlights has id, document_id, quote_text, start_offset, end_offset and created_at. A document's
    highlights are gathered first (they are few), so each text is read once and no text is repeated by the join.
    """
    marks = highlights.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("created_at", F.col("id").alias("h"), "quote_text", "start_offset", "end_offset"))).alias("marks"))
    rows = docs.select("id", "text").join(marks, "id").select("id", F.coalesce("text", F.lit("")).alias("text"), F.to_json(F.transform("marks", lambda m: m.dropFields("created_at"))).alias("marks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for batch in batches:
            out = []
            for doc, text, marked in zip(batch["id"], batch["text"], batch["marks"], strict=True):
                asked = [(m["h"], m.get("quote_text"), m.get("start_offset"), m.get("end_offset")) for m in json.loads(marked)]
                out += [(doc, str(h), a, b) for h, a, b in anchor_all(text, asked)]
            yield pd.DataFrame(out, columns=["document_id", "highlight_id", "start", "end"])

    kind = docs.schema["id"].dataType.simpleString()
    return text_batches(rows).mapInPandas(run, f"document_id {kind}, highlight_id string, start int, end int")


def exact_anchors(docs: DataFrame, highlights: DataFrame) -> DataFrame:
    """document_id, highlight_id, start, end of quotes that stand in the text as they are, by the first place; columns only."""
    rows = highlights.select(F.col("id").alias("highlight_id"), "document_id", "quote_text").join(docs.select(F.col("id").alias("document_id"), "text"), "document_id")
    at = F.instr(F.col("text"), F.col("quote_text"))
    return rows.where((at > 0) & (F.col("quote_text") != "")).select("document_id", "highlight_id", (at - 1).alias("start"), (at - 1 + F.length("quote_text")).alias("end"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """id, idx, start, end, text of each paragraph that is not blank; offsets are running sums over the text's pieces."""
    seps = F.array_append(F.regexp_extract_all("text", F.lit("\n{2,}"), F.lit(0)), F.lit(""))
    pieces = F.arrays_zip(F.split("text", "\n{2,}").alias("text"), seps.alias("sep"))
    rows = docs.withColumn("pieces", pieces)
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int, text: string>>").alias("out"))
    placed = F.aggregate(
        "pieces", none,
        lambda a, p: F.struct((a["at"] + F.length(p["text"]) + F.length(p["sep"])).alias("at"), F.array_append(a["out"], F.struct(a["at"].alias("start"), (a["at"] + F.length(p["text"])).alias("end"), p["text"].alias("text"))).alias("out")),
        lambda a: F.filter(a["out"], lambda x: F.trim(x["text"]) != ""),
    )
    return rows.select("id", F.posexplode(placed).alias("idx", "p")).select("id", "idx", "p.start", "p.end", "p.text")


def clip_to_paragraphs(paras: DataFrame, highlights: DataFrame) -> DataFrame:
    """id, idx, highlight_id, start, end (within the paragraph) for each highlight (document_id, id, start, end) that meets a paragraph."""
    h = highlights.select(F.col("document_id").alias("id"), F.col("id").alias("highlight_id"), F.col("start").alias("h_start"), F.col("end").alias("h_end"))
    met = paras.join(h, "id").where((F.col("h_end") > F.col("start")) & (F.col("h_start") < F.col("end")))
    return met.select("id", "idx", "highlight_id", F.greatest(F.lit(0), F.col("h_start") - F.col("start")).alias("start"), F.least(F.col("end") - F.col("start"), F.col("h_end") - F.col("start")).alias("end"))


def segments(text: Column, marks: Column) -> Column:
    """Pieces of a text (type, id, text) cut at marks (start, end, id), in order; a mark that overlaps an earlier one or is empty is skipped."""
    piece = "array<struct<type: string, id: string, text: string>>"
    cut = lambda a, b: F.substr(text, a + 1, b - a)
    plain = lambda a, b: F.when(a < b, F.array(F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("id"), cut(a, b).alias("text")))).otherwise(F.array().cast(piece))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(piece).alias("out"))

    def step(a: Column, m: Column) -> Column:
        ok = (m["start"] >= a["at"]) & (m["start"] < m["end"])
        marked = F.array(F.struct(F.lit("highlight").alias("type"), m["id"].cast("string").alias("id"), cut(m["start"], m["end"]).alias("text")))
        return F.struct(F.when(ok, m["end"]).otherwise(a["at"]).alias("at"), F.when(ok, F.concat(a["out"], plain(a["at"], m["start"]), marked)).otherwise(a["out"]).alias("out"))

    return F.aggregate(F.array_sort(F.filter(marks, lambda m: m["start"].isNotNull() & m["end"].isNotNull())), none, step, lambda a: F.concat(a["out"], plain(a["at"], F.length(text))))


def slice_anchor(text: Column, start: Column, end: Column) -> Column:
    """The quote at offsets; null where they do not lie in the text."""
    return F.when((start >= 0) & (end > start) & (end <= F.length(text)), F.substr(text, start + 1, end - start))


def by_day(highlights: DataFrame) -> DataFrame:
    """day, n and documents of highlights (document_id, created_at)."""
    return highlights.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("documents"))


def overview(highlights: DataFrame) -> DataFrame:
    return highlights.agg(F.count("*").alias("highlights"), F.countDistinct("document_id").alias("documents"))
