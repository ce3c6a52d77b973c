"""Operators 6, 7 and 8 on long texts, and the events from which chats are made again."""

import resource
import time

from pyspark.sql import functions as F

from lectern.llm import chat, licenses, toxicity


def test_parsing_holds_nothing_for_another_try():
    text = ("word \\ ### </turn> <b> " * 200_000)[:4_000_000]
    piece = chat.render("assis:tant", text)[0]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert chat.parse(piece) == ("assis:tant", text)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # KB


def test_spared_spans_are_merged():
    phrase = toxicity.EXCEPTIONS[0]
    model = toxicity.ToxicityModel({f" {phrase.split()[0]} ": 2.0, " bad ": 1.0}, ())
    automaton = model.automaton()
    start = time.time()
    total = toxicity.evidence((phrase.split() + ["good"]) * 100_000, automaton)[0]
    assert total == 0 and time.time() - start < 20
    assert toxicity.evidence((phrase.split() + ["bad"]) * 3, automaton)[3] == 1.0


def test_notices_of_long_documents(spark):
    """A document with thousands of notices, two versions of one license among them, and another license beside them."""
    texts = list(licenses.TEMPLATES.values())
    words = " ".join(texts * 300)
    docs = spark.createDataFrame([(1, words), (2, texts[0])], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(docs, families=licenses.FAMILIES).collect()}
    assert set(got[2].split(",")) <= set(got[1].split(",")) and next(iter(licenses.TEMPLATES)) in got[2].split(",")


def test_chats_are_made_again_from_every_kind_of_event(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t} </turn> " * (t * 7 % 60)) for c in range(6) for t in range(12)]
    rows += [(1, 1, "assistant", "again"), (1, 1, "assistant", "again"), (None, 3, "assistant", "x" * 500), (2, None, "assistant", None), (7, 0, None, "no role")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.as_events(df)
    kinds = {r["kind"]: r["count"] for r in log.groupBy("kind").count().collect()}
    assert kinds["message"] == len(rows) and min(kinds[k] for k in ("delta", "edit", "regenerate")) >= 3
    parsed = [chat.parse(r["formatted"]) for r in chat.format_chats(log).collect()]
    assert sorted(parsed) == sorted((r or "", t or "") for _, _, r, t in rows)
    whole = df.withColumns({"seq": F.lit(0).cast("long"), "kind": F.lit("message")})
    tell = lambda events: sorted(map(tuple, chat.digests(chat.format_chats(events)).collect()), key=repr)
    assert tell(log) == tell(whole)
    assert chat.as_events(df.limit(0)).collect() == [] and tell(chat.as_events(df.limit(0))) == []
