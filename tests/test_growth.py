"""What keeps queries from growing faster than their input: plans that read once, batches that are bounded."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from lectern.plans import document_queries, registry
from lectern.sources import feeds


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain(True)
    return out.getvalue().partition("== Physical Plan ==")[2]


@pytest.fixture
def documents(spark, tmp_path) -> str:
    rows = spark.range(120).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of "), F.col("id").cast("string"), F.lit(" < & more")).alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("source"))
    rows.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_entries_are_parsed_once(spark, documents):
    rows = feeds.entries(document_queries._bodies(spark, documents), "body")
    assert rows.count() == 120
    filters = [line for line in plan(rows).splitlines() if "Filter" in line]
    assert filters and not any("from_xml" in line or "regexp_extract_all" in line for line in filters)


def test_a_sync_reads_stored_entries(spark, documents):
    new, stored, gates = document_queries._fetched(spark, documents)
    assert all("from_xml" not in plan(x) for x in (new, stored, gates))
    got = registry.queries()["feed_sync_totals"](spark, documents).first()
    assert (got["feeds"], got["entries"]) == (2, 120)


def test_plain_text_of_entries(spark):
    cases = ["a\tb", " a \n b ", "a  b", "a b", "<p>a</p><!-- x -->b", "a &AMP; b&nbsp;&nbsp;c", "&lt;b&gt;", " \n ", "", None, "a\x0bb\r\nc"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(cases)], "k int, x string").select("k", feeds._plain(F.col("x")).alias("x"), feeds._clean(F.col("x")).alias("c")).orderBy("k").collect()
    assert [r["x"] for r in df] == ["a b", "a b", "a b", "a b", "ab", "a & b c", "<b>", "", "", "", "a b c"]
    assert [r["c"] for r in df] == ["a\tb", "a \n b", "a  b", "a b", "<p>a</p><!-- x -->b", "a &AMP; b&nbsp;&nbsp;c", "&lt;b&gt;", None, None, None, "a\x0bb\r\nc"]


def test_files_are_read_in_batches_and_bodies_are_ranked_by_name_alone(spark, documents, monkeypatch, tmp_path):
    ranked = []
    numbered = document_queries.dedupe.numbered
    monkeypatch.setattr(document_queries.dedupe, "numbered", lambda rows, *a: ranked.append(rows.columns) or numbered(rows, *a))
    got = registry.queries()["export_note_files"](spark, documents)
    assert got.count() == got.select("name").distinct().count() == 120 and ranked == [["id", "base"]]
    from lectern.sources import files

    path = f"file://{tmp_path}/many"
    df = spark.range(1200).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.repeat(F.lit("é"), F.col("id").cast("int")).alias("body")).coalesce(1)
    files.write_files(df, path)
    back = files.read_files(spark, path)
    assert sorted((r["name"], r["body"]) for r in back.collect()) == sorted((r["name"], r["body"]) for r in df.collect())
    sizes = back.mapInArrow(lambda bs: (b.slice(0, 1).select([0]).set_column(0, "name", [str(b.num_rows)]) for b in bs), "name string").collect()
    assert sum(int(r["name"]) for r in sizes) == 1200 and len(sizes) < 10


@pytest.mark.parametrize("name", ["page_extract", "quote_anchor_folded", "export_html_files"])
def test_batches_of_whole_texts_are_small(spark, documents, name):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.createDataFrame([(1, "https://a.org", "<p>x</p>")], "page_id long, url string, html string").write.parquet(f"{documents}/pages.parquet")
    before = spark.conf.get(key)
    spark.conf.unset(key)
    try:
        registry.queries()[name](spark, documents)
        assert int(spark.conf.get(key)) <= 1000
    finally:
        spark.conf.set(key, before)


def test_markdown_of_tags_in_any_case(spark):
    from lectern.functions.markdown import html_markdown

    cases = {
        "<H3>a</H3><P>b <STRONG>c</STRONG> &AMP;lt; d</P>": "### a\n\nb **c** &lt; d", "<PRE>x\n  y</PRE>": "```\nx\n  y\n```", "a\n\tb": "a b", "<Ol><Li>a</Li><Li>b</Li></Ol>": "1. a\n2. b",
        "a<BR/>b<hr>c": "a  \nb\n\n---\n\nc", "</div>a</DIV>b": "a\n\nb",
    }
    got = spark.createDataFrame([(k,) for k in cases], "h string").select("h", html_markdown(F.col("h")).alias("m")).collect()
    assert {r["h"]: r["m"] for r in got} == cases


def test_reading_states_fold_rows(spark, tmp_path):
    """Events come as rows, not as a table for each document; empty progress, ties and late events included."""
    from lectern.streaming import jobs, reading

    assert "pd." not in __import__("inspect").getsource(reading.ReadingStates)
    events = [(1, 1, 10, "open", None), (1, 2, 20, "progress", 40.0), (1, 3, 15, "progress", 90.0), (2, 4, 5, "progress", float("nan")), (2, 5, 4, "progress", 7.0), (3, 6, 9, "read", None), (3, 7, 8, "open", None), (3, 8, 7, "open", None), (4, 10, 3, "progress", 150.0), (4, 9, 3, "progress", 1.0), (5, 11, 2, "other", 3.0)]
    df = spark.createDataFrame(events, "document_id long, event_id long, s long, kind string, progress double").select("document_id", "event_id", F.timestamp_seconds("s").alias("ts"), "kind", "progress")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    reading.fold_reading_states(jobs.file_stream(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = sorted(tuple(r) for r in reading.current_states(spark, f"{tmp_path}/out").collect())
    assert got == [(1, 10_000_000, 40.0, "READING"), (2, None, 0.0, "UNREAD"), (3, 7_000_000, 100.0, "READ"), (4, None, 100.0, "UNREAD"), (5, None, 0.0, "UNREAD")]
