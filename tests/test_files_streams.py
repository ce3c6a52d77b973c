"""File sinks, card streams, Markdown of HTML: commits, restarts, long and odd names."""

import os

import pytest
from pyspark.sql import functions as F

from lectern.functions.markdown import html_markdown
from lectern.operators import export
from lectern.sources import files
from lectern.streaming import cards


def test_files_are_committed_together(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = [("a b+c%20.md", "one"), ("ü 日本.md", ""), ("x" * 500 + ".obsidian.md", "long"), ("n.md", None), (".dot", "x"), (None, "nameless")]
    df = spark.createDataFrame(rows, "name string, body string").repartition(3)
    said = files.write_files(df, path, spark.createDataFrame([(7,), (8,)], "id long"))
    assert (said["files"], said["missing"]) == (6, 2)
    got = {r["name"]: r["body"] for r in files.read_files(spark, path).collect()}
    long = files.short_name(rows[2][0])
    assert got == {"a b+c%20.md": "one", "ü 日本.md": "", long: "long", "n.md": "", ".dot": "x", "_": "nameless"} and len(long.encode()) <= files.NAME_BYTES
    assert sorted(r["id"] for r in files.read_missing(spark, path).collect()) == ["7", "8"]
    files.write_files(df.where("name = 'n.md'"), path, mode="overwrite")
    assert [r["name"] for r in files.read_files(spark, path).collect()] == ["n.md"] and len(os.listdir(f"{tmp_path}/out")) == 2
    files.write_files(df.where("name like 'a%'"), path)
    assert files.committed(path)["files"] == 2


def test_a_failed_write_leaves_nothing_to_read(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    bad = spark.range(6).select(F.concat(F.col("id").cast("string"), F.lit(".md")).alias("name"), F.when(F.col("id") == 5, F.raise_error(F.lit("stop"))).otherwise("x").alias("body")).repartition(2)
    with pytest.raises(Exception, match="stop"):
        files.write_files(bad, path)
    assert files.committed(path) is None and files.read_files(spark, path).collect() == []
    assert files.write_files(bad.where("name = 'none'"), path)["files"] == 0 and files.read_files(spark, path).collect() == []


def test_batches_number_names_and_report_missing_ids(spark):
    docs = spark.sql("""select id, 'T/1' as title, 'https://a.b' as source_url, cast(null as string) as canonical_url, cast(null as string) as author, timestamp'2024-01-02 03:04:05' as published_at, 'WEB_PAGE' as type, 'READY' as ingestion_status,
        cast(null as string) as content_html, '  body  ' as plain_text from values (1), (2), (3) as t(id)""")
    ids = spark.createDataFrame([(3, 0), (9, 1), (1, 2), (3, 3)], "id int, pos int")
    found, missing = export.batch(ids, docs, None, "markdown", "2024-05-06T07:08:09.000Z")
    got = {r["id"]: (r["name"], r["body"]) for r in found.collect()}
    assert {k: v[0] for k, v in got.items()} == {3: "T 1.md", 1: "T 1 (2).md"}
    assert got[3][1].startswith('---\ntitle: "T/1"\nsource_url: "https://a.b"\ncanonical_url: null\nauthor: null\npublished_at: "2024-01-02T03:04:05.000Z"\n') and got[3][1].endswith("---\n\nbody")
    assert [r["id"] for r in missing.collect()] == [9]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<h2>A <b>b</b></h2><p>one<br>two</p>", "## A **b**\n\none  \ntwo"), ("<ol><li>x</li><li><i>y</i></li></ol><ul><li>z</li></ul>", "1. x\n2. _y_\n\n* z"), ("<blockquote><p>q</p><p>r</p></blockquote><hr>", "> q\n> \n> r\n\n---"),
        ('<p><a href="https://a.b?x=1&amp;y=2">l</a> <img alt="i" src="s.png"> <img src="t.png"></p>', "[l](https://a.b?x=1&y=2) ![i](s.png) ![](t.png)"), ("<pre><code>a  &lt;b&gt;\n\n\n  c</code></pre><p>d</p>", "```\na  <b>\n\n\n  c\n```\n\nd"),
        ("plain &amp;lt; <code>c</code> <del>d</del>", "plain &lt; `c` ~~d~~"), ("", ""), (None, None),
    ],
)
def test_markdown_of_html(spark, html, want):
    assert spark.createDataFrame([(html,)], "h string").select(html_markdown(F.col("h")).alias("m")).first()["m"] == want


def _cards(spark, rows):
    return spark.createDataFrame(rows, "id string, update_time long, title string")


def test_card_pages(spark, tmp_path):
    path = f"file://{tmp_path}/cards"
    cards.write_replay(_cards(spark, [(f"c{i:02}", i // 4 * 10, "t") for i in range(23)] + [(None, 1, ""), ("x", None, "")]), path)
    service, cursor, sizes, seen = cards.ReplayedCards(path), cards.START, [], []
    while True:
        page, more = service.list_cards(cursor, 5)
        sizes.append((len(page), more))
        seen += page["id"].to_pylist()
        if not more:
            break
        cursor = (page["update_time"][-1].as_py(), page["id"][-1].as_py())
    assert seen == [f"c{i:02}" for i in range(23)] and sizes == [(5, True)] * 4 + [(3, False)]
    reader = cards.CardStream(service, 5, 3)
    end = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), end)
    assert len(parts) == 3 and [x for p in parts for b in reader.read(p) for x in b.column("id").to_pylist()] == seen
    assert reader.partitions(end, end) == []


def test_no_card_twice_after_a_restart(spark, tmp_path):
    path, out, check = (f"file://{tmp_path}/{x}" for x in ("cards", "out", "check"))
    os.makedirs(f"{tmp_path}/cards")
    schema = _cards(spark, []).schema
    run = lambda: cards.import_cards(spark, cards.ReplayedCards(path), schema, out, check, 4).awaitTermination()
    run()  # the service has no card yet
    for rows in ([(f"a{i}", 5 + i // 3, "one") for i in range(17)], [], [("b", 10, "same time as the last"), ("b2", 11, "later"), ("a3", 12, "changed")]):
        if rows:
            cards.write_replay(_cards(spark, rows), path)
        run()
    got = spark.read.parquet(out).collect()
    assert sorted(r["id"] for r in got) == sorted([f"a{i}" for i in range(17)] + ["a3", "b", "b2"])
    assert any(r["has_more"] for r in got) and not all(r["has_more"] for r in got)
