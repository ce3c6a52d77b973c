"""Reading-corpus operators on small frames: boundaries, nulls, ties and golden cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lectern.functions import dates, text, urls
from lectern.operators import dedupe, filters, highlights, identity, jobs, scans
from lectern.plans import registry
from lectern.sources import feeds, pages, readable, scripts, transcripts


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "want"),
    [("HTTPS://A.com/x/?utm_source=1&b=2&ref=z#top", "https://a.com/x/?b=2#top"), ("http://a.com", "http://a.com"), ("http://a.com/p/", "http://a.com/p"), ("not a url", "not a url"), ("http://a.com/?refs=1", "http://a.com/?refs=1"), (None, None),
     ("http://a.com/?b=x y", "http://a.com/?b=x y"), ("http://a.com/?b=x%20y&c=%7E~&&d", "http://a.com/?b=x+y&c=%7E%7E&d="), ("http://a.com/?%75tm_a=1&b=100%&c=a=b", "http://a.com/?b=100%25&c=a%3Db"), ("http://a.com/?=v&k=%ff", "http://a.com/?=v&k=%EF%BF%BD")],
)
def test_normalize_url(spark, url, want):
    assert one(spark, url, urls.normalize_url) == want


def test_query_value(spark):
    url = "https://a.org/?a=1%2B2&a=3&b&c=x+y"
    assert [one(spark, url, lambda c, k=k: urls.query_value(c, k)) for k in "abcd"] == ["1+2", "", "x y", None]
    assert one(spark, "https://a.org/?qa%5Fx=1", urls.is_test_url, "string") is True


def test_urls(spark):
    assert one(spark, "https://mp.weixin.qq.com/s?__biz=B&mid=1&idx=2&sn=s&x=9", urls.wechat_canonical) == "https://mp.weixin.qq.com/s?__biz=B&mid=1&idx=2&sn=s"
    assert one(spark, "https://m.youtube.com/watch?v=abcdefghijk&t=1m5s", lambda c: urls.video_identity(c))["start_seconds"] == 65
    assert one(spark, "https://example.com/", urls.video_identity) is None
    assert one(spark, "../b?c", lambda c: urls.resolve_url(c, F.lit("https://a.com/x/y/z"))) == "https://a.com/x/b?c"
    assert one(spark, "mailto:a@b", lambda c: urls.resolve_url(c, F.lit("https://a.com/x"))) is None
    assert one(spark, " ftp://a ", urls.capture_url) is None
    assert one(spark, "https://a.com?qa_x=1", urls.is_test_url) is True


@pytest.mark.parametrize(
    ("value", "base", "want"),
    [
        ("../x", "https://example.com/page", "https://example.com/x"), ("../../../../x", "https://example.com/a/b/c/d/e", "https://example.com/x"), ("../../x", "https://example.com", "https://example.com/x"),
        ("./x/./y/..", "https://a.com/d/e", "https://a.com/d/x/"), ("..", "https://a.com/d/e/f", "https://a.com/d/"), ("/p/../q/.", "https://a.com/d", "https://a.com/q/"), ("//b.org/../x", "http://a.com", "http://b.org/x"),
        ("?q=../a", "https://a.com/d/e", "https://a.com/d/e?q=../a"), ("x?q=/../a#/../b", "https://a.com/d/e", "https://a.com/d/x?q=/../a#/../b"), ("https://b.org/a/../../c", "x", "https://b.org/c"), ("a..b/..c", "https://a.com/d/", "https://a.com/d/a..b/..c"),
        ("#x", "https://a.com", None), (" ", "https://a.com", None), (None, "https://a.com", None), ("/".join([".."] * 500) + "/x", "https://a.com/" + "d/" * 600, "https://a.com/" + "d/" * 100 + "x"),
    ],
)
def test_resolve_url(spark, value, base, want):
    assert one(spark, value, lambda c: urls.resolve_url(c, F.lit(base))) == want


def test_pages_that_parsers_refuse(spark):
    rows = [(1, "https://a.com/x", "<p>one</p><![foo[x]]><p>two</p>"), (2, "http://[bad/x", "<p>three</p>"), (3, "https://a.com", "<p>four</p><![foo[")]
    got = {r["page_id"]: r["plain_text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert "one" in got[1] and "two" in got[1] and got[2] == "three" and got[3].startswith("four")


def test_text(spark):
    assert one(spark, "<h1>A</h1><p>b &amp; c<br>d</p>", text.html_to_text) == "A\nb & c\nd"
    assert one(spark, "x" * 221, text.feed_excerpt) == "x" * 220 + "…" and one(spark, "x" * 220, text.feed_excerpt) == "x" * 220
    assert one(spark, "你好 it's a-b 12", text.readable_units) == 5 and one(spark, "ᄀ 한글 かな ア 〇 é x\u0001y z", text.readable_units) == 10 and one(spark, None, text.readable_units) == 0
    assert one(spark, "By: Jane Doe", text.byline_author) == "Jane Doe" and one(spark, "https://x.y", text.author) is None
    assert one(spark, "# T\n\n- a **b**\n\n[l](https://x.y)", text.markdown_text) == "T\n\na b\n\nl"
    assert one(spark, "A, b，a\nC", text.categories) == ["A", "b", "C"]
    assert one(spark, 'q"\\', lambda c: text.yaml_line("k", c)) == 'k: "q\\"\\\\"'


def test_dates(spark):
    show = lambda v, f: one(spark, v, lambda c: f(c).cast("string"))
    assert show("1704067200", dates.page_date) == show("1704067200000", dates.page_date) == "2024-01-01 00:00:00"
    assert show("2024年1月2日", dates.page_date) == "2024-01-01 16:00:00"
    assert show("Mon, 01 Jan 2024 10:00:00 +0200", dates.feed_date) == "2024-01-01 08:00:00" and show("soon", dates.feed_date) is None
    assert one(spark, "01:02:03.5", dates.vtt_seconds) == 3723.5 and one(spark, "02:03", dates.vtt_seconds) == 123


def test_seven_days_are_strict(spark):
    df = spark.sql("select timestamp'2024-01-08 00:00:00' as now, explode(array(timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 00:00:00.001', timestamp'2025-01-01 00:00:00')) as t")
    assert [r[0] for r in df.select(filters.recent(F.col("t"), F.col("now"))).collect()] == [False, True, True]


def test_majority_vote(spark):
    rows = [("a", "x")] * 7 + [("a", "y")] * 3 + [("b", "x")] * 2 + [("b", "y")] + [("c", "z")] + [("d", "p")] * 69 + [("d", "q")] * 31
    df = spark.createDataFrame([(i, n, b) for i, (n, b) in enumerate(rows)], "id int, nickname string, biz string")
    assert {r["nickname"]: r["biz"] for r in identity.preferred_biz(df).collect()} == {"a": "x", "b": None, "c": "z", "d": None}


def test_redirect_cycles_end(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "url string, target_url string")
    got = {r["url"]: (r["final_url"], r["hops"]) for r in identity.follow_redirects(df).collect()}
    assert got["a"] == ("c", 2) and got["x"] == ("y", 1)


def test_merge_keeps_highlights(spark):
    docs = spark.sql("select id, k as dedupe_key, h as highlights, false as has_summary, timestamp_seconds(id) as created_at, s as read_state from values (1,'k',0,'READ'),(2,'k',2,'UNREAD'),(3,'l',0,'UNREAD'),(4,null,0,'READ') as t(id,k,h,s)")
    marks = spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "hid int, document_id int")
    tags = spark.createDataFrame([(1, "a"), (2, "a"), (1, "b")], "document_id int, slug string")
    kept, moved, tagged = dedupe.merge(docs, marks, tags)
    assert {(r["id"], r["read_state"]) for r in kept.collect()} == {(2, "READ"), (3, "UNREAD"), (4, "READ")}
    assert {r["document_id"] for r in moved.collect()} == {2} and moved.count() == 3 and tagged.count() == 2
    assert dedupe.audit(kept).count() == 0


def one_by_one(rows, taken=(), form="%s-%d"):
    """id to name, as a pass in the order of id gives them."""
    used, out = set(taken), {}
    for i, base in sorted(rows):
        n, name = 1, base
        while name in used:
            n += 1
            name = form % (base, n)
        used.add(name)
        out[i] = name
    return out


@pytest.mark.parametrize(
    ("rows", "taken"),
    [
        ([(1, "a"), (2, "a"), (3, "a-2"), (4, "b")], []), ([(1, "a-2"), (2, "a"), (3, "a"), (4, "a"), (5, "a-2")], []), ([(i, "hot") for i in range(40)] + [(40, "hot-3"), (41, "hot-3"), (-1, "hot-20")], ["hot", "hot-5", "x"]),
        ([(i, ["a", "a-2", "a-2-2", "a-3"][i * 7 % 4]) for i in range(30)], ["a-4"]), ([], ["x"]),
    ],
)
def test_numbered_names(spark, rows, taken):
    df = spark.createDataFrame(rows, "id int, base string").repartition(3)
    got = {r["id"]: r["slug"] for r in dedupe.numbered(df, "base", taken=spark.createDataFrame([(t,) for t in taken], "name string")).collect()}
    assert got == one_by_one(rows, taken)


def test_scans_equal_windows(spark):
    """A key with most rows, a null key, ties in the order and nulls among the values, over more tasks than keys."""
    import random

    from pyspark.sql import Window

    r = random.Random(9)
    rows = [(i, r.choice(["hot"] * 6 + ["b", "c", None]), r.randrange(60), r.choice([None, None, r.randrange(9)])) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, k string, t int, v int").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 13):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            order = [F.col("t").desc(), F.col("id").asc()]
            w = Window.partitionBy("k").orderBy(*order)
            want = df.withColumns({"rank": F.row_number().over(w).cast("long"), "next": F.lead("id").over(w)})
            got = scans.ranked(scans.with_next(df, "k", order, "id", "next"), "k", order, "rank")
            assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
            for down in (True, False):
                by = F.col("t").desc() if down else F.col("t").asc()
                last = F.last("v", True).over(Window.partitionBy("k").orderBy(by).rangeBetween(Window.unboundedPreceding, -1))
                got = scans.with_last(df, "k", "t", "v", "last", down)
                assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, df.withColumn("last", last).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_redirects_by_doubling(spark):
    """A chain of 1,000 hops, cycles with and without ways into them, and many URLs that lead to one."""
    import random

    r = random.Random(4)
    links = [(f"c{i}", f"c{i + 1}") for i in range(1000)] + [("s", "s"), ("t", "s")] + [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [("x0", "x1"), ("x1", "x2"), ("x2", "r3")]
    links += [(f"h{i}", "c990") for i in range(50)] + [(f"n{i}", f"n{r.randrange(60)}") for i in range(50)] + [("c0", "zz"), (None, "a"), ("a", None)]
    to = {}
    for a, b in links:
        if a is not None and b is not None:
            to[a] = min(b, to.get(a, b))
    want = []
    for url in to:
        at, seen = url, {url}
        while to.get(at, at) not in seen:
            at = to[at]
            seen.add(at)
        want.append((url, at, len(seen) - 1))
    got = identity.follow_redirects(spark.createDataFrame(links, "url string, target_url string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_anchoring():
    doc = "He said “well — known” and well—known again"
    assert highlights.anchor_all(doc, [("a", '"well-known"', None, None), ("b", "well - known", None, None), ("c", "x", 0, 2), ("d", "absent", None, None)]) == [("a", 8, 22), ("b", 27, 37), ("c", 0, 2)]


def test_entries_of_odd_feeds(spark):
    """Items that are no XML, that repeat elements, lack title, id, link or text, and hold markup; ids by link, guid and hash."""
    items = [
        "<item><title>bad & x</title><description>a &nbsp; b</description><guid isPermaLink='false'>g</guid></item>", "<item><link>p</link><description><![CDATA[<p>one</p><p>two</p>]]></description><author>A</author><dc:creator>B</dc:creator></item>",
        "<item><title>t</title><description>c <b>bold</b></description><pubDate>soon</pubDate></item>", "<item><title>no text</title><link>q</link></item>", "<item><title>1</title><title>2</title><content:encoded>x</content:encoded><description>y</description><guid>https://g.org/1</guid><category> A  b</category><category>a B</category></item>",
        "<item/>", "<item><description>\x01z</description></item>",
    ]
    xml = "<rss xmlns:dc='d' xmlns:content='c'><channel>" + "".join(items) + "</channel></rss>"
    rows = feeds.entries(spark.createDataFrame([("f", "https://f.org/feed", xml), ("n", "u", None), ("x", "u", "no feed")], "feed_id string, feed_url string, xml string")).orderBy("pos").collect()
    assert [(r["title"], r["url"], r["plain_text"]) for r in rows] == [
        ("bad & x", None, "a b"), ("https://f.org/p", "https://f.org/p", "onetwo"), ("t", None, "c bold"), ("1", None, "x"), ("Untitled item", None, "z"),
    ]
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert [r["external_id"] for r in rows] == ["g", "https://f.org/p", sha("t|" + sha("c bold")), "https://g.org/1", sha("Untitled item|" + sha("z"))]
    assert rows[0]["dedupe_url"] == "https://f.org/g" and rows[3]["dedupe_url"] == "https://g.org/1" and rows[3]["categories"] == ["A b"] and rows[1]["author"] == "A"


def naive_anchors(text, marks):
    """Marks anchored one after the other, each by a search of its own."""
    quotes = {**dict.fromkeys(highlights.SINGLE, "'"), **dict.fromkeys(highlights.DOUBLE, '"')}

    def fold(t):
        out, i = [], 0
        while i < len(t):
            j = i + 1
            if t[i] in highlights.DASHES:
                while j < len(t) and t[j] in highlights.DASHES:
                    j += 1
                out.append(("-", i, j))
            elif not t[i].isspace():
                out.append((quotes.get(t[i], t[i]), i, j))
            i = j
        return out

    flat, taken, made = fold(text), [], []
    line = "".join(c for c, _, _ in flat)
    for ident, quote, start, end in marks:
        if start is not None and end is not None and 0 <= start < end:
            taken.append((start, end))
            made.append((ident, start, end))
            continue
        w = "".join(c for c, _, _ in fold(quote or ""))
        at = line.find(w) if w else -1
        while at >= 0:
            a, b = flat[at][1], flat[at + len(w) - 1][2]
            if not any(x < b and a < y for x, y in taken):
                taken.append((a, b))
                made.append((ident, a, b))
                break
            at = line.find(w, at + 1)
    return made


def test_anchors_equal_one_by_one():
    import random

    r = random.Random(11)
    for _ in range(300):
        text = "".join(r.choice("ab ab-—'’“ \n😀") for _ in range(r.randrange(60)))
        marks = []
        for k in range(r.randrange(12)):
            at = r.randrange(len(text) + 1)
            quote = r.choice([text[at : at + r.randrange(6)], "a b", "", None, "—-", "ba"])
            marks.append((k, quote, r.choice([None, None, at]), r.choice([None, at + r.randrange(4)])))
        assert highlights.anchor_all(text, marks) == naive_anchors(text, marks)


def test_many_quotes_of_one_text():
    import time

    words = [f"w{i % 5000}x" for i in range(60_000)]
    text = " ".join(words)
    marks = [(i, f"{words[i]} {words[i + 1]}", None, None) for i in range(10_000)] + [(-i, "w7x", None, None) for i in range(1, 2000)]
    start = time.time()
    got = highlights.anchor_all(text, marks)
    assert time.time() - start < 10 and len(got) >= 10_000
    assert got[:50] == naive_anchors(text, marks[:50])


def test_quote_query_equals_one_by_one(spark):
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("needs the given tables")
    got = {r["document_id"]: (r["start"], r["end"]) for r in registry.queries()["quote_anchor_folded"](spark, folder).collect()}
    want = {}
    for d in spark.read.parquet(f"{folder}/documents.parquet").collect():
        quote = "".join("  \n " if c in " \t\n\x0b\f\r" else c for c in d["text"][11:71])
        want.update({d["doc_id"]: a[1:] for a in naive_anchors(d["text"], [("q", quote, None, None)])})
    assert got == want


def test_paragraphs_and_segments(spark):
    df = spark.createDataFrame([(1, "ab\n\n  \n\n\ncdef")], "id int, text string")
    assert [tuple(r)[1:] for r in highlights.paragraphs(df).collect()] == [(0, 0, 2, "ab"), (1, 9, 13, "cdef")]
    marks = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(i).alias("id")) for a, b, i in ((1, 3, "m"), (2, 4, "o"))])
    assert [(s["type"], s["text"]) for s in one(spark, "abcdef", lambda c: highlights.segments(c, marks))] == [("text", "a"), ("highlight", "bc"), ("text", "def")]


def test_transcripts(spark):
    vtt = "WEBVTT\n\n00:01.000 --> 00:03.000\n<b>one</b>\n\n00:02.000 --> 00:04.000\ntwo"
    json3 = '{"events":[{"tStartMs":1000,"segs":[{"utf8":"a"},{"utf8":"b"}]}]}'
    df = spark.createDataFrame([("v", "vtt", vtt), ("j", "json3", json3), ("x", "xml", '<transcript><text start="1">q &amp;amp; r</text></transcript>')], "video_id string, format string, payload string")
    got = {(r["video_id"], r["start"], r["end"], r["text"]) for r in transcripts.timeline(transcripts.segments(df)).collect()}
    assert got == {("v", 1.0, 2.0, "one"), ("v", 2.0, 4.0, "two"), ("j", 1.0, 3.0, "ab"), ("x", 1.0, 3.0, "q & r")}
    times = spark.createDataFrame([("v", 0.5), ("v", 1.5), ("v", 9.0)], "video_id string, at double")
    asked = {r["at"]: r["text"] for r in transcripts.active_segments(times, transcripts.timeline(transcripts.segments(df))).collect()}
    assert asked == {0.5: None, 1.5: "one", 9.0: "two"}


def test_embedded_objects(spark):
    found = lambda t: scripts.balanced_object(t, "var p")
    assert found('x var p = {"a": {"b": "}"}}; {') == '{"a": {"b": "}"}}' and found("var p = {'a': '\\'}'}") == "{'a': '\\'}'}"
    assert found("var p = {") is None and found('var p = {"a}') is None and found("none") is None and found("var p") is None
    long = 'var p = {"t": "' + "\\}{ " * 300_000 + '", "l": [' + "{}," * 100_000 + "{}]} }"
    assert found(long) == long[8:-2]
    assert one(spark, 'var p = {"a": [1, {"b": "c"}]};', lambda c: F.try_variant_get(scripts.embedded_json(c, "var p"), "$.a[1].b", "string")) == "c"
    assert one(spark, "var p = {bad}", lambda c: scripts.embedded_json(c, "var p").isNull())
    assert scripts.read_json_ld(["[" * 5000 + "]" * 5000, '{"author": "A"}', "x"])[0] == ["A"]


def test_feeds(spark):
    rss = '<rss><channel><item><title>A &amp; B</title><link>/p?utm_x=1</link><category>Review</category><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate><description><![CDATA[<p>Hi</p>]]></description></item><item></item></channel></rss>'
    atom = '<feed xmlns="a"><entry><id>i</id><title>T</title><link rel="self" href="s"/><link href="https://x.y/z"/><category term="c"/><updated>2024-01-02T00:00:00Z</updated><summary>S</summary></entry></feed>'
    got = {r["feed_id"]: r for r in feeds.entries(spark.createDataFrame([("r", "https://f.com/feed", rss), ("a", "https://x.y/f", atom)], "feed_id string, feed_url string, xml string")).collect()}
    assert got["r"]["title"] == "A & B" and got["r"]["url"] == "https://f.com/p?utm_x=1" and got["r"]["dedupe_url"] == "https://f.com/p" and got["r"]["plain_text"] == "Hi"
    assert got["a"]["external_id"] == "i" and got["a"]["url"] == "https://x.y/z" and got["a"]["categories"] == ["c"]
    assert one(spark, '<link rel="alternate" type="application/rss+xml" href="/f.xml">', lambda c: feeds.discover_feed(c, F.lit("https://a.com/b"))) == "https://a.com/f.xml"


def test_sync_is_greedy(spark):
    rows = [("f", 0, "a", "u1", "t1", "h1"), ("f", 1, "a", "u2", "t2", "h2"), ("f", 2, "b", "u2", "t3", "h3"), ("f", 3, "c", "u1", "t4", "h4"), ("f", 4, "d", "u5", "t1", "h1"), ("f", 5, "old", "u6", "t6", "h6")]
    new = spark.createDataFrame(rows, "feed_id string, pos int, external_id string, dedupe_url string, title string, text_hash string").withColumns({"categories": F.array(F.lit("Review")), "published_at": F.lit(None).cast("timestamp")})
    stored = new.where("false").unionByName(new.where("external_id = 'old'"))
    gate = spark.sql("select 'f' as feed_id, array('reviews') as include, cast(null as timestamp) as backfill")
    assert [r["reason"] for r in feeds.sync(new, stored, gate).orderBy("pos").collect()] == ["imported", "external_id", "imported", "url", "content", "external_id"]


def test_markdown_of_every_document(spark, tmp_path):
    texts = ["plain words", "# T\r\n\r\n\r\n- a **b** __c__", "![i](x.png) [l](https://x.y) `code`\n> q\n1. one ", "  edge *it* \n", None, "***"]
    want = ["plain words", "T\n\na b c", "l code\nq\none", "edge it", None, "***"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["t"] for r in registry.queries()["markdown_documents"](spark, str(tmp_path)).collect()}
    assert got == {i: x and hashlib.md5(x.encode()).hexdigest() for i, x in enumerate(want)}


def test_feeds_hold_whole_texts(spark, tmp_path):
    """Texts that differ after 200 characters only are other contents."""
    start = "same words " * 30
    spark.createDataFrame([(0, "x", "abc"), (1, start + "one", "abc"), (2, start + "two", "abc"), (4, start + "two", "abc")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["feed_sync"](spark, str(tmp_path)).first().asDict()
    assert {k: v for k, v in got.items() if v} == {"feed_id": "abc", "category": 1, "imported": 2, "content": 1}
    assert registry.queries()["feed_entries_whole"](spark, str(tmp_path)).first()["chars"] == 3 * (len(start) + 3) + 1


def greedy(rows):
    """feed, pos, reason of rows (feed, pos, external id, URL, title, hash, known), by the loop that the rounds stand for."""
    seen, out = {}, []
    for feed, pos, ext, url, title, text, known in sorted(rows):
        ids, urls, texts = seen.setdefault(feed, (set(), set(), set()))
        reason = known or ("external_id" if ext in ids else "url" if url and url in urls else "content" if (title, text) in texts else "imported")
        if reason == "imported":
            ids.add(ext)
            urls.add(url)
            texts.add((title, text))
        out.append((feed, pos, reason))
    return out


@pytest.mark.parametrize(("n", "feeds_", "ids", "chain"), [(10_000, 3, 4_000, 0), (300, 1, 40, 0), (60, 1, 1000, 60)])
def test_sync_equals_the_loop(spark, n, feeds_, ids, chain):
    """Random keys with a hot feed, nulls and many conflicts; and a chain in which each entry shares a key with the next one."""
    import random

    r = random.Random(n)
    rows = []
    for i in range(n):
        feed = f"f{r.randrange(feeds_) if r.random() < 0.3 else 0}"
        if chain:
            ext, url, text = (f"e{i // 2}", f"u{(i + 1) // 2}", f"t{i}")
        else:
            ext, url, text = f"e{r.randrange(ids)}", r.choice([None, "", f"u{r.randrange(ids)}"]), r.choice([None, "hot", f"t{r.randrange(ids)}"])
        rows.append((feed, i * 3, ext, url, r.choice([None, "title"]) if not chain else "", text))
    new = spark.createDataFrame(rows, "feed_id string, pos long, external_id string, dedupe_url string, title string, text_hash string")
    new = new.withColumns({"categories": F.array(F.lit("a")), "published_at": F.lit(None).cast("timestamp")}).repartition(5)
    gates = spark.sql("select 'f0' as feed_id, cast(array() as array<string>) as include, cast(null as timestamp) as backfill")
    got = [tuple(x)[:2] + (x["reason"],) for x in feeds.sync(new, new.where("false"), gates).collect()]
    assert sorted(got) == greedy([(*x[:4], x[4] or "", x[5] or "", None) for x in rows])


def test_pages(spark):
    body = "<p>" + "Readable words of an article go on here. " * 20 + "</p>"
    html = f'<html lang="EN"><head><title>Site</title><meta property="og:title" content="T"><meta name="author" content="By Ann"><meta property="article:published_time" content="2024-01-01T00:00:00Z"><link rel="canonical" href="/c"></head><body><nav><a href="/x">menu</a></nav><div class="sidebar"><a>ad</a></div><article><h1>T</h1>{body}<img data-src="https://i/x.png"></article></body></html>'
    df = spark.createDataFrame([(1, "https://a.com/p?q", html), (2, "u", None), (3, "u", "<p>verify you are human</p>")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in pages.extract(df).collect()}
    assert (got[1]["title"], got[1]["lang"], got[1]["canonical_url"], got[1]["author"], got[1]["error_code"]) == ("Site", "en", "https://a.com/c", "By Ann", None)
    assert "menu" not in got[1]["content_html"] and 'src="https://i/x.png"' in got[1]["content_html"] and got[1]["units"] == 161
    assert got[2]["error_code"] == "EXTRACTION_EMPTY" and got[3]["error_code"] == "SOURCE_VERIFICATION_REQUIRED"


def test_states(spark):
    rows = [(1, 1, 1, "open", None), (1, 2, 2, "progress", 150.0), (2, 3, 1, "progress", 40.0), (3, 4, 1, "read", None)]
    df = spark.createDataFrame(rows, "document_id int, event_id int, t int, kind string, progress double").withColumn("ts", F.timestamp_seconds("t"))
    assert {r["document_id"]: (r["progress"], r["read_state"]) for r in jobs.reading_states(df).collect()} == {1: (100.0, "UNREAD"), 2: (40.0, "READING"), 3: (100.0, "READ")}


def test_stream_appends_once(spark, tmp_path):
    from lectern.streaming import jobs as streams

    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "dedupe_key string, n int").write.parquet(f"{tmp_path}/in")
    for run in ("c1", "c2"):  # the second run starts anew and finds all keys stored
        src = streams.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
        streams.append_new(src, f"{tmp_path}/out", f"{tmp_path}/{run}").awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out").select("dedupe_key").collect()) == ["a", "b"]


def test_reading_states_survive_a_restart(spark, tmp_path):
    """Events in mixed order over several files; the query ends in the middle and goes on from its checkpoint."""
    import random

    from lectern.streaming import reading
    from lectern.streaming.jobs import file_stream

    r = random.Random(5)
    rows = [(r.randrange(7), i, 1_704_067_200 + r.randrange(50_000), r.choice(["open", "progress", "progress", "read" if i % 29 == 0 else "other"]), r.choice([None, -4.0, 30.0, 99.5, 250.0])) for i in range(400)]
    rows += [(None, 401, 1_704_067_200, "read", None), (8, 402, None, "read", None), (9, 403, 1_704_067_200, "open", None)]
    df = spark.createDataFrame(rows, "document_id long, event_id long, t long, kind string, progress double").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    for n, part in enumerate(df.randomSplit([1.0, 1.0, 1.0], 7)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if n != 1:  # ends after the first file, then goes on with two more
            stream = file_stream(spark, f"{tmp_path}/in", df.schema, 1)
            reading.fold_reading_states(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    known = df.where("document_id is not null and ts is not null")
    want = jobs.reading_states(known).withColumn("entered_at", F.unix_micros("entered_at"))
    got = reading.current_states(spark, f"{tmp_path}/out")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.max("version")).first()[0] > 1


def test_idle_documents_settle(spark, tmp_path):
    from lectern.streaming import reading
    from lectern.streaming.jobs import file_stream

    day = 86_400
    for rows in ([(1, 1, 9 * day, "open", None), (2, 2, 9 * day, "progress", 5.0)], [(2, 3, 30 * day, "progress", 50.0)], [(2, 4, 31 * day, "read", None)]):
        df = spark.createDataFrame(rows, "document_id long, event_id long, t long, kind string, progress double").withColumn("ts", F.timestamp_seconds("t")).drop("t")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = file_stream(spark, f"{tmp_path}/in", df.schema, 1)
        reading.fold_reading_states(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").where("settled").collect()
    assert [(x["document_id"], x["entered_at"], x["version"]) for x in rows if x["document_id"] == 1] == [(1, 9 * day * 10**6, 1)]


def test_dates_of_pages(spark):
    """Forms of dates that pages write: separators, times, the length of digits and the zone."""
    show = lambda c: one(spark, c, lambda x: F.date_format(dates.page_date(x), "yyyy-MM-dd HH:mm:ss"))
    assert show("2024/1/2") == show("2024-01-02") == show("2024.1.2") == "2024-01-01 16:00:00"
    assert show("2024年1月2日 10:30") == "2024-01-02 02:30:00" and show("2024-01-02T03:04:05Z") == "2024-01-02 03:04:05"
    assert show("17040672000") is None and show("946684799") is None and show("2024年13月2日") is None


def test_authors(spark):
    got = {t: one(spark, t, text.author) for t in ("By: Jane Doe,", "@jane", "原创 作者：张三", "data-x", "x" * 61, "2024/1/2", "微信扫一扫")}
    assert got == {"By: Jane Doe,": "Jane Doe", "@jane": "jane", "原创 作者：张三": "张三", "data-x": None, "x" * 61: None, "2024/1/2": None, "微信扫一扫": None}


def test_names_in_compatibility_form(spark):
    assert one(spark, "Ａ：Ｂ／c  ", text.file_name) == "A B c" and one(spark, "  ", text.file_name) == ""


def test_redirects_go_to_the_end(spark):
    df = spark.createDataFrame([(f"u{i}", f"u{i + 1}") for i in range(12)] + [("s", "s")], "url string, target_url string")
    got = {r["url"]: (r["final_url"], r["hops"]) for r in identity.follow_redirects(df).collect()}
    assert got["u0"] == ("u12", 12) and got["s"] == ("s", 0)


PARA = "This paragraph has enough plain words to count as content, and then some more of them follow here. " * 3


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f'<body><div class="sidebar">{PARA}</div><div class="article-body"><p>{PARA}</p><a href="b?x=1">rel</a><img data-src="/i.png" alt=" a  b "></div></body>', ['href="https://a.com/d/b?x=1"', 'src="https://a.com/i.png"', 'alt="a b"', "<p>"]),
        (f'<body><div id="js_content"><h2>Title</h2><p>作者 someone</p><p>{PARA}</p><p><a href="javascript:x()">plain link text</a> {PARA}</p></div></body>', ["plain link text"]),
        (f'<body><main><p>{PARA}</p><ul><li>one item that stays</li></ul><div class="share-bar">share this</div><p>Related articles</p><span>{PARA}</span></main></body>', ["<li>one item that stays</li>"]),
    ],
)
def test_readable_html(html, want):
    got, score = readable.readable(html, "https://a.com/d/e", "Title")
    assert all(w in got for w in want) and score > 40
    assert not any(x in got for x in ("sidebar", "作者", "<h2>", "javascript", "share this", "Related", "<span", "<div"))


def test_no_block_passes():
    short = "<body><div><p>few words</p></div></body>"
    assert readable.readable(short, "https://a.com", None) == ("<p>few words</p>", 0.0) and readable.readable(None, None, None) == ("", 0.0)


def test_promotion_at_the_end():
    assert readable.promo_start(["text", "（完）", "more", "扫描加入知识星球"]) == 3
    assert readable.promo_start(["text", "知识星球", "text", "......", "", "后台私信"]) == 3
    assert readable.promo_start(["text", "知识星球", "text"]) is None and readable.promo_start([]) is None


def test_deep_nesting_is_linear():
    deep = "<div>" * 20_000 + PARA + "</div>" * 20_000
    assert PARA.strip() in readable.readable(f"<body>{deep}</body>", "https://a.com", None)[0]


def test_pages_of_one_id_and_of_scripts(spark):
    body = f"<html><head><title>T</title></head><body><article><p>{PARA}</p></article></body></html>"
    inline = "<html><body><script>window.item_show_type = '10'; x({title: JsDecode('T'), content_noencode: JsDecode('one\\x0a\\x0atwo \\x26 three'), source_url: ''})</script></body></html>"
    video = '<html><head><meta property="og:type" content="video.other"><meta property="og:description" content="told"></head><body></body></html>'
    rows_ = [(1, "https://a.com/x", body), (1, "https://a.com/y", body), (2, "https://mp.weixin.qq.com/s/x", inline), (3, "https://v.com/1", video), (4, "https://a.com/z", None)]
    got = pages.extract(spark.createDataFrame(rows_, "page_id long, url string, html string")).collect()
    assert len(got) == 5
    by = {r["page_id"]: r for r in got}
    assert by[2]["plain_text"] == "one\ntwo & three" and by[2]["error_code"] is None
    assert by[3]["plain_text"] == "told\nVideo URL: https://v.com/1" and by[4]["error_code"] == "EXTRACTION_EMPTY"
