"""Feeds: kind, discovery, RSS and Atom entries, incremental sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.columns import let
from lectern.functions.dates import feed_date
from lectern.functions.text import ENTITIES, categories_match, collapse, distinct_folded, fallback_id, feed_excerpt, text_hash
from lectern.functions.urls import hostname, normalize_url, resolve_url, site_url
from lectern.operators.durable import Stored, stored
from lectern.operators.filters import published_since


def feed_kind(body: Column, content_type: Column) -> Column:
    """rss or atom, by content type or else by the body's markers; null for anything else."""
    return F.when(content_type.rlike("(?i)rss"), "rss").when(content_type.rlike("(?i)atom"), "atom").when(body.rlike(r"(?i)<(?:rss|rdf:RDF)[\s>]"), "rss").when(body.rlike(r"(?i)<feed[\s>]"), "atom")


def discover_feed(html: Column, base: Column) -> Column:
    """The first alternate link of a feed type in a page, resolved."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0))
    feeds = F.filter(tags, lambda t: t.rlike(r"(?i)\brel\s*=\s*[\"'][^\"']*\balternate\b") & t.rlike(r"(?i)\btype\s*=\s*[\"']application/(?:rss|atom)\+xml"))
    href = F.nullif(F.regexp_extract(F.get(feeds, 0), r"(?i)\bhref\s*=\s*[\"']([^\"']+)[\"']", 1), F.lit(""))
    return resolve_url(href, base)


#: Elements of entries and of feeds, as the XML reader types them: lists, since each may repeat; _bad holds what it cannot read.
_RSS_ITEM = ", ".join(f"`{n}` array<string>" for n in ("title", "link", "guid", "category", "author", "dc:creator", "creator", "pubDate", "dc:date", "content:encoded", "encoded", "description")) + ", _bad string"
_LINKS = "link array<struct<_href string, _rel string>>"
_ATOM_ENTRY = (
    f"title array<string>, {_LINKS}, id array<string>, category array<struct<_term string, _VALUE string>>, author array<struct<name array<string>, _VALUE string>>, "
    "published array<string>, updated array<string>, content array<string>, summary array<string>, _bad string"
)
_RSS_FEED = "channel array<struct<title array<string>, link array<string>, language array<string>>>, _bad string"
_ATOM_FEED = f"title array<string>, {_LINKS}, `_xml:lang` string, _lang string, _bad string"
#: Titles of items and feeds that have none.
UNTITLED_ITEM, UNTITLED_FEED = "Untitled item", "Untitled feed"


def _xml(text: Column, schema: str) -> Column:
    """A text read by a schema. One that is no XML is read again without characters that XML has not and with its bare ampersands escaped."""
    read = lambda t: F.from_xml(t, schema, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    mended = F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", ""), r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)", "&amp;")
    return let(read(text), lambda x: F.when(x["_bad"].isNotNull(), read(mended)).otherwise(x))


def _clean(c: Column) -> Column:
    """A text without white space at its ends; blank gives null. The end is \\z, since $ is also before a last line separator, as U+0085 is one."""
    return F.when(c.rlike(r"\S"), F.regexp_replace(c, r"^\s+|\s+\z", ""))


def _first(values: Column) -> Column:
    return _clean(F.get(values, 0))


def _plain(html: Column) -> Column:
    """The text of HTML on one line; tags leave no space. Null counts as empty. Texts without tags or entities are not searched for them."""
    bare = F.coalesce(html, F.lit(""))
    t = F.regexp_replace(bare, r"(?s)<!--.*?-->|<[^>]*>", "")
    for name, char in ENTITIES:
        t = F.regexp_replace(t, f"(?i)&{name};", char)
    t = F.when(F.contains(bare, F.lit("<")) | F.contains(bare, F.lit("&")), t).otherwise(bare)
    return F.trim(F.regexp_replace(t, r"\s{2,}|[\t\n\x0B\f\r]", " "))


def _alternate(links: Column) -> Column:
    """The address of the first link without a relation, or to the alternate form."""
    usable = F.filter(links, lambda x: F.lower(F.coalesce(x["_rel"], F.lit(""))).isin("", "alternate"))
    return F.get(usable, 0)["_href"]


def feed_headers(feeds: DataFrame) -> DataFrame:
    """feed_id, kind, title, site_url and lang of feeds (feed_id, feed_url, xml): what stands before their entries.

    A feed without a title has its host's name; an Atom feed without a link has the site of its own URL. Texts that are no feed give no row.
    """
    kind = feed_kind(F.col("xml"), F.lit(None).cast("string"))
    head = F.regexp_replace("xml", r"(?s)<(item|entry)[\s>].*</\1\s*>", "")
    rows = feeds.select("feed_id", "feed_url", kind.alias("kind"), head.alias("head")).where("kind is not null")
    atom = F.col("kind") == "atom"
    read = rows.withColumns({"_r": F.when(~atom, _xml(F.col("head"), _RSS_FEED)), "_a": F.when(atom, _xml(F.col("head"), _ATOM_FEED))})
    channel = F.get("_r.channel", 0)
    title = F.when(atom, _first(F.col("_a.title"))).otherwise(_first(channel["title"]))
    origin = F.nullif(F.regexp_extract("feed_url", r"^(?i)(https?://[^/?#\s]+)", 1), F.lit(""))
    site = F.when(atom, F.coalesce(resolve_url(_alternate(F.col("_a.link")), F.col("feed_url")), origin)).otherwise(resolve_url(_first(channel["link"]), F.col("feed_url")))
    lang = F.when(atom, F.coalesce(_clean(F.col("_a.`_xml:lang`")), _clean(F.col("_a._lang")))).otherwise(_first(channel["language"]))
    return read.select("feed_id", "kind", F.coalesce(title, hostname(F.col("feed_url")), F.lit(UNTITLED_FEED)).alias("title"), site_url(site).alias("site_url"), lang.alias("lang"))


def entries(feeds: DataFrame, *keep: str) -> DataFrame:
    """A row for each entry of feeds (feed_id, feed_url, xml, and the columns to keep), RSS items or Atom entries, in order of pos.

    Entries are cut out of their feed and read by the XML reader, each once: the condition on their text is on an exploded column, since
    Catalyst would copy the reader into a condition on a projected one. Those without a text go. Without a title an entry has its URL
    for one; without an id its id is its URL, else a hash of title, text and date.
    """
    atom = feed_kind(F.col("xml"), F.lit(None).cast("string")) == "atom"
    items = F.when(atom, F.regexp_extract_all("xml", F.lit(r"(?s)<entry[\s>].*?</entry\s*>"), F.lit(0))).otherwise(F.regexp_extract_all("xml", F.lit(r"(?s)<item[\s>].*?</item\s*>"), F.lit(0)))
    # what needs the whole feed is taken before the explosion, so no row of an entry carries its feed
    rows = feeds.select("feed_id", "feed_url", *keep, atom.alias("atom"), items.alias("items")).select("feed_id", "feed_url", *keep, "atom", F.posexplode_outer("items").alias("pos", "item")).where("item is not null")
    is_atom, r, a = F.col("atom"), F.col("_r"), F.col("_a")
    read = rows.withColumns({"_r": F.when(~is_atom, _xml(F.col("item"), _RSS_ITEM)), "_a": F.when(is_atom, _xml(F.col("item"), _ATOM_ENTRY))}).drop("item")
    either = lambda x, y: F.when(is_atom, y).otherwise(x)
    author = either(F.coalesce(_first(r["author"]), _first(r["dc:creator"]), _first(r["creator"])), F.coalesce(_first(F.get(a["author"], 0)["name"]), _clean(F.get(a["author"], 0)["_VALUE"])))
    said = either(F.coalesce(_first(r["pubDate"]), _first(r["dc:date"])), F.coalesce(_first(a["published"]), _first(a["updated"])))
    content = either(F.coalesce(_first(r["content:encoded"]), _first(r["encoded"]), _first(r["description"])), F.coalesce(_first(a["content"]), _first(a["summary"])))
    cats = either(r["category"], F.transform(a["category"], lambda x: F.coalesce(x["_term"], x["_VALUE"])))
    listed = F.coalesce(F.filter(F.transform(cats, collapse), lambda c: c.isNotNull()), F.array().cast("array<string>"))
    guid = either(_first(r["guid"]), _first(a["id"]))
    out = read.select(
        "feed_id", "feed_url", "atom", "pos", *keep, either(_first(r["title"]), _first(a["title"])).alias("title"), resolve_url(_clean(either(F.get(r["link"], 0), _alternate(a["link"]))), F.col("feed_url")).alias("url"), author.alias("author"),
        feed_date(said).alias("published_at"), content.alias("_content"), distinct_folded(listed).alias("categories"), guid.alias("guid"),
    )
    out = out.select("*", F.explode(F.array(_plain(F.col("_content")))).alias("plain_text")).drop("_content").where("plain_text <> ''")
    at = F.coalesce("url", F.when(~is_atom, resolve_url(F.col("guid"), F.col("feed_url"))))
    out = out.withColumns({"title": F.coalesce("title", "url", F.lit(UNTITLED_ITEM)), "text_hash": text_hash(F.col("plain_text"), "feed"), "_at": at})
    day = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return out.withColumns({
        "external_id": F.coalesce("guid", "_at", fallback_id(F.col("title"), F.col("text_hash"), day)), "excerpt": feed_excerpt(F.col("plain_text")), "dedupe_url": normalize_url(F.col("_at")),
    }).drop("guid", "feed_url", "atom", "_at")


REASONS = ["category", "backfill", "external_id", "url", "content", "imported"]


def gated(new: DataFrame, stored: DataFrame, feeds: DataFrame) -> DataFrame:
    """new with known: why an entry goes whatever the others of its batch are (its feed's filters, or a stored document); else null.

    Keys of stored documents are matched by equi joins; feeds (feed_id, include, backfill) is a dimension.
    """
    rows = new.join(feeds.select("feed_id", "include", "backfill"), "feed_id", "left")
    gate = F.when(~categories_match(F.col("categories"), F.col("include")), "category").when(~published_since(F.col("backfill")), "backfill")
    mark = lambda name, *keys: stored.select(*keys).dropna().distinct().withColumn(name, F.lit(True))
    for name, *keys in (("k1", "external_id"), ("k2", "feed_id", "dedupe_url"), ("k3", "feed_id", "title", "text_hash")):
        rows = rows.join(mark(name, *keys), keys, "left")
    known = F.coalesce(gate, F.when(F.col("k1"), "external_id"), F.when(F.col("k2"), "url"), F.when(F.col("k3"), "content"))
    return rows.select("feed_id", "pos", "external_id", "dedupe_url", "title", "text_hash", known.alias("known"))


def entry_keys(rows: DataFrame) -> DataFrame:
    """feed_id, pos, kind and the two values of each key that an entry has: entries of a feed that share one are duplicates.

    Kinds are numbered in the order in which they count. An entry without a URL has no such key; a missing title or text is a value.
    """
    text = F.struct(F.lit(2).alias("kind"), F.coalesce("title", F.lit("")).alias("a"), F.coalesce("text_hash", F.lit("")).alias("b"))
    plain = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.coalesce(c, F.lit("")).alias("a"), F.lit("").alias("b"))
    keys = F.array(plain(0, "external_id"), F.when(F.coalesce("dedupe_url", F.lit("")) != "", plain(1, "dedupe_url")), text)
    return rows.select("feed_id", "pos", F.explode(F.array_compact(keys)).alias("k")).select("feed_id", "pos", "k.*")


_KEY = ["feed_id", "kind", "a", "b"]


def first_comers(keys: DataFrame) -> DataFrame:
    """feed_id and pos of the entries that a greedy pass in the order of pos takes: those that share no key with one taken before.

    keys is as entry_keys() gives them. Keys that one entry has alone decide nothing, so they are counted out first. Then rounds:
    an entry that is the first undecided one under all its keys is taken, those that share a key with it are not. An entry is never
    gathered with the others of its feed: a round is a minimum for each key and equi joins. There are as many rounds as the longest
    chain of entries that wait for each other, and each round has only the entries that are still undecided.
    """
    held = Stored(keys.sparkSession)
    shared = keys.groupBy(*_KEY).agg(F.count("*").alias("n")).where("n > 1").select(*_KEY)
    left = held.keep("undecided", keys.join(shared, _KEY))
    ids = ["feed_id", "pos"]
    taken = keys.select(*ids).distinct().join(left.select(*ids).distinct(), ids, "left_anti")  # without any conflict
    taken = stored(taken, "taken")
    while not left.isEmpty():
        first = left.groupBy(*_KEY).agg(F.min("pos").alias("first"))
        now = left.join(first, _KEY).groupBy(*ids).agg(F.bool_and(F.col("pos") == F.col("first")).alias("wins")).where("wins").select(*ids)
        now = stored(now, "taken")
        won = left.join(now, ids).select(*_KEY).distinct()
        out = left.join(won, _KEY, "left_semi").select(*ids).distinct()  # those taken, and those that share a key with them
        left = held.keep("undecided", left.join(out, ids, "left_anti"))
        taken = taken.unionByName(now)
    held.drop("undecided")
    return stored(taken, "taken")


def sync(new: DataFrame, stored_rows: DataFrame, feeds: DataFrame) -> DataFrame:
    """feed_id, pos, external_id, reason (one of REASONS) and alone of new entries (feed_id, pos, external_id, dedupe_url, title, text_hash,
    categories, published_at); alone tells that no other entry of the batch had a say.

    stored_rows has the documents of earlier runs with the same key columns. Within the batch an entry that is skipped never makes
    a later one a duplicate; which entries are taken is first_comers(), so no feed is in one task. pos must be unique in its feed.
    """
    rows = stored(gated(new, stored_rows, feeds), "gated")
    keys = stored(entry_keys(rows.where("known is null")), "entry-keys")
    taken = first_comers(keys)
    # under each key one entry at most was taken: it is what later ones repeat
    holders = keys.join(taken, ["feed_id", "pos"]).select(*_KEY, F.col("pos").alias("holder"))
    said = keys.join(holders, _KEY).where("holder < pos").groupBy("feed_id", "pos").agg(F.min("kind").alias("kind"))
    shared = keys.groupBy(*_KEY).agg(F.count("*").alias("n")).where("n > 1")
    met = keys.join(shared.select(*_KEY), _KEY).select("feed_id", "pos").distinct().withColumn("met", F.lit(True))
    out = rows.join(said, ["feed_id", "pos"], "left").join(met, ["feed_id", "pos"], "left")
    repeated = F.get(F.array(*map(F.lit, ("external_id", "url", "content"))), F.col("kind"))
    return out.select("feed_id", "pos", "external_id", F.coalesce("known", repeated, F.lit("imported")).alias("reason"), F.col("met").isNull().alias("alone"))


def sync_stats(synced: DataFrame, *by: str) -> DataFrame:
    """Counts of each reason by feed, or by other columns."""
    return synced.groupBy(*(by or ("feed_id",))).agg(*[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])


def sync_totals(synced: DataFrame) -> DataFrame:
    """Counts of each reason over all feeds, and the number of feeds, as one row."""
    return synced.agg(F.countDistinct("feed_id").alias("feeds"), *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])


def sync_state(feeds: DataFrame, runs: DataFrame) -> DataFrame:
    """feeds with the state of their latest run (feed_id, finished_at, status, error, title, site_url); title and site only if it has them."""
    last = runs.groupBy("feed_id").agg(F.max_by(F.struct("finished_at", "status", "error"), "finished_at").alias("x"), F.max_by("title", F.when(F.col("title").isNotNull(), F.col("finished_at"))).alias("new_title"), F.max_by("site_url", F.when(F.col("site_url").isNotNull(), F.col("finished_at"))).alias("new_site"))
    out = feeds.drop("last_synced_at", "status", "error").join(last, "feed_id", "left")
    return out.withColumns({"title": F.coalesce("new_title", "title"), "site_url": F.coalesce("new_site", "site_url"), "last_synced_at": F.col("x.finished_at"), "status": F.col("x.status"), "error": F.col("x.error")}).drop("x", "new_title", "new_site")
