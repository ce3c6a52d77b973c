"""Which source and which publication a document belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.urls import WECHAT_HOST, hostname, query_value, source_host
from lectern.operators.durable import Stored, stored
from lectern.operators.filters import ListQuery, recent, select_documents

#: Fixed value: the label of publications that are not known.
UNKNOWN = "未识别公众号"
#: When one publication clearly owns a name.
LEAST_COUNT, LEAST_SHARE, LEAST_RATIO = 3, 0.7, 2


def resolve_sources(docs: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """docs with identity, label, kind and host: an explicit source, else the feed, else the host, else unknown.

    docs has source_id, source_title, feed_id, feed_title, source_url and canonical_url; aliases has kind, value and name.
    """
    own, feed = F.col("source_id").isNotNull() & F.col("source_title").isNotNull(), F.col("feed_id").isNotNull() & F.col("feed_title").isNotNull()
    out = docs.withColumn("host", source_host(F.col("canonical_url"), F.col("source_url")))
    out = out.withColumn("kind", F.when(own, "source").when(feed, "feed").when(F.col("host").isNotNull(), "domain").otherwise("unknown"))
    out = out.withColumn("value", F.when(own, F.col("source_id")).when(feed, F.col("feed_id")).otherwise(F.col("host")))
    label = F.when(own, F.col("source_title")).when(feed, F.col("feed_title")).otherwise(F.coalesce("host", F.lit("Unknown source")))
    identity = F.when(F.col("kind") == "source", F.concat(F.lit("source:"), F.col("value"))).when(F.col("kind") == "unknown", "source:unknown").otherwise(F.concat_ws(":", F.lit("source"), "kind", "value"))
    if aliases is None:
        return out.withColumns({"identity": identity, "label": label}).drop("value")
    named = aliases.where(F.col("kind").isin("feed", "domain")).select("kind", "value", F.col("name").alias("alias"))
    return out.join(named, ["kind", "value"], "left").withColumns({"identity": identity, "label": F.coalesce("alias", label)}).drop("value", "alias")


def source_groups(rows: DataFrame, now: Column | None = None, sort: str = "latest") -> DataFrame:
    """identity, label, kind, host, n and latest of each source, the latest first; with now only those of the last 7 days.

    Label and host are those of the latest row, by time and id.
    """
    groups = rows.groupBy("identity").agg(F.count("*").alias("n"), F.max("created_at").alias("latest"), F.max_by(F.struct("label", "kind", "host"), F.struct("created_at", "id")).alias("x"))
    groups = groups.select("identity", "x.label", "x.kind", "x.host", "n", "latest")
    groups = groups if now is None else groups.where(recent(F.col("latest"), now))
    return groups.orderBy(F.col("latest").asc() if sort == "earliest" else F.col("latest").desc(), "identity")


def origin_metadata(docs: DataFrame) -> DataFrame:
    """docs (source_url, canonical_url, raw_html, author) with biz, nickname and origin_key; null off the messenger's host."""
    url = F.coalesce("canonical_url", "source_url")
    here = hostname(url) == WECHAT_HOST
    found = lambda p: F.nullif(F.trim(F.regexp_extract("raw_html", p, 1)), F.lit(""))
    biz = F.coalesce(F.nullif(query_value(url, "__biz"), F.lit("")), found(r"""var\s+biz\s*=\s*["']([A-Za-z0-9=]+)["']"""))
    name = F.coalesce(found(r"""(?s)id=["']js_name["'][^>]*>\s*([^<]+?)\s*<"""), found(r"""nickname\s*=\s*(?:htmlDecode\()?["']([^"']+)["']"""), F.nullif(F.trim("author"), F.lit("")))
    key = F.coalesce(F.concat(F.lit("wechat:biz:"), biz), F.concat(F.lit("wechat:nickname:"), name), F.lit("wechat:unknown"))
    return docs.withColumns({"biz": F.when(here, biz), "nickname": F.when(here, name), "origin_key": F.when(here, key)})


def origin_scan(docs: DataFrame, query: ListQuery) -> DataFrame:
    """id, ord, biz, nickname and label of the documents that a listing has, whatever origin it asks for: what its origins are told from.

    Only key columns are read, and a page's HTML where its document has no key.
    """
    rows = select_documents(docs, query)
    told = origin_metadata(rows.withColumn("raw_html", F.when(F.col("content_origin_key").isNull(), F.col("raw_html"))))
    biz = F.coalesce(F.nullif(F.regexp_extract("content_origin_key", "^wechat:biz:(.+)$", 1), F.lit("")), "biz")
    name = F.coalesce(F.nullif(F.regexp_extract("content_origin_key", "^wechat:nickname:(.+)$", 1), F.lit("")), "nickname")
    return told.select("id", F.col("id").alias("ord"), biz.alias("biz"), name.alias("nickname"), F.coalesce("content_origin_label", "nickname").alias("label"))


def preferred_biz(rows: DataFrame) -> DataFrame:
    """nickname and biz (null if none is clearly dominant) by a vote of the rows that have both.

    Counts come before the window, so a task ranks the few publications of a name and not its rows.
    """
    counts = rows.where(F.col("biz").isNotNull() & F.col("nickname").isNotNull() & (F.col("nickname") != UNKNOWN)).groupBy("nickname", "biz").agg(F.count("*").alias("n"))
    by_name = Window.partitionBy("nickname")
    ranked = by_name.orderBy(F.desc("n"), "biz")
    led = counts.select("nickname", "biz", "n", F.sum("n").over(by_name).alias("total"), F.lead("n").over(ranked).alias("second"), F.row_number().over(ranked).alias("rank")).where("rank = 1")
    wins = F.col("second").isNull() | ((F.col("n") >= LEAST_COUNT) & (F.col("n") / F.col("total") >= LEAST_SHARE) & (F.col("n") >= LEAST_RATIO * F.col("second")))
    return led.select("nickname", F.when(wins, F.col("biz")).alias("biz"))


def assign_origins(rows: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """id, origin and label of rows (id, ord, biz, nickname, label): rows without a publication take their name's preferred one.

    A publication's label is the registry's (biz, display_name), else the first that a row gives it.
    """
    chosen = preferred_biz(rows).where("biz is not null").withColumnRenamed("biz", "voted")
    labels = rows.where(F.col("biz").isNotNull() & F.col("label").isNotNull() & (F.col("label") != UNKNOWN)).groupBy("biz").agg(F.min_by("label", F.struct("ord", "id")).alias("stored"))
    out = rows.join(chosen, "nickname", "left").withColumn("match", F.coalesce("biz", "voted"))
    out = out.join(labels.withColumnRenamed("biz", "match"), "match", "left")
    known = registry.select(F.col("biz").alias("match"), "display_name") if registry is not None else None
    out = out.join(known, "match", "left") if known is not None else out.withColumn("display_name", F.lit(None).cast("string"))
    origin = F.when(F.col("match").isNotNull(), F.concat(F.lit("wechat:biz:"), F.col("match"))).otherwise(F.coalesce(F.concat(F.lit("wechat:nickname:"), F.col("nickname")), F.lit("wechat:unknown")))
    label = F.when(F.col("match").isNotNull(), F.coalesce("display_name", "stored", "label", "nickname", F.lit(UNKNOWN))).otherwise(F.coalesce("label", "nickname", F.lit(UNKNOWN)))
    return out.select("id", "ord", origin.alias("origin"), label.alias("label"))


def origin_label(current_key: Column, current: Column, key: Column, registered: Column, trusted: Column) -> Column:
    """A document's label: what its page says, else the current one if it is of this publication and known, else the registry's."""
    own = F.nullif(F.trim(current), F.lit(""))
    return F.coalesce(trusted, F.when(current_key.eqNullSafe(key) & (own != UNKNOWN), own), registered)


def distinct_publications(rows: DataFrame) -> DataFrame:
    """biz of rows (origin_key), each once: what a lookup of registered names asks for."""
    biz = F.nullif(F.regexp_extract("origin_key", "^wechat:biz:(.+)$", 1), F.lit(""))
    return rows.select(biz.alias("biz")).where("biz is not null").distinct()


def alias_lookups(rows: DataFrame) -> DataFrame:
    """kind and value, each pair once, of rows (kind, feed_id, host) that may have an alias: feeds and hosts."""
    value = F.when(F.col("kind") == "feed", F.col("feed_id")).when(F.col("kind") == "domain", F.col("host"))
    return rows.select("kind", value.alias("value")).where("value is not null").distinct()


def origin_options(assigned: DataFrame) -> DataFrame:
    """origin, label and n, the largest first, unknown before others of its size, then by label."""
    options = assigned.groupBy("origin").agg(F.count("*").alias("n"), F.min_by("label", F.struct("ord", "id")).alias("label"))
    return options.orderBy(F.desc("n"), F.when(F.col("origin") == "wechat:unknown", 0).otherwise(1), F.collate("label", "zh"), "origin")


def register_names(changes: DataFrame) -> DataFrame:
    """biz and display_name from changes (biz, display_name, seq): the latest name, and a placeholder only if there is no name."""
    placeholder = F.col("display_name").endswith("…")
    return changes.groupBy("biz").agg(F.max_by("display_name", F.struct(~placeholder, "seq")).alias("display_name"))


def placeholder_name(biz: Column, prefix: str = "Account ") -> Column:
    return F.concat(F.lit(prefix), F.left(biz, F.lit(6)), F.lit("…"))


def _doubled(held: Stored, name: str, edges: DataFrame) -> DataFrame:
    """url, to, n, low and on of edges (url, to; one of each url): where the way of each URL ends after n edges. low is the smallest URL of
    the way. on is true where it never ends; then to lies on a cycle, and all its URLs are seen by low.

    Round k doubles the ways: 2**k edges of each URL are known. A way that has not ended after as many edges as there are open ways,
    and one more round, never does.
    """
    way = held.keep(name, edges.select("url", "to", F.lit(1).cast("long").alias("n"), F.least("url", "to").alias("low")))
    goes_on = edges.select(F.col("url").alias("to"), F.lit(True).alias("on"))
    reach, more = 1, True
    while more:
        still = way.join(goes_on, "to", "left_semi").count()
        if not still:
            break
        more = reach < still
        on = way.select(F.col("url").alias("to"), F.col("to").alias("next"), F.col("n").alias("further"), F.col("low").alias("lower"))
        met = way.join(on, "to", "left")
        way = held.keep(
            name, met.select("url", F.coalesce("next", "to").alias("to"), (F.col("n") + F.coalesce("further", F.lit(0))).alias("n"), F.least("low", F.coalesce("lower", "low")).alias("low"))
        )
        reach *= 2
    return stored(way.join(goes_on, "to", "left").select("url", "to", "n", "low", F.coalesce("on", F.lit(False)).alias("on")), "ended-ways")


def follow_redirects(links: DataFrame) -> DataFrame:
    """url, final_url and hops of links (url, target_url): targets are followed to the end, or until the next one was visited before.

    Ways are doubled, so the longest chain, of h hops, takes log2(h) rounds. Ways that never end come to a cycle. On a cycle a URL's way
    ends at the URL before it; the way of one that leads into a cycle ends at the URL before its entry, which is found by doubling
    as well. Of several targets of a URL the smallest counts.
    """
    held = Stored(links.sparkSession)
    hops = stored(links.where("url is not null and target_url is not null").groupBy("url").agg(F.min("target_url").alias("to")), "hops")
    ways = _doubled(held, "ways", hops)
    ended = ways.where("not on").select("url", F.col("to").alias("final_url"), F.col("n").cast("int").alias("hops"))
    turning = ways.where("on")
    if turning.isEmpty():
        return ended
    # so many hops lead each URL onto its cycle and turn the cycle, so their ends are all URLs of cycles
    ring = stored(ways.join(turning.select(F.col("to").alias("url")).distinct(), "url").select("url", "low"), "ring")
    length = ring.groupBy("low").agg(F.count("*").alias("length"))
    before = hops.join(ring.select("url"), "url").select(F.col("to").alias("url"), F.col("url").alias("before"))
    ring = stored(ring.join(length, "low").join(before, "url").select("url", "before", "length"), "ring")
    on_ring = ring.select("url", F.col("before").alias("final_url"), (F.col("length") - 1).cast("int").alias("hops"))
    leads = hops.join(turning.select("url"), "url", "left_semi").join(ring.select("url"), "url", "left_anti")
    entries = _doubled(held, "leads", leads).join(ring.withColumnRenamed("url", "to"), "to")
    into = entries.select("url", F.col("before").alias("final_url"), (F.col("n") + F.col("length") - 1).cast("int").alias("hops"))
    return ended.unionByName(on_ring).unionByName(into)
