"""Video transcripts: formats, timeline, active segment, caption choice, player metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.columns import let
from lectern.functions.dates import vtt_seconds
from lectern.functions.text import collapse, html_to_text
from lectern.functions.urls import video_identity
from lectern.operators.filters import transcript_due

_JSON3 = "events array<struct<tStartMs: double, dDurationMs: double, segs: array<struct<utf8: string>>>>"
_BODY = "body array<struct<`from`: double, `to`: double, content: string>>"


def segments(payloads: DataFrame) -> DataFrame:
    """video_id, start, end, text of payloads (video_id, format, payload): json3, vtt, xml or body. Without a duration a segment has 2 s."""
    seg = lambda a, b, t: F.struct(a.cast("double").alias("start"), b.cast("double").alias("end"), t.alias("text"))
    json3 = F.transform(F.from_json("payload", _JSON3)["events"], lambda e: seg(e["tStartMs"] / 1000, (e["tStartMs"] + F.coalesce(e["dDurationMs"], F.lit(2000.0))) / 1000, F.array_join(F.transform(e["segs"], lambda s: s["utf8"]), "")))
    body = F.transform(F.from_json("payload", _BODY)["body"], lambda e: seg(e["from"], e["to"], e["content"]))
    tags = F.regexp_extract_all("payload", F.lit(r"(?s)<text\b[^>]*>.*?</text>"), F.lit(0))
    number = lambda t, name: F.nullif(F.regexp_extract(t, rf'\b{name}="([\d.]+)"', 1), F.lit("")).try_cast("double")
    xml = F.transform(tags, lambda t: seg(number(t, "start"), number(t, "start") + F.coalesce(number(t, "dur"), F.lit(2.0)), html_to_text(html_to_text(t))))
    cues = F.filter(F.split(F.regexp_replace("payload", "\r\n?", "\n"), "\n\n+"), lambda c: c.contains("-->"))
    clock = r"([\d:.,]+)\s*-->\s*([\d:.,]+)[^\n]*\n?"
    vtt = F.transform(cues, lambda c: seg(vtt_seconds(F.regexp_extract(c, clock, 1)), vtt_seconds(F.regexp_extract(c, clock, 2)), F.regexp_replace(F.regexp_replace(c, rf"(?s)^.*?{clock}", ""), "<[^>]+>", "")))
    chosen = F.when(F.col("format") == "json3", json3).when(F.col("format") == "body", body).when(F.col("format") == "xml", xml).when(F.col("format") == "vtt", vtt)
    return payloads.select("video_id", F.explode(chosen).alias("s")).select("video_id", "s.start", "s.end", "s.text")


def timeline(rows: DataFrame) -> DataFrame:
    """Usable segments with clean text; an end that passes the next start is cut there. A video's segments are one window."""
    clean = rows.withColumn("text", collapse(F.col("text"))).where("start is not null and end > start and text is not null and not isnan(start) and not isnan(end) and end < double('infinity')")
    later = F.lead("start").over(Window.partitionBy("video_id").orderBy("start", "end", "text"))
    cut = F.when((later > F.col("start")) & (F.col("end") > later), later).otherwise(F.col("end"))
    return clean.withColumn("end", cut).where("end > start")


def transcript_text(rows: DataFrame) -> DataFrame:
    """video_id and text, a line for each segment in order."""
    return rows.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "text"))), lambda s: s["text"]), "\n").alias("text"))


def active_segments(times: DataFrame, rows: DataFrame) -> DataFrame:
    """times (video_id, at) with start, end, text of the segment that holds each time, or the last one that ended before it.

    The latest segment that starts by then is found by one sort of both sides; no pairs of times and segments are made.
    """
    none = F.lit(None)
    marks = rows.select("video_id", F.col("start").alias("t"), F.lit(0).alias("k"), F.struct("start", "end", "text").alias("s"))
    asked = times.select("video_id", F.col("at").alias("t"), F.lit(1).alias("k"), none.cast(marks.schema["s"].dataType).alias("s"))
    w = Window.partitionBy("video_id").orderBy("t", "k", "s").rowsBetween(Window.unboundedPreceding, 0)
    end = F.max("s.end").over(Window.partitionBy("video_id"))
    found = marks.union(asked).select("video_id", "t", "k", F.last("s", True).over(w).alias("s"), end.alias("last"))
    held = (F.col("t") < F.col("s.end")) | (F.col("t") >= F.col("last"))
    out = F.when(held, F.col("s"))
    return found.where("k = 1").select("video_id", F.col("t").alias("at"), out["start"].alias("start"), out["end"].alias("end"), out["text"].alias("text"))


def best_track(tracks: DataFrame) -> DataFrame:
    """The caption track of each video: Chinese, then English, then others, then those without a language; machine-made ones after
    all of these; then the first."""
    lang = F.col("lang")
    score = F.when(F.coalesce(lang, F.lit("")) == "", 4).when(lang.rlike("^(?i)zh"), 0).when(lang.rlike("^(?i)en"), 1).otherwise(2) + F.when(F.col("kind") == "asr", 10).otherwise(0)
    return tracks.groupBy("video_id").agg(F.min_by(F.struct("idx", "lang", "kind", "base_url"), F.struct(score, "idx")).alias("t")).select("video_id", "t.*")


def best_subtitle(tracks: DataFrame) -> DataFrame:
    """The subtitle of each video of the second platform (video_id, idx, lang, locked, base_url): Chinese, then others, then those without a
    language; then the first. Locked ones are none."""
    lang = F.coalesce(F.col("lang"), F.lit(""))
    score = F.when(lang == "", 2).when(lang.rlike("^(?i)zh"), 0).otherwise(1)
    free = tracks.where(~F.coalesce("locked", F.lit(False)))
    return free.groupBy("video_id").agg(F.min_by(F.struct("idx", "lang", "base_url"), F.struct(score, "idx")).alias("t")).select("video_id", "t.*")


def _told(*values: Column) -> Column:
    """The first text that is not blank, without white space at its ends."""
    return F.coalesce(*[F.nullif(F.regexp_replace(v, r"^\s+|\s+$", ""), F.lit("")) for v in values])


def player_metadata(player: Column, watch: Column | None = None) -> Column:
    """title, author, published (as it is written), thumbnail (the last that has a URL) and seconds of a player's JSON (VARIANT), or of that of
    its page where the player has not the part; null without a title."""
    text = lambda v, path: F.try_variant_get(v, path, "string")
    part = lambda path: F.coalesce(*[F.try_variant_get(v, path, "variant") for v in (player, watch) if v is not None])
    both = F.struct(part("$.videoDetails").alias("d"), part("$.microformat.playerMicroformatRenderer").alias("m"))

    def thumbnail(v: Column) -> Column:
        urls = F.transform(F.try_variant_get(v, "$.thumbnail.thumbnails", "array<variant>"), lambda t: _told(text(t, "$.url")))
        return F.try_element_at(F.filter(urls, lambda u: u.isNotNull()), F.lit(-1))

    def cascade(x: Column) -> Column:
        d, m = x["d"], x["m"]
        title = _told(text(d, "$.title"), text(m, "$.title"))
        made = F.struct(
            title.alias("title"), _told(text(d, "$.author")).alias("author"), _told(text(m, "$.publishDate"), text(m, "$.uploadDate")).alias("published"),
            F.coalesce(thumbnail(d), thumbnail(m)).alias("thumbnail"), _told(text(d, "$.lengthSeconds")).try_cast("int").alias("seconds"),
        )
        return F.when(title.isNotNull(), made)

    return let(both, cascade)


def video_cid(video: Column, page: Column) -> Column:
    """The id of a video's part: that of the page with this number (a text), else the video's own, else that of the first page that has one."""
    cid = lambda v: F.try_variant_get(v, "$.cid", "bigint")
    number = F.regexp_extract(page, r"^\s*\+?(\d+)", 1).try_cast("int")
    pages = F.try_variant_get(video, "$.pages", "array<variant>")
    asked = F.when(number > 0, cid(F.get(pages, number - 1)))
    return F.coalesce(asked, cid(video), F.get(F.filter(F.transform(pages, cid), lambda c: c.isNotNull()), 0))


def video_documents(docs: DataFrame) -> DataFrame:
    """docs with video: the identity of the first usable of video, canonical and source URL; machine transcripts are hidden."""
    out = docs.withColumn("video", F.coalesce(*[video_identity(F.col(c)) for c in ("video_url", "canonical_url", "source_url")]))
    return out.withColumn("transcript_segments", F.when(F.col("transcript_source") != "AI", F.col("transcript_segments")))


def refresh_videos(docs: DataFrame, captured: DataFrame) -> DataFrame:
    """docs whose transcript is due (filters.transcript_due()) take that of a later capture (id, segments, text), and lose their origin."""
    new = captured.where(F.size("segments") > 0).select("id", F.col("segments").alias("new_segments"), F.col("text").alias("new_text"))
    due = transcript_due() & F.col("new_segments").isNotNull()
    out = docs.join(new, "id", "left").withColumn("due", due)
    return out.withColumns({"transcript_segments": F.when(F.col("due"), F.col("new_segments")).otherwise(F.col("transcript_segments")), "plain_text": F.when(F.col("due"), F.col("new_text")).otherwise(F.col("plain_text")), "content_origin_key": F.when(~F.col("due"), F.col("content_origin_key")), "transcript_status": F.when(F.col("due"), "READY").otherwise(F.col("transcript_status"))}).drop("due", "new_segments", "new_text")
