"""Date columns: parsing what pages and feeds write, and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Epoch seconds of 2000-01-01 and 2100-01-01, between which digits count as a time.
FROM, TO = 946_684_800, 4_102_444_800


def epoch(c: Column) -> Column:
    """A time from 10 digits as seconds, or 13 as milliseconds, of the years 2000 to 2099; else null."""
    t = F.trim(c)
    seconds, millis = (F.when(t.rlike(rf"^\d{{{n}}}$"), t.try_cast("long")) for n in (10, 13))
    return F.when(seconds.between(FROM, TO), F.timestamp_seconds(seconds)).when(millis.between(FROM * 1000, TO * 1000), F.timestamp_millis(millis))


def page_date(c: Column) -> Column:
    """A page's date: epoch; year, month and day apart by ideographs, slashes, hyphens or dots, with or without a time, at +08:00; else ISO or
    RFC 822; null if none parses."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    form = r"^(\d{4})[年/\-.](\d{1,2})[月/\-.](\d{1,2})日?(?: (\d{1,2})(?::(\d{1,2}))?(?::(\d{1,2}))?)?$"
    two = lambda k: F.lpad(F.regexp_extract(t, form, k), 2, "0")
    day, time = F.concat_ws("-", F.regexp_extract(t, form, 1), two(2), two(3)), F.concat_ws(":", two(4), two(5), two(6))
    local = F.when(t.rlike(form), F.try_to_timestamp(F.concat(day, F.lit(" "), time, F.lit("+08:00")), F.lit("yyyy-MM-dd HH:mm:ssXXX")))
    general = F.when(~t.rlike(r"^\d{5,}$"), F.try_to_timestamp(t))
    return F.coalesce(epoch(t), local, general, feed_date(t))


def feed_date(c: Column) -> Column:
    """A feed's date, RFC 822 or ISO; null if invalid."""
    t = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3,9},?\s+", "")
    zone = F.regexp_replace(F.regexp_replace(t, r"\s(?:GMT|UTC|UT|Z)$", " +0000"), r"\s([+-]\d{2}):(\d{2})$", " $1$2")
    forms = [F.try_to_timestamp(zone, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm xx")]
    return F.coalesce(*forms, F.try_to_timestamp(F.trim(c)))


def day(c: Column) -> Column:
    """Midnight of a date without a time."""
    return F.when(c.rlike(r"^\s*\d{4}-\d{2}-\d{2}\s*$"), F.try_to_timestamp(F.trim(c), F.lit("yyyy-MM-dd")))


def published_label(at: Column, kind: Column, imported: Column) -> Column:
    """How a date is shown: exact, as an upper bound, by its import, or unknown."""
    shown = lambda c: F.date_format(c, "yyyy-MM-dd")
    return F.when(at.isNotNull() & (kind == "BEFORE"), F.concat(F.lit("before "), shown(at))).when(at.isNotNull(), shown(at)).when(imported.isNotNull(), F.concat(F.lit("imported "), shown(imported))).otherwise("unknown")


def vtt_seconds(c: Column) -> Column:
    """Seconds of a cue's time, mm:ss or hh:mm:ss with a fraction; null if malformed."""
    p = F.transform(F.split(F.replace(F.trim(c), F.lit(","), F.lit(".")), ":"), lambda x: x.try_cast("double"))
    return F.when(F.size(p) == 3, F.get(p, 0) * 3600 + F.get(p, 1) * 60 + F.get(p, 2)).when(F.size(p) == 2, F.get(p, 0) * 60 + F.get(p, 1))
