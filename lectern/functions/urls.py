"""URL columns: canonical form, keys, hosts, videos. Each takes and gives Columns; an unusable URL gives null or stays as it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.columns import let

#: Tracking and test parameters that a canonical URL lacks.
TRACKING_PREFIXES = ("utm_", "qa_", "codex_")
TRACKING_KEYS = ("fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "_hsenc", "_hsmi", "ref", "source")
TEST_PREFIXES = ("qa_", "codex_")
#: Hosts of two video sites that count as one each.
VIDEO_HOSTS = {"www.youtube.com": ("youtube.com", "www.youtube.com", "m.youtube.com", "youtu.be"), "www.bilibili.com": ("bilibili.com", "www.bilibili.com", "m.bilibili.com", "b23.tv")}
WECHAT_HOST = "mp.weixin.qq.com"
#: Fixed value: the largest whole number that a double holds exactly; longer start marks count as none.
MOST_SECONDS = 9_007_199_254_740_991

_PARTS = r"^(?i)(https?://[^/?#\s]+)([^?#\s]*)(\?[^#\s]*)?(#\S*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def _pairs(url: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(_part(url, 3), r"^\?", ""), "&"), lambda p: p != "")


def _form_decoded(text: Column) -> Column:
    """A parameter's name or value as text: a plus is a space, and a percent sign that begins no byte stays."""
    told = lambda x: F.url_decode(F.regexp_replace(F.translate(x, "+", " "), "%(?![0-9A-Fa-f]{2})", "%25"))
    return let(text, lambda x: F.when(F.contains(x, F.lit("%")) | F.contains(x, F.lit("+")), told(x)).otherwise(x))


def _key(pair: Column) -> Column:
    return _form_decoded(F.split(pair, "=", 2)[0])


def _value(pair: Column) -> Column:
    """What follows the first equals sign, empty where there is none; null for null."""
    return _form_decoded(F.coalesce(F.get(F.split(pair, "=", 2), 1), F.left(pair, F.lit(0))))


def normalize_url(url: Column) -> Column:
    """The URL without tracking parameters and one trailing slash, its scheme and host in lower case; the fragment stays.

    Names and values of parameters are decoded and encoded anew as a form's are, so spellings of one parameter are one; each has an equals sign.
    """

    def told(pair: Column) -> Column:
        return F.struct(_key(pair).alias("key"), _value(pair).alias("value"))

    def whole(x: Column) -> Column:
        tracked = lambda p: F.exists(F.array(*map(F.lit, TRACKING_PREFIXES)), lambda y: p["key"].startswith(y)) | p["key"].isin(*TRACKING_KEYS)
        pairs = F.transform(F.filter(F.split(F.regexp_replace(x["query"], r"^\?", ""), "&"), lambda p: p != ""), told)
        kept = F.transform(F.filter(pairs, lambda p: ~tracked(p)), lambda p: F.concat(F.url_encode(p["key"]), F.lit("="), F.url_encode(p["value"])))
        query = F.array_join(kept, "&")
        path = F.when(x["path"] == "", "/").otherwise(x["path"])
        return F.regexp_replace(F.concat(F.lower(x["origin"]), path, let(query, lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))), x["fragment"]), "/$", "")

    def parted(u: Column) -> Column:
        parts = F.struct(*[_part(u, i).alias(name) for i, name in enumerate(("origin", "path", "query", "fragment"), 1)])
        return F.when(u.rlike(_PARTS), let(parts, whole)).otherwise(u)

    return let(url, parted)


def query_value(url: Column, key: str) -> Column:
    """The first value of a query parameter, decoded; null if absent."""
    return let(F.get(F.filter(_pairs(url), lambda p: _key(p) == key), 0), _value)


def hostname(url: Column) -> Column:
    """The host in lower case, without user and port; null for anything but http and https."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^(?i)https?://(?:[^/?#@\s]*@)?([^/?#:\s]+)", 1)), F.lit(""))


def source_host(*urls: Column) -> Column:
    """The host of the first usable URL; hosts of one video site are folded into one."""
    host = F.coalesce(*map(hostname, urls))
    out = host
    for name, hosts in VIDEO_HOSTS.items():
        out = F.when(host.isin(*hosts), name).otherwise(out)
    return out


def is_test_url(url: Column) -> Column:
    return F.coalesce(F.exists(_pairs(url), lambda p: _key(p).startswith(TEST_PREFIXES[0]) | _key(p).startswith(TEST_PREFIXES[1])), F.lit(False))


def wechat_canonical(url: Column) -> Column:
    """The short form of an article on the messenger's host, or its four identity parameters; else normalize_url()."""
    names = ("biz", "mid", "idx", "sn")

    def known(x: Column) -> Column:
        long = F.concat(F.lit(f"https://{WECHAT_HOST}/s?__biz="), x["biz"], F.lit("&mid="), x["mid"], F.lit("&idx="), x["idx"], F.lit("&sn="), x["sn"])
        usable = F.forall(F.array(*[x[n] for n in names]), lambda v: F.coalesce(v, F.lit("")) != "")
        short = F.concat(F.lit(f"https://{WECHAT_HOST}"), F.regexp_replace(x["path"], "/$", ""))
        return F.when(x["path"].startswith("/s/"), short).when(usable, long)

    def own(u: Column) -> Column:
        told = F.struct(_part(u, 2).alias("path"), *[query_value(u, k).alias(n) for n, k in zip(names, ("__biz", "mid", "idx", "sn"), strict=True)])
        return F.coalesce(F.when(hostname(u) == WECHAT_HOST, let(told, known)), normalize_url(u))

    return let(url, own)


def dedupe_key(kind: Column, source_url: Column, canonical_url: Column, external_id: Column) -> Column:
    """The key that makes a document unique; null for kinds without one."""
    ext = F.nullif(external_id, F.lit(""))

    def article(canonical: Column) -> Column:
        short = F.nullif(F.regexp_extract(canonical, r"/s/([a-zA-Z0-9_-]+)", 1), F.lit(""))
        return F.coalesce(F.concat(F.lit("wechat:s:"), short), F.concat(F.lit("wechat:url:"), canonical))

    def key(u: Column) -> Column:
        feed = F.coalesce(F.concat(F.lit("rss:"), ext), F.concat(F.lit("rss:url:"), normalize_url(u)))
        page = F.coalesce(F.concat(F.lit("web:ext:"), ext), F.concat(F.lit("web:url:"), normalize_url(u)))
        own = F.when(u.isNull(), None).when(hostname(u) == WECHAT_HOST, let(wechat_canonical(u), article)).otherwise(page)
        return F.when(kind == "RSS_ITEM", feed).when(kind == "WEB_PAGE", own)

    return let(F.coalesce(F.nullif(canonical_url, F.lit("")), F.nullif(source_url, F.lit(""))), key)


def capture_url(url: Column) -> Column:
    """A URL as it is captured: trimmed, http or https only, without its fragment; else null."""
    return let(F.regexp_replace(F.trim(url), "#.*$", ""), lambda u: F.when(hostname(u).isNotNull(), u))


def site_url(url: Column) -> Column:
    return F.regexp_replace(url, "/$", "")


#: The path of the messenger's wrapper page, and how its pages name a target.
WRAPPER_PATH, TARGET_IN_PAGE = "/mp/wappoc_appmsgcaptcha", r"""(?i)\btarget_url\s*[:=]\s*["']([^"'<>]+)["']"""
#: Wrappers inside wrappers that are followed.
WRAPPERS = 4


def _decoded(value: Column) -> Column:
    """A text with its escapes decoded up to twice; what cannot be decoded stays."""
    once = lambda c: F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    return let(F.trim(value), lambda v: let(once(v), once))


def wechat_link(value: Column, base: Column, wrappers: int = WRAPPERS) -> Column:
    """The article of the messenger that a link leads to: decoded, resolved, and taken out of wrapper pages; null for other pages and hosts."""

    def target(url: Column) -> Column:
        inner = F.regexp_extract(url, r"[?&]target_url=([^&#]*)", 1)
        wrapped = wechat_link(F.nullif(inner, F.lit("")), base, wrappers - 1) if wrappers else F.lit(None).cast("string")
        article = _part(url, 2).startswith("/s") | (F.coalesce(query_value(url, "__biz"), F.lit("")) != "")
        return F.when(hostname(url) == WECHAT_HOST, F.when(_part(url, 2) == WRAPPER_PATH, wrapped).when(article, url))

    return let(resolve_url(F.nullif(_decoded(value), F.lit("")), base), target)


def wechat_target(final_url: Column, request_url: Column, html: Column) -> Column:
    """The article that a wrapper page of the messenger leads to: by target_url of its URL, of the requested one or in its script, else by its first usable link."""
    base = F.coalesce(final_url, request_url, F.lit(f"https://{WECHAT_HOST}/"))
    asked = lambda url: F.nullif(F.regexp_extract(url, r"[?&]target_url=([^&#]*)", 1), F.lit(""))
    told = F.array(asked(final_url), asked(request_url), F.nullif(F.regexp_extract(html, TARGET_IN_PAGE, 1), F.lit("")))
    hrefs = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    links = F.concat(told, F.coalesce(hrefs, F.array().cast("array<string>")))
    return F.get(F.filter(F.transform(links, lambda x: wechat_link(x, base)), lambda x: x.isNotNull()), 0)


def fold_dots(path: Column) -> Column:
    """A path without . and .. segments: a step up takes the segment before it, steps above the root take none."""
    none = F.array(F.lit(""))
    step = lambda kept, x: F.when(x == ".", kept).when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.lit(1), F.size(kept) - 1))).otherwise(F.array_append(kept, x))
    # what stands before the first slash is empty; a path that ends with a step ends with a slash
    parts = F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), r"(^|/)(\.\.?)$", "$1$2/"), "/")
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.array_join(F.aggregate(parts, none, step), "/")).otherwise(path)


def resolve_url(value: Column, base: Column) -> Column:
    """A reference resolved against its page: absolute, //host, /path, ?query or relative; other schemes and fragments give null.

    Paths lose their . and .. segments, however many there are; the host is never one of them.
    """
    told = F.struct(
        F.trim(value).alias("v"), F.regexp_extract(base, r"^(?i)(https?://[^/?#\s]+)", 1).alias("origin"), F.regexp_extract(base, r"^(?i)https?://[^/?#\s]+([^?#\s]*)", 1).alias("path"),
    )

    def whole(x: Column) -> Column:
        """The reference with an origin before it."""
        v, origin = x["v"], x["origin"]
        path = F.when(x["path"] == "", "/").otherwise(x["path"])
        return (
            F.when(v.rlike("^(?i)https?://"), v)
            .when(v.rlike("^//"), F.concat(F.regexp_extract(origin, "^(?i)(https?:)", 1), v))
            .when(v.rlike("^/"), F.concat(origin, v))
            .when(v.rlike(r"^\?"), F.concat(origin, x["path"], v))
            .when(v.rlike("^#|^$|^[a-zA-Z][a-zA-Z0-9+.-]*:"), None)
            .otherwise(F.concat(origin, F.regexp_replace(path, "[^/]*$", ""), v))
        )

    def folded(url: Column) -> Column:
        parts = [F.regexp_extract(url, r"(?s)^((?i)https?://[^/?#\s]+)?([^?#]*)(.*)$", i) for i in (1, 2, 3)]
        return F.when(url.rlike(r"/\.\.?(?:[/?#]|$)"), F.concat(parts[0], fold_dots(parts[1]), parts[2])).otherwise(url)

    return let(told, lambda x: let(whole(x), folded))


def duration_seconds(value: Column) -> Column:
    """Seconds of a start mark: digits, or hours, minutes and seconds as in 1h2m3s; null if neither, and for no time at all."""
    v = F.lower(F.trim(value))
    unit = lambda u: F.coalesce(F.nullif(F.regexp_extract(v, rf"(\d+){u}", 1), F.lit("")).try_cast("long"), F.lit(0))
    plain = F.when(v.rlike(r"^\d+$"), v.try_cast("long"))
    marked = F.when(v.rlike(r"^(?:\d+h)?(?:\d+m)?(?:\d+s)?$"), unit("h") * 3600 + unit("m") * 60 + unit("s"))
    seconds = F.coalesce(plain, marked)
    return F.when((seconds > 0) & (seconds <= MOST_SECONDS), seconds)


def video_identity(url: Column) -> Column:
    """provider, video_id, start_seconds, external_id and embed_url of a video's URL; null for others."""
    host = source_host(url)
    yt = F.coalesce(
        F.nullif(F.regexp_extract(url, r"^(?i)https?://(?:www\.)?youtu\.be/([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])", 1), F.lit("")),
        F.nullif(F.regexp_extract(query_value(url, "v"), "^([A-Za-z0-9_-]{11})$", 1), F.lit("")),
        F.nullif(F.regexp_extract(url, r"/(?:embed|shorts|live)/([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])", 1), F.lit("")),
    )
    bv = F.nullif(F.regexp_extract(url, r"/(?:video/)?(BV[A-Za-z0-9]{10})(?![A-Za-z0-9])", 1), F.lit(""))
    start = F.coalesce(*map(duration_seconds, (query_value(url, "start"), query_value(url, "t"), F.regexp_extract(url, r"#t=(.*)$", 1))))
    tube, bili = (host == "www.youtube.com") & yt.isNotNull(), (host == "www.bilibili.com") & bv.isNotNull()
    provider = F.when(tube, "youtube").when(bili, "bilibili")
    ident = F.when(tube, yt).otherwise(bv)
    tube_embed = F.concat(F.lit("https://www.youtube.com/embed/"), yt, F.lit("?enablejsapi=1&playsinline=1&rel=0"), F.coalesce(F.concat(F.lit("&start="), start.cast("string")), F.lit("")))
    embed = F.when(tube, tube_embed).otherwise(F.concat(F.lit("https://player.bilibili.com/player.html?bvid="), bv, F.lit("&page=1&high_quality=1")))
    return F.when(provider.isNotNull(), F.struct(provider.alias("provider"), ident.alias("video_id"), start.alias("start_seconds"), F.concat_ws(":", provider, ident).alias("external_id"), embed.alias("embed_url")))
