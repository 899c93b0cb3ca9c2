"""URL functions as Column expressions; null gives null unless stated otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Host pattern to the set of parsing rules; the first match holds.
ROUTES = ((r"wattpad\.com$", "wattpad"), (r"novlar|khalidblog", "portal"), (r"uranus-novel|novel", "modern"))
#: Shortened links of known hosts are rebuilt from the id in them.
REPAIRS = (
    ("novlar", "https://www.novlar.com/views/novel/details.php?id="),
    ("uranus", "https://uranus-novel.com/ar/novels/"),
    ("wattpad", "https://www.wattpad.com/story/"),
)
_HOST = r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)"


def host(url: Column) -> Column:
    """Host in lower case without user, port and a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"^www\.", "")


def origin(url: Column) -> Column:
    """Scheme, host and port."""
    return F.regexp_extract(url, r"(?i)^(https?://[^/?#]+)", 1)


def adapter(url: Column) -> Column:
    """Name of the parsing rules for a URL; generic where no route matches."""
    h = host(url)
    out = F.when(url.isNull(), None)
    for pattern, name in ROUTES:
        out = out.when(h.rlike(pattern), name)
    return out.otherwise("generic")


def normalize_url(raw: Column) -> Column:
    """Struct ``url``, ``error`` of a pasted address: tags, quotes and white space
    removed, https added; error is empty, truncated or invalid. Null is empty."""
    v = F.regexp_replace(F.coalesce(raw, F.lit("")), "<[^>]*>", " ")
    v = F.regexp_replace(v, "(?i)&amp;", "&")
    v = F.regexp_replace(v, r"[​-‏‪-‮]", "")
    v = F.regexp_replace(v, "[«»\"'`؛;،,]+", "")
    v = F.regexp_replace(v, r"[\s\p{Z}]+", "")
    short = v.rlike(r"\.\.\.|…")
    ident = F.regexp_extract(v, r"(?:id=|/)(\d{1,9})", 1)
    fixed = F.when(~short, v)
    for word, base in REPAIRS:
        fixed = fixed.when((ident != "") & v.rlike(f"(?i){word}"), F.concat(F.lit(base), ident))
    schemed = F.when(fixed.rlike("(?i)^https?://"), fixed).when(fixed.rlike(r"(?i)^[a-z0-9.\-]+\.[a-z]{2,}(/|$)"), F.concat(F.lit("https://"), fixed))
    good = schemed.rlike(r"(?i)^https?://(?:[^/?#@]*@)?[^/?#:]*\.[^/?#:]*")
    error = F.when(v == "", "empty").when(fixed.isNull(), "truncated").when(F.coalesce(good, F.lit(False)), None).otherwise("invalid")
    return F.struct(F.when(error.isNull(), schemed).alias("url"), error.alias("error"))


def private_address(url: Column) -> Column:
    """Whether a URL must not be fetched: no http, or a host of the own network."""
    h = F.lower(F.regexp_extract(url, _HOST, 1))
    return (h == "") | h.rlike(r"^(localhost$|127\.|0\.|10\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)")


def rejected_cover(url: Column) -> Column:
    """The URL, or an empty string where it is a site's default picture."""
    return F.when(url.rlike("(?i)logo|default-cover|placeholder|favicon"), "").otherwise(url)


def modern_number(url: Column) -> Column:
    """Number after ``chapters/``, or null."""
    return F.nullif(F.regexp_extract(url, r"(?i)chapters/(\d+)", 1), F.lit("")).try_cast("long")


def generic_number(url: Column, title: Column) -> Column:
    """Number of a part: after a chapter word, in a query parameter, in the last path
    segment that has one, in the title; null if nowhere."""
    take = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit("")).try_cast("int")
    segments = F.reverse(F.split(F.split(url, r"\?")[0], "/"))
    numbered = F.filter(segments, lambda s: s.rlike(r"\d{1,4}(?:\D|$)"))
    return F.coalesce(
        take(url, r"(?iu)(?:chapter|chapters|chapitre|part|episode|read|فصل)[-_/]?(\d{1,4})"),
        take(url, r"(?i)[?&](?:chapter|chap|ep|part|id)=(\d{1,4})"),
        take(F.try_element_at(numbered, F.lit(1)), r"(\d{1,4})(?:\D|$)"),
        take(title, r"(\d{1,4})"),
    )


def story_id(url: Column) -> Column:
    """Digits after ``/story/``, else the first six digits or more; null if none."""
    a = F.nullif(F.regexp_extract(url, r"/story/(\d+)", 1), F.lit(""))
    return F.coalesce(a, F.nullif(F.regexp_extract(url, r"(\d{6,})", 1), F.lit("")))


def chapter_like(url: Column, label: Column) -> Column:
    """Whether a link looks like one to a part of a work: a chapter word in it, or a
    digit in a path of at least two levels. The words are fixed values."""
    word = F.concat_ws(" ", url, label).rlike(r"(?iu)chapter|chapitre|capitulo|capítulo|part|partie|episode|ep\b|read|فصل|جزء|قراءة")
    path = F.regexp_extract(url, r"(?i)^https?://[^/?#]+([^?#]*)", 1)
    return word | (path.rlike(r"\d") & (F.size(F.split(path, "/")) >= 3))


def listing_blacklist(url: Column) -> Column:
    """Whether a link leads to a site's own pages; the words are fixed values."""
    return url.rlike("(?iu)login|signin|register|signup|privacy|terms|contact|about|dmca|policy|tag|genre|category|search|دخول|تسجيل|سياسة|اتصل|حول|تصنيف")
