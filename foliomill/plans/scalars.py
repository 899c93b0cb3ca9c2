"""Queries that apply one scalar function to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill.functions import text as T
from foliomill.functions import url as U
from foliomill.plans.registry import Registry, table

query = Registry()

INVISIBLE = "[​-‏‪-‮⁦-⁩]"
_TRIM = r"regexp_replace({}, '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g')"


def _norm(c: str) -> str:
    t = f"regexp_replace(replace({c}, ' ', ' '), '{INVISIBLE}', '', 'g')"
    t = rf"regexp_replace({t}, '[ \t]{{2,}}', ' ', 'g')"
    return _TRIM.format(rf"regexp_replace({t}, '[ \t\n\v\f\r]*\n[ \t\n\v\f\r]*', chr(10), 'g')")


_EDGE = r"[ \t\n\v\f\r\-–—:_.]+"


@query(f"SELECT chapter_id, {_norm('plain_text')} AS text FROM chapters")
def normalize_text(spark, d):
    return table(spark, d, "chapters").select("chapter_id", T.normalize(F.col("plain_text")).alias("text"))


@query(f"SELECT chapter_id, regexp_replace({_norm('title')}, '^{_EDGE}|{_EDGE}$', '', 'g') AS title FROM chapters")
def sanitize_title(spark, d):
    return table(spark, d, "chapters").select("chapter_id", T.sanitize_title(F.col("title")).alias("title"))


@query(rf"""SELECT page_id, {_norm(r"regexp_replace(regexp_extract(html, '<title>([^<]*)', 1), '(?i)\s*[-–|—:]\s*books\s*$', '')")} AS title FROM pages""")
def strip_site_suffix(spark, d):
    raw = F.regexp_extract("html", "<title>([^<]*)", 1)
    return table(spark, d, "pages").select("page_id", T.strip_suffixes(raw, ["Books"]).alias("title"))


@query()
def scrub_copy_guards(spark, d):
    return table(spark, d, "chapters").select("chapter_id", T.scrub_copy_guards(F.col("plain_text")).alias("text"))


@query(r"SELECT chapter_id, coalesce(len(list_filter(regexp_split_to_array(plain_text, '[ \t\n\v\f\r]+'), lambda w: regexp_matches(w, '[\p{L}\p{N}]'))), 0) AS words, coalesce(length(plain_text), 0) AS chars FROM chapters")
def word_count(spark, d):
    return table(spark, d, "chapters").select("chapter_id", T.word_count(F.col("plain_text")).alias("words"), F.coalesce(F.length("plain_text"), F.lit(0)).alias("chars"))


@query("SELECT chapter_id, regexp_matches(plain_text, '[؀-ۿ]') AS arabic FROM chapters")
def has_arabic(spark, d):
    return table(spark, d, "chapters").select("chapter_id", T.has_arabic(F.col("plain_text")).alias("arabic"))


@query(
    """SELECT book_id, l AS lang, CASE WHEN l = 'ar' THEN 'rtl' ELSE 'ltr' END AS dir, CASE l WHEN 'fr' THEN 'Chapitres' WHEN 'en' THEN 'Chapters' ELSE 'الفصول' END AS heading
    FROM (SELECT book_id, CASE WHEN lower(left(coalesce(language_code, ''), 2)) IN ('ar', 'fr', 'en') THEN lower(left(language_code, 2)) ELSE 'ar' END AS l FROM books)"""
)
def export_language(spark, d):
    lang = T.language_of_export(F.col("language_code"))
    heading = T.lookup({k: v["chapters"] for k, v in T.HEADERS.items()}, lang)
    return table(spark, d, "books").select("book_id", lang.alias("lang"), T.direction(lang).alias("dir"), heading.alias("heading"))


@query(
    """SELECT book_id, CASE WHEN regexp_matches(n, 'عرب|arab') THEN 'ar' WHEN regexp_matches(n, 'fran|fren') THEN 'fr' WHEN regexp_matches(n, 'engl') THEN 'en' ELSE 'ar' END AS lang
    FROM (SELECT book_id, lower(coalesce(CASE book_id % 5 WHEN 0 THEN 'English' WHEN 1 THEN 'Français' WHEN 2 THEN 'العربية' WHEN 3 THEN 'Arabic' END, '')) AS n FROM books)"""
)
def language_from_name(spark, d):
    k = F.col("book_id") % 5
    name = F.when(k == 0, "English").when(k == 1, "Français").when(k == 2, "العربية").when(k == 3, "Arabic")
    return table(spark, d, "books").select("book_id", T.language_from_name(name).alias("lang"))


@query(
    r"""SELECT page_id, CASE WHEN l IN ('ar', 'fr', 'en') THEN l ELSE 'ar' END AS lang FROM (
    SELECT page_id, lower(left(regexp_extract(html, '(?i)<html[^>]*\slang\s*=\s*["'']?([^"''\s>]+)', 1), 2)) AS l FROM pages)"""
)
def html_lang(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_language(F.col("html")).alias("lang"))


_ORD = r"""coalesce(try_cast(nullif(regexp_extract(title, '(?i)(?:الفصل|الجزء|chapter|chapitre|part|episode)\s*[-_#]*\s*(\d{1,4})', 1), '') AS INTEGER),
           try_cast(nullif(regexp_extract(source_url, '(?i)(?:post_id|chapter|chapitre|chapter_id|ep|part|id)=(\d{1,7})', 1), '') AS INTEGER))"""


@query(f"SELECT chapter_id, {_ORD} AS ordinal FROM chapters")
def chapter_ordinal(spark, d):
    return table(spark, d, "chapters").select("chapter_id", T.chapter_ordinal(F.col("title"), F.col("source_url")).alias("ordinal"))


@query(
    "SELECT chapter_id, regexp_matches(title, '(?i)ابدأ القراءة|أبدأ القراءة|اقرأ الآن|اقرأي|متابعة القراءة|الصفحة التالية|السابق|التالي|start reading|read now|continue reading|next chapter|previous chapter|login|sign in|register|share|comments?') AS call FROM chapters"
)
def call_to_action(spark, d):
    return table(spark, d, "chapters").select("chapter_id", T.call_to_action(F.col("title")).alias("call"))


_HTML = "replace(replace(replace(replace(plain_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"SELECT chapter_id, {_HTML} AS html, replace({_HTML}, '''', '&apos;') AS xml FROM chapters")
def escape_html(spark, d):
    return table(spark, d, "chapters").select("chapter_id", T.escape_html(F.col("plain_text")).alias("html"), T.escape_xml(F.col("plain_text")).alias("xml"))


_URLMIME = """CASE lower(list_extract(string_split(string_split(string_split(src, '?')[1], '#')[1], '.'), -1)) WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'jpe' THEN 'image/jpeg'
  WHEN 'png' THEN 'image/png' WHEN 'gif' THEN 'image/gif' WHEN 'webp' THEN 'image/webp' WHEN 'avif' THEN 'image/avif' WHEN 'bmp' THEN 'image/bmp' WHEN 'svg' THEN 'image/svg+xml' ELSE 'application/octet-stream' END"""


@query(f"SELECT src, {_URLMIME} AS mime, starts_with({_URLMIME}, 'image/') AS is_image FROM images")
def mime_from_url(spark, d):
    mime = T.mime_from_url(F.col("src"))
    return table(spark, d, "images").select("src", mime.alias("mime"), mime.startswith("image/").alias("is_image"))


@query(
    f"""SELECT src, CASE WHEN octet_length(bytes) > 12 THEN CASE WHEN starts_with(hex(bytes), 'FFD8') THEN 'image/jpeg' WHEN starts_with(hex(bytes), '8950') THEN 'image/png'
    WHEN starts_with(hex(bytes), '4749') THEN 'image/gif' WHEN substr(hex(bytes), 17, 8) = '57454250' THEN 'image/webp' WHEN contains(substr(hex(bytes), 9, 16), '6674797061766966') THEN 'image/avif'
    WHEN contains(lower(substr(hex(bytes), 1, 400)), '3c737667') THEN 'image/svg+xml' ELSE {_URLMIME} END ELSE {_URLMIME} END AS mime FROM images"""
)
def sniff_mime(spark, d):
    return table(spark, d, "images").select("src", T.sniff_image_type(F.col("bytes"), F.col("src")).alias("mime"))


@query(
    """SELECT src, 'images/' || left(sha1(src), 20) || '.' || CASE lower(mime) WHEN 'image/png' THEN 'png' WHEN 'image/gif' THEN 'gif' WHEN 'image/webp' THEN 'webp' WHEN 'image/avif' THEN 'avif'
    WHEN 'image/bmp' THEN 'bmp' WHEN 'image/svg+xml' THEN 'svg' ELSE 'jpg' END AS entry FROM images"""
)
def image_entry_name(spark, d):
    return table(spark, d, "images").select("src", T.image_entry(F.col("src"), F.col("mime")).alias("entry"))


@query("SELECT chapter_id, printf('ch-%03d', idx) AS entry FROM chapters")
def entry_id(spark, d):
    return table(spark, d, "chapters").select("chapter_id", T.entry_id("ch", F.col("idx")).alias("entry"))


_BASE = r"""left(regexp_replace(regexp_replace(regexp_replace(coalesce(title, ''), '[\\/:*?"<>|\n\r\t]', ' ', 'g'), '[ \t\n\v\f\r]+', ' ', 'g'), '^ | $', '', 'g'), 70)"""


@query(f"SELECT book_id, CASE WHEN {_BASE} = '' THEN 'book-' || book_id ELSE {_BASE} END || ' - ' || book_id || '.epub' AS name FROM books")
def safe_filename(spark, d):
    return table(spark, d, "books").select("book_id", T.safe_filename(F.col("title"), F.col("book_id"), "epub").alias("name"))


@query("SELECT chapter_id, regexp_extract(source_url, '(?i)^(https?://[^/?#]+)', 1) AS origin FROM chapters")
def url_origin(spark, d):
    return table(spark, d, "chapters").select("chapter_id", U.origin(F.col("source_url")).alias("origin"))


@query(
    r"""SELECT book_id, CASE WHEN regexp_matches(h, 'wattpad\.com$') THEN 'wattpad' WHEN regexp_matches(h, 'novlar|khalidblog') THEN 'portal' WHEN regexp_matches(h, 'uranus-novel|novel') THEN 'modern' ELSE 'generic' END AS adapter
    FROM (SELECT book_id, regexp_replace(lower(regexp_extract(source_url, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '') AS h FROM books)"""
)
def adapter_routing(spark, d):
    return table(spark, d, "books").select("book_id", U.adapter(F.col("source_url")).alias("adapter"))


def _pasted(c):
    """An address as a reader might paste it, a different way for each work."""
    k = F.col("book_id") % 6
    bare = F.regexp_replace(c, "^https?://", "")
    return F.when(k == 0, bare).when(k == 1, F.concat(F.lit(" <b>«"), c, F.lit("»</b> "))).when(k == 2, F.concat(F.left(c, F.lit(30)), F.lit("…"))).when(k == 3, "").when(k == 4, "not a link").otherwise(F.concat(c, F.lit("?a=1&amp;b=2")))


@query(
    r"""WITH raw AS (SELECT book_id, CASE book_id % 6 WHEN 0 THEN regexp_replace(source_url, '^https?://', '') WHEN 1 THEN ' <b>«' || source_url || '»</b> ' WHEN 2 THEN left(source_url, 30) || '…'
      WHEN 3 THEN '' WHEN 4 THEN 'not a link' ELSE source_url || '?a=1&amp;b=2' END AS r FROM books),
    v AS (SELECT book_id, regexp_replace(regexp_replace(replace(regexp_replace(r, '<[^>]*>', ' ', 'g'), '&amp;', '&'), '[«»"''`؛;،,]+', '', 'g'), '[\s\p{Z}]+', '', 'g') AS v FROM raw),
    s AS (SELECT book_id, v, regexp_matches(v, '\.\.\.|…') AS short, CASE WHEN regexp_matches(v, '(?i)^https?://') THEN v WHEN regexp_matches(v, '(?i)^[a-z0-9.\-]+\.[a-z]{2,}(/|$)') THEN 'https://' || v END AS u FROM v),
    e AS (SELECT book_id, u, CASE WHEN v = '' THEN 'empty' WHEN short THEN 'truncated' WHEN coalesce(regexp_matches(u, '(?i)^https?://(?:[^/?#@]*@)?[^/?#:]*\.[^/?#:]*'), false) THEN NULL ELSE 'invalid' END AS error FROM s)
    SELECT book_id, CASE WHEN error IS NULL THEN u END AS url, error FROM e"""
)
def normalize_url(spark, d):
    return table(spark, d, "books").select("book_id", U.normalize_url(_pasted(F.col("source_url"))).alias("n")).select("book_id", "n.url", "n.error")


@query(
    r"""SELECT book_id, h = '' OR regexp_matches(h, '^(localhost$|127\.|0\.|10\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)') AS private FROM (
    SELECT book_id, lower(regexp_extract(cover_url, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS h FROM books)"""
)
def private_address(spark, d):
    return table(spark, d, "books").select("book_id", U.private_address(F.col("cover_url")).alias("private"))


@query("SELECT book_id, CASE WHEN regexp_matches(cover_url, '(?i)logo|default-cover|placeholder|favicon') THEN '' ELSE cover_url END AS cover_url FROM books")
def cover_reject(spark, d):
    return table(spark, d, "books").select("book_id", U.rejected_cover(F.col("cover_url")).alias("cover_url"))


@query(
    r"""SELECT chapter_id, try_cast(nullif(regexp_extract(source_url, '(?i)chapters/(\d+)', 1), '') AS BIGINT) AS modern,
    coalesce(nullif(regexp_extract(source_url, '/story/(\d+)', 1), ''), nullif(regexp_extract(source_url, '(\d{6,})', 1), '')) AS story FROM chapters"""
)
def url_numbers(spark, d):
    u = F.col("source_url")
    return table(spark, d, "chapters").select("chapter_id", U.modern_number(u).alias("modern"), U.story_id(u).alias("story"))


_SEGMENT = r"list_filter(list_reverse(string_split(string_split(source_url, '?')[1], '/')), lambda s: regexp_matches(s, '\d{1,4}(?:\D|$)'))[1]"


@query(
    rf"""SELECT chapter_id, coalesce(try_cast(nullif(regexp_extract(source_url, '(?i)(?:chapter|chapters|chapitre|part|episode|read|فصل)[-_/]?(\d{{1,4}})', 1), '') AS INTEGER),
    try_cast(nullif(regexp_extract(source_url, '(?i)[?&](?:chapter|chap|ep|part|id)=(\d{{1,4}})', 1), '') AS INTEGER), try_cast(nullif(regexp_extract({_SEGMENT}, '(\d{{1,4}})(?:\D|$)', 1), '') AS INTEGER),
    try_cast(nullif(regexp_extract(title, '(\d{{1,4}})', 1), '') AS INTEGER)) AS number FROM chapters"""
)
def generic_number(spark, d):
    return table(spark, d, "chapters").select("chapter_id", U.generic_number(F.col("source_url"), F.col("title")).alias("number"))


@query("SELECT src, '/api/image?u=' || replace(replace(src, ':', '%3A'), '/', '%2F') || '&r=https%3A%2F%2Fexample.org%2F' AS path FROM images")
def proxied_image(spark, d):
    return table(spark, d, "images").select("src", T.proxied(F.col("src"), F.lit("https://example.org/")).alias("path"))


_FACTS = "^(?:كتبت بتاريخ|عدد الفصول|حالة الرواية|اللغة|آخر تحديث|المشاهدات|التقييم|الناشر|سنة النشر)"
_MIXED = "description || chr(10) || chr(10) || 'اللغة: ' || coalesce(language_code, '') || chr(10) || ' ' || title"
_SUMMED = f"array_to_string(list_filter(list_transform(regexp_split_to_array({_MIXED}, '\\n+'), lambda x: {_TRIM.format('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '{_FACTS}')), chr(10))"


@query(f"SELECT book_id, {_norm(_SUMMED)} AS summary FROM books")
def summary_lines(spark, d):
    mixed = F.concat(F.col("description"), F.lit("\n\nاللغة: "), F.coalesce("language_code", F.lit("")), F.lit("\n "), F.col("title"))
    return table(spark, d, "books").select("book_id", T.summary_lines(mixed).alias("summary"))


@query("SELECT src, CASE lower(mime) WHEN 'image/png' THEN 'png' WHEN 'image/gif' THEN 'gif' WHEN 'image/webp' THEN 'webp' WHEN 'image/avif' THEN 'avif' WHEN 'image/bmp' THEN 'bmp' WHEN 'image/svg+xml' THEN 'svg' ELSE 'jpg' END AS extension FROM images")
def extension_for_mime(spark, d):
    return table(spark, d, "images").select("src", T.lookup(T.IMAGE_EXTENSIONS, F.lower("mime"), "jpg").alias("extension"))
