"""Sources and formats read back: what a reader of printed data, embedded objects,
encoded bytes, listing pages and book files gets must be what the tables hold."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree as ET

from pyspark.sql import functions as F

from foliomill.functions import text as T
from foliomill.functions import url as U
from foliomill.operators import export, pages, store
from foliomill.plans.exports import _TEXT, _WORKS, N, _head
from foliomill.plans.registry import CURRENT, LISTING, Registry, table
from foliomill.sources import documents

query = Registry()


@query(f"WITH {CURRENT} SELECT chapter_id, book_id, idx, title, status FROM cur WHERE book_id = 1 AND idx = 1")
def lookup_part(spark, d):
    return store.lookup(table(spark, d, "chapters"), 1, 1).select("chapter_id", "book_id", "idx", "title", "status")


@query("SELECT chapter_id, coalesce(title, '') AS title, idx, status IS NOT DISTINCT FROM 'done' AS done, coalesce(host, '') AS second FROM chapters")
def printed_arrays(spark, d):
    """Rows printed as arrays and read again."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    done = F.when(F.col("status").eqNullSafe("done"), "true").otherwise("false")
    printed = F.concat(F.lit("array ( 'idx' => "), "idx", F.lit(",\n 'title' => "), quoted(F.col("title")), F.lit(", 'done' => "), done, F.lit(", 'list' => array ( 2 => "), quoted(F.col("host")), F.lit(", 0 => NULL, ), )"))
    rows = table(spark, d, "chapters").select("chapter_id", documents.loose(printed).alias("j"))
    s = F.from_json("j", "struct<idx:int,title:string,done:boolean,list:array<string>>")
    return rows.select("chapter_id", s["title"].alias("title"), s["idx"].alias("idx"), s["done"].alias("done"), s["list"][1].alias("second"))


@query("SELECT chapter_id, title FROM chapters")
def decoded_bytes(spark, d):
    """Titles as bytes with a declared charset, decoded again."""
    narrow = F.col("title").rlike("^[\\x00-\\xff]*$")
    data = F.when(narrow, F.encode("title", "ISO-8859-1")).otherwise(F.encode("title", "UTF-8"))
    kind = F.when(narrow, "text/html; charset=iso-8859-1").otherwise("text/html")
    return table(spark, d, "chapters").select("chapter_id", documents.decoded(data, kind).alias("title"))


@query(
    f"""WITH {LISTING} SELECT b.book_id, b.title AS work, b.author, CAST(row_number() OVER (PARTITION BY b.book_id ORDER BY r.idx) AS INTEGER) AS idx, r.title, r.url
    FROM refs r JOIN books b ON r.book_id = b.book_id"""
)
def embedded_stories(spark, d):
    """Works and their listed parts embedded in pages as objects, found and opened again."""
    part = F.struct("idx", F.col("idx").cast("long").alias("id"), "title", "url")
    parts = store.listing(table(spark, d, "chapter_refs")).groupBy("book_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    parts = parts.select("book_id", F.transform("parts", lambda p: F.struct(p["id"].alias("id"), p["title"].alias("title"), p["url"].alias("url"))).alias("parts"))
    rows = table(spark, d, "books").select("book_id", "title", F.struct(F.col("author").alias("name")).alias("user")).join(parts, "book_id")
    html = F.concat(F.lit('<html><body>{ braces }<script>window.data = {"page":{"story":'), F.to_json(F.struct("title", "user", "parts")), F.lit("}};</script></body></html>"))
    return documents.story_parts(rows.select("book_id", documents.embedded(html).alias("j")), "j")


_LIKE = "chapter|chapitre|capitulo|capítulo|part|partie|episode|ep\\b|read|فصل|جزء|قراءة"
_CALL = "ابدأ القراءة|أبدأ القراءة|اقرأ الآن|اقرأي|متابعة القراءة|الصفحة التالية|السابق|التالي|start reading|read now|continue reading|next chapter|previous chapter|login|sign in|register|share|comments?"
_OWN = "login|signin|register|signup|privacy|terms|contact|about|dmca|policy|tag|genre|category|search|دخول|تسجيل|سياسة|اتصل|حول|تصنيف"
_EDGE = r"[ \t\n\v\f\r\-–—:_.]"


@query(
    rf"""WITH {LISTING}, links AS (SELECT r.book_id AS page_id, r.url AS href, r.idx, regexp_extract(b.source_url, '^https?://[^/?#]+') AS own, regexp_extract(r.url, '^https?://[^/?#]+') AS origin,
      regexp_replace(regexp_replace(coalesce(r.title, ''), '[ \t]{{2,}}', ' ', 'g'), '^{_EDGE}+|{_EDGE}+$', '', 'g') AS label FROM refs r JOIN books b ON r.book_id = b.book_id),
    kept AS (SELECT * FROM links WHERE own = origin AND NOT regexp_matches(href, '(?i){_OWN}') AND length(label) >= 2 AND NOT regexp_matches(label, '(?i){_CALL}')
      AND (regexp_matches(href || ' ' || label, '(?i){_LIKE}') OR (regexp_matches(regexp_extract(href, '^https?://[^/?#]+([^?#]*)', 1), '\d') AND len(string_split(regexp_extract(href, '^https?://[^/?#]+([^?#]*)', 1), '/')) >= 3)))
    SELECT page_id, href, arg_min(label, idx) AS label FROM kept GROUP BY page_id, href"""
)
def listing_links(spark, d):
    """Listing pages made of the listed parts, and the links that a listing keeps of them."""
    link = F.concat(F.lit('<li><a href="'), T.escape_html(F.col("url")), F.lit('">'), T.escape_html(F.coalesce("title", F.lit(""))), F.lit("</a>"))
    lists = store.listing(table(spark, d, "chapter_refs")).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("idx", link.alias("a")))).alias("links"))
    html = F.concat(F.lit("<html><body><nav><a href='/login'>Log in to read</a></nav><ul>"), F.array_join(F.transform("links", lambda x: x["a"]), "\n"), F.lit("</ul>"))
    rows = table(spark, d, "books").select("book_id", "source_url").join(lists, "book_id")
    found = pages.kept_links(pages.page_links(rows.select(F.col("book_id").alias("page_id"), F.col("source_url").alias("url"), html.alias("html"))))
    return found.select("page_id", "href", "label")


def _xhtml_parts(row: dict) -> list[dict]:
    files = zipfile.ZipFile(io.BytesIO(row["content"]))
    space = "{http://www.w3.org/1999/xhtml}"
    out = []
    for name in files.namelist():
        if "/ch-" in name:
            said = [x.text or "" for x in ET.fromstring(files.read(name)).iter() if x.tag in (f"{space}h2", f"{space}h3", f"{space}p")]
            out.append({"book_id": row["book_id"], "entry": name, "text": "\n".join(said)})
    return out


_BODY = "array_to_string(list_transform(list_filter(coalesce(blocks, []), lambda b: b.type IN ('p', 'h') AND coalesce(b.text, '') <> ''), lambda b: chr(10) || b.text), '')"


@query(f"WITH {_WORKS} SELECT book_id, 'OEBPS/text/ch-' || printf('%03d', idx) || '.xhtml' AS entry, idx || '. ' || coalesce(title, '') || {_BODY} AS text FROM done")
def epub_parts(spark, d):
    """The part pages of EPUB files, unpacked and read."""
    files = export.export("epub", table(spark, d, "books"), table(spark, d, "chapters"), table(spark, d, "images"))
    return pages.map_rows(files.select("book_id", "content"), _xhtml_parts, "book_id bigint, entry string, text string")


def _docx_text(row: dict) -> dict:
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(row["content"])).read("word/document.xml"))
    return {"book_id": row["book_id"], "text": "\n".join(x.text or "" for x in body.iter(f"{space}t"))}


@query(
    f"""WITH {_WORKS}, parts AS (SELECT book_id, string_agg({N} || idx || '. ' || coalesce(title, '') || {_BODY}, '' ORDER BY idx) AS body FROM done GROUP BY book_id),
    left_out AS (SELECT book_id, string_agg({N} || idx || '. ' || coalesce(title, ''), '' ORDER BY idx) AS names FROM cur WHERE status IS DISTINCT FROM 'done' GROUP BY book_id)
    SELECT w.book_id, title || CASE WHEN author <> '' THEN {N} || author ELSE '' END || CASE WHEN source_url <> '' THEN {N} || source_url ELSE '' END || CASE WHEN description <> '' THEN {N} || description ELSE '' END
      || coalesce(body, '') || coalesce({N} || {_head("فصول لم تُقرأ تلقائيًا", "Chapitres non récupérés", "Chapters not retrieved")} || names, '') AS text
    FROM works w LEFT JOIN parts p ON w.book_id = p.book_id LEFT JOIN left_out o ON w.book_id = o.book_id"""
)
def docx_text(spark, d):
    """The text of DOCX files, unpacked and read."""
    files = export.export("docx", table(spark, d, "books"), table(spark, d, "chapters"), table(spark, d, "images"))
    return pages.map_rows(files.select("book_id", "content"), _docx_text, "book_id bigint, text string")
