"""Queries that render works."""

from __future__ import annotations

from foliomill.functions import images as I
from foliomill.operators import export
from foliomill.operators.pages import map_rows
from foliomill.plans.registry import CURRENT, Registry, table

query = Registry()

_W = r"[ \t\n\v\f\r]"
_L = "CASE WHEN lower(left(coalesce(language_code, ''), 2)) IN ('ar', 'fr', 'en') THEN lower(left(language_code, 2)) ELSE 'ar' END"


def _head(ar: str, fr: str, en: str) -> str:
    fr = fr.replace("'", "''")
    return f"CASE l WHEN 'fr' THEN '{fr}' WHEN 'en' THEN '{en}' ELSE '{ar}' END"


_NOTES = f"""{_head("ملاحظات الاستيراد", "Notes d'importation", "Import notes")} || ' — ' || {_head("فصول لم تُقرأ تلقائيًا", "Chapitres non récupérés", "Chapters not retrieved")} || ': ' || missing"""
_WORKS = rf"""{CURRENT},
done AS (SELECT * FROM cur WHERE status = 'done' AND (regexp_replace(coalesce(plain_text, ''), '\s', '', 'g') <> '' OR len(list_filter(coalesce(blocks, []), lambda b: b.type = 'img')) > 0)),
gone AS (SELECT book_id, string_agg(idx || '. ' || coalesce(title, ''), ' • ' ORDER BY idx) AS missing FROM cur WHERE status IS DISTINCT FROM 'done' GROUP BY book_id),
works AS (SELECT b.book_id, coalesce(title, '') AS title, coalesce(author, '') AS author, coalesce(description, '') AS description, coalesce(source_url, '') AS source_url, {_L} AS l, missing, coalesce(octet_length(cover), 0) AS c
  FROM books b LEFT JOIN gone g ON b.book_id = g.book_id)"""
_TEXT = rf"regexp_replace(regexp_replace(array_to_string(list_transform(list_filter(blocks, lambda b: b.type IN ('p', 'h')), lambda b: coalesce(b.text, '')), chr(10) || chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{_W}+|{_W}+$', '', 'g')"
N = "chr(10)"


@query(
    f"""WITH {_WORKS}, parts AS (SELECT book_id, count(*) AS n, string_agg({N} || '— ' || idx || '. ' || coalesce(title, '') || ' —' || {N} || {N} || CASE WHEN coalesce({_TEXT}, '') = '' THEN '(فارغ)' ELSE {_TEXT} END, {N} ORDER BY idx) AS body FROM done GROUP BY book_id)
    SELECT w.book_id, 0 AS volume, title || {N} || CASE WHEN author <> '' THEN {_head("المؤلف", "Auteur", "Author")} || ': ' || author || {N} ELSE '' END || {_head("المصدر", "Source", "Source")} || ': ' || source_url || {N} || repeat('=', 48) || {N}
      || CASE WHEN description <> '' THEN {_head("الوصف", "Résumé", "Summary")} || {N} || description || {N} || {N} ELSE '' END || {_head("الفصول", "Chapitres", "Chapters")} || ': ' || coalesce(n, 0) || {N}
      || coalesce({N} || body, '') || CASE WHEN missing IS NULL THEN '' ELSE {N} || {N} || repeat('=', 48) || {N} || {_NOTES} END AS content
    FROM works w LEFT JOIN parts p ON w.book_id = p.book_id"""
)
def export_txt(spark, d):
    return export.txt(table(spark, d, "books"), table(spark, d, "chapters"))


_BLOCK = "CASE b.type WHEN 'p' THEN coalesce(b.text, '') WHEN 'h' THEN '### ' || coalesce(b.text, '') ELSE '![' || coalesce(b.alt, 'صورة الفصل') || '](' || coalesce(b.src, '') || ')' END || chr(10)"


@query(
    f"""WITH {_WORKS}, parts AS (SELECT book_id, string_agg(idx || '. ' || coalesce(title, ''), {N} ORDER BY idx) AS toc,
      string_agg({N} || '## ' || idx || '. ' || coalesce(title, '') || {N} || CASE WHEN coalesce(len(blocks), 0) > 0 THEN {N} || array_to_string(list_transform(blocks, lambda b: {_BLOCK}), {N}) ELSE '' END, {N} ORDER BY idx) AS body FROM done GROUP BY book_id)
    SELECT w.book_id, 0 AS volume, '# ' || title || {N} || {N} || CASE WHEN author <> '' THEN '**' || {_head("المؤلف", "Auteur", "Author")} || ':** ' || author || {N} || {N} ELSE '' END || '**' || {_head("المصدر", "Source", "Source")} || ':** ' || source_url || {N} || {N}
      || CASE WHEN c > 0 THEN {N} || '![الغلاف](./cover.jpg)' || {N} || {N} ELSE '' END || CASE WHEN description <> '' THEN '## ' || {_head("الوصف", "Résumé", "Summary")} || {N} || {N} || description || {N} || {N} ELSE '' END
      || '## ' || {_head("المحتويات", "Sommaire", "Contents")} || {N} || {N} || coalesce(toc || {N}, '') || coalesce({N} || body, '') || CASE WHEN missing IS NULL THEN '' ELSE {N} || {N} || '---' || {N} || {N} || '_' || {_NOTES} || '_' END AS content
    FROM works w LEFT JOIN parts p ON w.book_id = p.book_id"""
)
def export_md(spark, d):
    return export.md(table(spark, d, "books"), table(spark, d, "chapters"))


@query(f"WITH {_WORKS} SELECT book_id, CASE WHEN missing IS NULL THEN NULL ELSE {_NOTES} END AS line FROM works")
def notes_line(spark, d):
    return export.notes_line(table(spark, d, "books"), table(spark, d, "chapters"))


def _files(kind: str):
    def run(spark, d):
        return export.export(kind, table(spark, d, "books"), table(spark, d, "chapters"), table(spark, d, "images"))

    run.__name__ = f"export_{kind}"
    return run


_BASE = r"""left(regexp_replace(regexp_replace(regexp_replace(title, '[\\/:*?"<>|\n\r\t]', ' ', 'g'), '[ \t\n\v\f\r]+', ' ', 'g'), '^ | $', '', 'g'), 70)"""


def _file(kind: str, mime: str) -> str:
    return f"w.book_id, 0 AS volume, CASE WHEN {_BASE} = '' THEN 'book-' || w.book_id ELSE {_BASE} END || ' - ' || w.book_id || '.{kind}' AS filename, '{mime}' AS mime"


def _json(value: str) -> str:
    return f"CAST(to_json({value}) AS VARCHAR)"


def _pairs(*names: tuple[str, str]) -> str:
    """JSON members of values, those that are null left out, each with a comma before it."""
    return " || ".join(f"CASE WHEN {v} IS NULL THEN '' ELSE ',\"{k}\":' || {_json(v)} END" for k, v in names)


_BLOCK_JSON = f"'{{' || substr({_pairs(('type', 'b.type'), ('text', 'b.text'), ('src', 'b.src'), ('alt', 'b.alt'))}, 2) || '}}'"
query(
    f"""WITH {_WORKS}, parts AS (SELECT book_id, count(*) AS n, string_agg('{{"index":' || idx || {_pairs(('title', 'title'), ('url', 'source_url'))}
        || CASE WHEN blocks IS NULL THEN '' ELSE ',"blocks":[' || array_to_string(list_transform(blocks, lambda b: {_BLOCK_JSON}), ',') || ']' END || {_pairs(('text', _TEXT))} || '}}', ',' ORDER BY idx) AS body FROM done GROUP BY book_id),
    names AS (SELECT book_id, string_agg({_json("idx || '. ' || coalesce(title, '')")}, ',' ORDER BY idx) AS gone FROM cur WHERE status IS DISTINCT FROM 'done' GROUP BY book_id)
    SELECT {_file("json", "application/json; charset=utf-8")}, '{{"title":' || {_json("title")} || ',"author":' || {_json("author")} || ',"description":' || {_json("description")} || ',"language":' || {_json("coalesce(code, '')")} || ',"source":' || {_json("source_url")}
      || ',"chapterCount":' || coalesce(n, 0) || ',"unavailableChapters":[' || coalesce(gone, '') || '],"chapters":[' || coalesce(body, '') || ']}}' AS content
    FROM works w LEFT JOIN parts p ON w.book_id = p.book_id LEFT JOIN names g ON w.book_id = g.book_id LEFT JOIN (SELECT book_id, language_code AS code FROM books) c ON w.book_id = c.book_id"""
)(_files("json"))


def _esc(value: str) -> str:
    return f"replace(replace(replace(replace(coalesce({value}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


_BLOCK_HTML = f"""CASE WHEN b.type = 'img' THEN '<figure><img src="' || {_esc("b.src")} || '" alt="' || {_esc("b.alt")} || '" loading="lazy" /></figure>' WHEN coalesce(b.text, '') = '' THEN ''
  WHEN b.type = 'h' THEN '<h3>' || {_esc("b.text")} || '</h3>' ELSE '<p>' || {_esc("b.text")} || '</p>' END"""
query(
    f"""WITH {_WORKS}, parts AS (SELECT book_id, string_agg('<li><a href="#ch-' || idx || '">' || {_esc("title")} || '</a></li>', {N} ORDER BY idx) AS toc,
      string_agg('<section id="ch-' || idx || '">' || {N} || '<h2>' || idx || '. ' || {_esc("title")} || '</h2>' || {N} || array_to_string(list_transform(coalesce(blocks, []), lambda b: {_BLOCK_HTML}), {N}) || {N} || '</section>', {N} ORDER BY idx) AS body FROM done GROUP BY book_id)
    SELECT {_file("html", "text/html; charset=utf-8")}, '<!doctype html>' || {N} || '<html lang="' || l || '" dir="' || CASE l WHEN 'ar' THEN 'rtl' ELSE 'ltr' END || '">' || {N} || '<head>' || {N} || '<meta charset="utf-8" />' || {N} || '<title>' || {_esc("title")} || '</title>'
      || {N} || '</head>' || {N} || '<body>' || {N} || '<header>' || {N} || CASE WHEN w.c > 0 THEN '<img alt="" src="data:' || coalesce(cover_mime, 'image/jpeg') || ';base64,' || to_base64(cover) || '" />' || {N} ELSE '' END || '<h1>' || {_esc("title")} || '</h1>' || {N} || '<div>'
      || CASE WHEN author <> '' THEN {_head("المؤلف", "Auteur", "Author")} || ': ' || {_esc("author")} || ' • ' ELSE '' END || {_esc("source_url")} || '</div>' || {N} || '</header>' || {N} || CASE WHEN description <> '' THEN '<p>' || {_esc("description")} || '</p>' || {N} ELSE '' END
      || '<nav><h2>' || {_head("المحتويات", "Sommaire", "Contents")} || '</h2><ol>' || {N} || coalesce(toc, '') || {N} || '</ol></nav>' || {N} || coalesce(body, '') || CASE WHEN missing IS NULL THEN '' ELSE {N} || '<div><p>' || {_esc(_NOTES)} || '</p></div>' END || {N} || '</body>' || {N} || '</html>' AS content
    FROM works w LEFT JOIN parts p ON w.book_id = p.book_id LEFT JOIN (SELECT book_id, cover, cover_mime FROM books) k ON w.book_id = k.book_id"""
)(_files("html"))
for _kind in ("fb2", "epub", "docx", "pdf"):
    query()(_files(_kind))


def _size(row: dict) -> dict:
    width, height = I.dimensions(row["bytes"], row["mime"])
    return {"src": row["src"], "width": width, "height": height}


@query("SELECT src, CASE WHEN mime IN ('image/png', 'image/jpeg', 'image/gif', 'image/webp') THEN width ELSE 0 END AS width, CASE WHEN mime IN ('image/png', 'image/jpeg', 'image/gif', 'image/webp') THEN height ELSE 0 END AS height FROM images")
def image_dimensions(spark, d):
    return map_rows(table(spark, d, "images").select("src", "bytes", "mime"), _size, "src string, width int, height int")
