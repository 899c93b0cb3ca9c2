"""Text functions as Column expressions; they stay in the JVM.

Null arguments give null unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters without width or that only set direction.
INVISIBLE = r"[​-‏‪-‮⁦-⁩]"
#: What is trimmed from the ends of titles.
TITLE_EDGE = r"[\s\-–—:_.]+"
#: File extension to MIME type of images.
IMAGE_TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "jpe": "image/jpeg", "png": "image/png", "gif": "image/gif",
    "webp": "image/webp", "avif": "image/avif", "bmp": "image/bmp", "svg": "image/svg+xml",
}
#: MIME type to extension of stored images; others are jpg.
IMAGE_EXTENSIONS = {
    "image/jpeg": "jpg", "image/jpg": "jpg", "image/png": "png", "image/gif": "gif", "image/webp": "webp",
    "image/avif": "avif", "image/bmp": "bmp", "image/svg+xml": "svg",
}
#: Format to MIME type.
FORMAT_TYPES = {
    "epub": "application/epub+zip",
    "pdf": "application/pdf",
    "html": "text/html; charset=utf-8",
    "txt": "text/plain; charset=utf-8",
    "md": "text/markdown; charset=utf-8",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "fb2": "application/xml; charset=utf-8",
    "json": "application/json; charset=utf-8",
}
#: Headings of exported documents by language.
HEADERS = {
    "ar": {"chapters": "الفصول", "notes": "ملاحظات الاستيراد", "description": "الوصف", "author": "المؤلف", "source": "المصدر", "unavailable": "فصول لم تُقرأ تلقائيًا", "toc": "المحتويات"},
    "fr": {"chapters": "Chapitres", "notes": "Notes d'importation", "description": "Résumé", "author": "Auteur", "source": "Source", "unavailable": "Chapitres non récupérés", "toc": "Sommaire"},
    "en": {"chapters": "Chapters", "notes": "Import notes", "description": "Summary", "author": "Author", "source": "Source", "unavailable": "Chapters not retrieved", "toc": "Contents"},
}


def lookup(table: dict[str, str], key: Column, default: str | None = None) -> Column:
    """Value of a fixed table by key; ``default`` for keys it lacks and for null."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(entries, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def trimmed(text: Column) -> Column:
    """Without white space at the ends, line ends included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize(text: Column) -> Column:
    """Spaces made plain, invisible characters removed, runs of blanks and line
    ends joined, ends trimmed."""
    t = F.replace(text, F.lit(" "), F.lit(" "))
    t = F.regexp_replace(t, INVISIBLE, "")
    t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    return trimmed(F.regexp_replace(t, r"\s*\n\s*", "\n"))


def sanitize_title(text: Column) -> Column:
    """Normalised, without separators at the ends."""
    return F.regexp_replace(normalize(text), f"^{TITLE_EDGE}|{TITLE_EDGE}$", "")


def strip_suffixes(title: Column, suffixes: list[str]) -> Column:
    """Without site names that follow a separator at the end, one after the other."""
    for s in suffixes:
        title = F.regexp_replace(title, rf"(?iu)\s*[-–|—:]\s*\Q{s}\E\s*$", "")
    return normalize(title)


def scrub_copy_guards(text: Column) -> Column:
    """Letters repeated five times or more made one, leaked entity names and blank
    runs made a space."""
    t = F.regexp_replace(text, r"([a-zA-Z؀-ۿ])\1{4,}", "$1")
    t = F.regexp_replace(t, r"(?i)\b(?:u200b|nbsp|amp)\b", " ")
    return F.regexp_replace(t, r"[^\S\n]{2,}", " ")


def word_count(text: Column) -> Column:
    """Tokens between white space that hold a letter or digit; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]"))), F.lit(0))


def has_arabic(text: Column) -> Column:
    return text.rlike(r"[؀-ۿ]")


def language_of_export(code: Column) -> Column:
    """ar, fr or en by the first two letters of a language code; ar for any other."""
    two = F.lower(F.left(F.coalesce(code, F.lit("")), F.lit(2)))
    return F.when(two.isin("ar", "fr", "en"), two).otherwise("ar")


def direction(language: Column) -> Column:
    return F.when(language == "ar", "rtl").otherwise("ltr")


def language_from_name(name: Column) -> Column:
    """Language code from a language's name in some spelling; ar by default."""
    n = F.lower(F.coalesce(name, F.lit("")))
    return F.when(n.rlike("عرب|arab"), "ar").when(n.rlike("fran|fren"), "fr").when(n.rlike("engl"), "en").otherwise("ar")


def html_language(html: Column) -> Column:
    """ar, fr or en from the lang attribute of the html tag; ar for any other."""
    raw = F.lower(F.left(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html[^>]*\slang\s*=\s*[\"']?([^\"'\s>]+)", 1), F.lit(2)))
    return F.when(raw.isin("ar", "fr", "en"), raw).otherwise("ar")


def chapter_ordinal(label: Column, url: Column) -> Column:
    """Number after a chapter word in the label, else in a query parameter, else null."""
    a = F.regexp_extract(label, r"(?iu)(?:الفصل|الجزء|chapter|chapitre|part|episode)\s*[-_#]*\s*(\d{1,4})", 1)
    b = F.regexp_extract(url, r"(?i)(?:post_id|chapter|chapitre|chapter_id|ep|part|id)=(\d{1,7})", 1)
    return F.coalesce(F.nullif(a, F.lit("")).try_cast("int"), F.nullif(b, F.lit("")).try_cast("int"))


def call_to_action(label: Column) -> Column:
    """Whether a link's label calls to read, sign in or move on, not names a part."""
    return label.rlike(
        "(?iu)ابدأ القراءة|أبدأ القراءة|اقرأ الآن|اقرأي|متابعة القراءة|الصفحة التالية|السابق|التالي|start reading|read now"
        "|continue reading|next chapter|previous chapter|login|sign in|register|share|comments?"
    )


#: Labels of facts that stand between the lines of a summary.
FACT_LABELS = "كتبت بتاريخ|عدد الفصول|حالة الرواية|اللغة|آخر تحديث|المشاهدات|التقييم|الناشر|سنة النشر"


def summary_lines(text: Column) -> Column:
    """A summary without blank lines and labelled facts."""
    lines = F.filter(F.transform(F.split(text, r"\n+"), trimmed), lambda x: (x != "") & ~x.rlike(f"^(?:{FACT_LABELS})"))
    return normalize(F.array_join(lines, "\n"))


def escape_html(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def escape_xml(text: Column) -> Column:
    return F.replace(escape_html(text), F.lit("'"), F.lit("&apos;"))


def mime_from_url(url: Column) -> Column:
    """Image type by the extension of a URL; application/octet-stream for any other."""
    clean = F.split(F.split(url, r"\?")[0], "#")[0]
    return F.when(url.isNotNull(), lookup(IMAGE_TYPES, F.lower(F.element_at(F.split(clean, r"\."), -1)), "application/octet-stream"))


def sniff_image_type(data: Column, url: Column) -> Column:
    """Image type by the first bytes, else by the URL; short data tells nothing."""
    head = F.hex(F.substring(data, 1, 12))
    text = F.lower(F.decode(F.substring(data, 1, 200), "ISO-8859-1"))
    sniffed = (
        F.when(head.startswith("FFD8"), "image/jpeg")
        .when(head.startswith("8950"), "image/png")
        .when(head.startswith("4749"), "image/gif")
        .when(F.substring(head, 17, 8) == "57454250", "image/webp")
        .when(F.substring(head, 9, 16).contains("6674797061766966"), "image/avif")
        .when(text.contains("<svg"), "image/svg+xml")
    )
    return F.coalesce(F.when(F.length(data) > 12, sniffed), mime_from_url(url))


def image_entry(src: Column, mime: Column) -> Column:
    """Name of an image inside a book file."""
    return F.concat(F.lit("images/"), F.left(F.sha1(src), F.lit(20)), F.lit("."), lookup(IMAGE_EXTENSIONS, F.lower(mime), "jpg"))


def entry_id(prefix: str, number: Column) -> Column:
    return F.format_string(prefix + "-%03d", number)


def format_bytes(size: Column) -> Column:
    """A size for reading: bytes, KB with one decimal, MB with two."""
    kb = F.format_string("%.1f KB", size / F.lit(1024.0))
    mb = F.format_string("%.2f MB", size / F.lit(1048576.0))
    return F.when(size <= 0, "0 B").when(size < 1024, F.format_string("%d B", size.cast("long"))).when(size < 1048576, kb).otherwise(mb)


def safe_filename(title: Column, ident: Column, extension: str) -> Column:
    """File name from a title; ``book-<id>`` where nothing of it is left."""
    base = F.regexp_replace(F.coalesce(title, F.lit("")), r'[\\/:*?"<>|\n\r\t]', " ")
    base = F.left(F.regexp_replace(F.regexp_replace(base, r"\s+", " "), "^ | $", ""), F.lit(70))
    name = F.when(base == "", F.concat(F.lit("book-"), ident.cast("string"))).otherwise(base)
    return F.concat(name, F.lit(" - "), ident.cast("string"), F.lit("." + extension))


def proxied(url: Column, referer: Column) -> Column:
    """Path that fetches an image through the server, arguments percent-encoded."""
    enc = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("/api/image?u="), enc(url), F.lit("&r="), enc(referer))
