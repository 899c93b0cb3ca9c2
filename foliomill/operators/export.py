"""Works as documents.

The text formats are string expressions that stay in the JVM; EPUB, DOCX and PDF
are packed by Python workers, one work at a time. A work of very many parts is
written in volumes, so that no group, file or task grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from foliomill.functions import blocks as B
from foliomill.functions import text as X
from foliomill.operators import store

TEXT_FORMATS = ("txt", "md", "html", "json", "fb2")
BINARY_FORMATS = ("epub", "docx", "pdf")
#: Parts of one file; parts with a higher number go into further volumes.
VOLUME_PARTS = 2000
#: Pictures of one file, at most, in number and bytes.
MOST_IMAGES, MOST_IMAGE_BYTES = 400, 60 * 1024 * 1024
RULE = "=" * 48
EMPTY = "(فارغ)"


def volume(idx: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((F.coalesce(idx, F.lit(1)) - 1) / VOLUME_PARTS)).cast("int")


def head(key: str, language: Column) -> Column:
    """A heading of the fixed dictionary in the language of a work."""
    return X.lookup({k: v[key] for k, v in X.HEADERS.items()}, language)


def ordered(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Strings of each work and volume as an array in the order of the parts."""
    pairs = F.array_sort(F.collect_list(F.struct("idx", value.alias("v"))))
    return rows.groupBy("book_id", volume(F.col("idx")).alias("volume")).agg(F.transform(pairs, lambda p: p["v"]).alias(name))


def _gone(chapters: DataFrame) -> tuple[DataFrame, Column]:
    """The parts that aren't available and how each is named."""
    return store.unavailable(chapters), F.concat(F.col("idx").cast("string"), F.lit(". "), F.coalesce("title", F.lit("")))


def volumes(books: DataFrame, *arrays: DataFrame) -> DataFrame:
    """``book_id``, ``volume`` of all files: those with any part, available or not, and
    the first of every work."""
    rows = books.select("book_id", F.lit(0).alias("volume"))
    for a in arrays:
        rows = rows.unionByName(a.select("book_id", "volume"))
    return rows.distinct()


def works(books: DataFrame, chapters: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """One row per work and volume: the fields of the work, arrays of ``parts`` (string
    columns of its exportable parts), and ``missing``, what isn't available."""
    done = store.exportable(chapters)
    packed = F.struct(*[v.alias(k) for k, v in parts.items()])
    arrays = ordered(done, packed, "_parts")
    missing = ordered(*_gone(chapters), "missing")
    keys = volumes(books, arrays, missing)
    none = F.array().cast("array<string>")
    field = lambda k: F.transform("_parts", lambda p: p[k])
    lists = [F.coalesce(field(k), none).alias(k) for k in parts]
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    fields = books.select("book_id", empty("title"), empty("author"), empty("description"), empty("source_url"), "language_code", X.language_of_export(F.col("language_code")).alias("l"), "cover", "cover_mime")
    rows = keys.join(fields, "book_id").join(arrays, ["book_id", "volume"], "left").join(missing, ["book_id", "volume"], "left")
    return rows.select("volume", *fields.columns, *lists, F.coalesce("missing", none).alias("missing"))


def notes(missing: Column, language: Column) -> Column:
    """The line that names what isn't available; null if nothing is missing."""
    line = F.concat(head("notes", language), F.lit(" — "), head("unavailable", language), F.lit(": "), F.array_join(missing, " • "))
    return F.when(F.size(missing) > 0, line)


def notes_line(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """``book_id``, ``line`` of every work: what isn't available of all its volumes."""
    gone, label = _gone(chapters)
    pairs = F.array_sort(F.collect_list(F.struct("idx", label.alias("v"))))
    missing = gone.groupBy("book_id").agg(F.transform(pairs, lambda p: p["v"]).alias("missing"))
    rows = books.select("book_id", X.language_of_export(F.col("language_code")).alias("l")).join(missing, "book_id", "left")
    return rows.select("book_id", notes(F.col("missing"), F.col("l")).alias("line"))


def _when(value: str, *lines: Column) -> Column:
    """An array of lines where a field isn't empty, else no lines."""
    return F.when(F.col(value) != "", F.array(*lines)).otherwise(F.array().cast("array<string>"))


def _name(title: str = "title") -> Column:
    return F.coalesce(F.col(title), F.lit(""))


def txt(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """``book_id``, ``volume``, ``content`` as plain text."""
    text = B.plain_text(F.col("blocks"), "\n\n")
    part = F.concat(F.lit("\n— "), F.col("idx").cast("string"), F.lit(". "), _name(), F.lit(" —\n\n"), F.when(F.coalesce(text, F.lit("")) == "", EMPTY).otherwise(text))
    rows = works(books, chapters, {"parts": part})
    colon = F.lit(": ")
    line = notes(F.col("missing"), F.col("l"))
    lines = F.concat(
        F.array("title"), _when("author", F.concat(head("author", F.col("l")), colon, "author")), F.array(F.concat(head("source", F.col("l")), colon, "source_url"), F.lit(RULE)),
        _when("description", head("description", F.col("l")), F.col("description"), F.lit("")),
        F.array(F.concat(head("chapters", F.col("l")), colon, F.size("parts").cast("string")), F.lit("")), F.col("parts"),
        F.when(line.isNotNull(), F.array(F.lit(""), F.lit(RULE), line)).otherwise(F.array().cast("array<string>")),
    )
    return rows.select("book_id", "volume", F.array_join(lines, "\n").alias("content"))


def md(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """``book_id``, ``volume``, ``content`` as Markdown."""
    text = lambda c: F.coalesce(c, F.lit(""))
    block = lambda b: F.when(b["type"] == "p", text(b["text"])).when(b["type"] == "h", F.concat(F.lit("### "), text(b["text"]))).otherwise(
        F.concat(F.lit("!["), F.coalesce(b["alt"], F.lit("صورة الفصل")), F.lit("]("), text(b["src"]), F.lit(")"))
    )
    label = F.concat(F.col("idx").cast("string"), F.lit(". "), _name())
    lines = F.transform(F.coalesce("blocks", F.array().cast(f"array<{B.BLOCK}>")), lambda b: F.concat(block(b), F.lit("\n")))
    part = F.array_join(F.concat(F.array(F.lit(""), F.concat(F.lit("## "), label), F.lit("")), lines), "\n")
    rows = works(books, chapters, {"parts": part, "toc": label})
    bold = lambda key, c: F.concat(F.lit("**"), head(key, F.col("l")), F.lit(":** "), F.col(c))
    line = notes(F.col("missing"), F.col("l"))
    none = F.array().cast("array<string>")
    out = F.concat(
        F.array(F.concat(F.lit("# "), "title"), F.lit("")), _when("author", bold("author", "author"), F.lit("")), F.array(bold("source", "source_url"), F.lit("")),
        F.when(F.coalesce(F.length("cover"), F.lit(0)) > 0, F.array(F.lit(""), F.lit("![الغلاف](./cover.jpg)"), F.lit(""))).otherwise(none),
        _when("description", F.concat(F.lit("## "), head("description", F.col("l"))), F.lit(""), F.col("description"), F.lit("")),
        F.array(F.concat(F.lit("## "), head("toc", F.col("l"))), F.lit("")), F.col("toc"), F.array(F.lit("")), F.col("parts"),
        F.when(line.isNotNull(), F.array(F.lit(""), F.lit("---"), F.lit(""), F.concat(F.lit("_"), line, F.lit("_")))).otherwise(none),
    )
    return rows.select("book_id", "volume", F.array_join(out, "\n").alias("content"))


def html(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """``book_id``, ``volume``, ``content`` as one HTML page with the cover inside."""
    esc = lambda c: X.escape_html(F.coalesce(c, F.lit("")))
    figure = lambda b: F.concat(F.lit('<figure><img src="'), esc(b["src"]), F.lit('" alt="'), esc(b["alt"]), F.lit('" loading="lazy" /></figure>'))
    block = lambda b: F.when(b["type"] == "img", figure(b)).when(F.coalesce(b["text"], F.lit("")) == "", "").when(
        b["type"] == "h", F.concat(F.lit("<h3>"), esc(b["text"]), F.lit("</h3>"))
    ).otherwise(F.concat(F.lit("<p>"), esc(b["text"]), F.lit("</p>")))
    number = F.col("idx").cast("string")
    body = F.array_join(F.transform("blocks", block), "\n")
    part = F.concat(F.lit('<section id="ch-'), number, F.lit('">\n<h2>'), number, F.lit(". "), esc(_name()), F.lit("</h2>\n"), F.coalesce(body, F.lit("")), F.lit("\n</section>"))
    toc = F.concat(F.lit('<li><a href="#ch-'), number, F.lit('">'), esc(_name()), F.lit("</a></li>"))
    rows = works(books, chapters, {"parts": part, "toc": toc})
    picture = F.concat(F.lit('<img alt="" src="data:'), F.coalesce("cover_mime", F.lit("image/jpeg")), F.lit(";base64,"), F.replace(F.base64("cover"), F.lit("\r\n"), F.lit("")), F.lit('" />\n'))
    author = F.when(F.col("author") != "", F.concat(head("author", F.col("l")), F.lit(": "), esc("author"), F.lit(" • "))).otherwise("")
    about = F.when(F.col("description") != "", F.concat(F.lit("<p>"), esc("description"), F.lit("</p>\n"))).otherwise("")
    line = notes(F.col("missing"), F.col("l"))
    content = F.concat(
        F.lit('<!doctype html>\n<html lang="'), "l", F.lit('" dir="'), X.direction(F.col("l")), F.lit('">\n<head>\n<meta charset="utf-8" />\n<title>'), esc("title"), F.lit("</title>\n</head>\n<body>\n<header>\n"),
        F.when(F.coalesce(F.length("cover"), F.lit(0)) > 0, picture).otherwise(""), F.lit("<h1>"), esc("title"), F.lit("</h1>\n<div>"), author, esc("source_url"), F.lit("</div>\n</header>\n"), about,
        F.lit("<nav><h2>"), head("toc", F.col("l")), F.lit("</h2><ol>\n"), F.array_join("toc", "\n"), F.lit("\n</ol></nav>\n"), F.array_join("parts", "\n"),
        F.when(line.isNotNull(), F.concat(F.lit("\n<div><p>"), esc(line), F.lit("</p></div>"))).otherwise(""), F.lit("\n</body>\n</html>"),
    )
    return rows.select("book_id", "volume", content.alias("content"))


def json(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """``book_id``, ``volume``, ``content`` as a JSON object with blocks and texts."""
    part = F.to_json(F.struct(F.col("idx").alias("index"), "title", F.col("source_url").alias("url"), "blocks", B.plain_text(F.col("blocks"), "\n\n").alias("text")))
    rows = works(books, chapters, {"parts": part})
    facts = F.to_json(F.struct("title", "author", "description", F.coalesce("language_code", F.lit("")).alias("language"), F.col("source_url").alias("source"), F.size("parts").alias("chapterCount"), F.col("missing").alias("unavailableChapters")))
    content = F.concat(F.left(facts, F.length(facts) - 1), F.lit(',"chapters":['), F.array_join("parts", ","), F.lit("]}"))
    return rows.select("book_id", "volume", content.alias("content"))


def pictures(chapters: DataFrame, images: DataFrame) -> DataFrame:
    """``book_id``, ``volume``, ``images``: the pictures a work uses, in the order of
    first use, as far as its budget goes. Pictures that aren't stored are left out."""
    done = store.exportable(chapters)
    refs = done.select("book_id", volume(F.col("idx")).alias("volume"), "idx", F.posexplode("blocks").alias("pos", "b")).where("b.type = 'img' AND b.src IS NOT NULL")
    first = refs.groupBy("book_id", "volume", F.col("b.src").alias("src")).agg(F.min(F.struct("idx", "pos")).alias("at"))
    from pyspark.sql import Window

    w = Window.partitionBy("book_id", "volume").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    sized = first.join(images.select("src", F.length("bytes").alias("size")).where("size > 0"), "src")
    kept = sized.withColumn("total", F.sum("size").over(w)).withColumn("n", F.count("*").over(w)).where((F.col("total") <= MOST_IMAGE_BYTES) & (F.col("n") <= MOST_IMAGES))
    loaded = kept.join(images.select("src", "bytes", "mime", "width", "height"), "src")
    entry = F.struct("n", "src", "bytes", "mime", "width", "height")
    return loaded.groupBy("book_id", "volume").agg(F.array_sort(F.collect_list(entry)).alias("images"))


def fb2(books: DataFrame, chapters: DataFrame, images: DataFrame) -> DataFrame:
    """``book_id``, ``volume``, ``content`` as FictionBook, pictures inside once each."""
    esc = lambda c: X.escape_xml(F.coalesce(c, F.lit("")))
    marked = lambda b: F.concat(F.lit("\x01"), F.coalesce(b["src"], F.lit("")), F.lit("\x02"))
    block = lambda b: F.when(b["type"] == "img", marked(b)).when(F.coalesce(b["text"], F.lit("")) == "", "").when(
        b["type"] == "h", F.concat(F.lit("<subtitle>"), esc(b["text"]), F.lit("</subtitle>"))
    ).otherwise(F.concat(F.lit("<p>"), esc(b["text"]), F.lit("</p>")))
    label = F.concat(F.col("idx").cast("string"), F.lit(". "), _name())
    part = F.concat(F.lit("<section>\n<title><p>"), esc(label), F.lit("</p></title>\n"), F.coalesce(F.array_join(F.transform("blocks", block), "\n"), F.lit("")), F.lit("\n</section>"))
    rows = works(books, chapters, {"parts": part}).join(pictures(chapters, images), ["book_id", "volume"], "left")
    kind = lambda mime: F.regexp_replace(F.coalesce(F.try_element_at(F.split(mime, "/"), F.lit(2)), F.lit("jpg")), "(?i)[^a-z0-9]", "")
    known = F.coalesce("images", F.array().cast("array<struct<n:bigint,src:string,bytes:binary,mime:string,width:int,height:int>>"))
    ids = F.transform(known, lambda p: F.concat(F.lit("img"), p["n"].cast("string"), F.lit("."), kind(p["mime"])))
    binaries = F.transform(known, lambda p: F.concat(F.lit('<binary id="img'), p["n"].cast("string"), F.lit("."), kind(p["mime"]), F.lit('" content-type="'), esc(p["mime"]), F.lit('">'), F.replace(F.base64(p["bytes"]), F.lit("\r\n"), F.lit("")), F.lit("</binary>")))
    # marks become references to the pictures of the work; marks of unknown pictures go
    body = F.reduce(
        F.arrays_zip(F.transform(known, lambda p: p["src"]).alias("src"), ids.alias("id")), F.array_join("parts", "\n"),
        lambda acc, x: F.replace(acc, F.concat(F.lit("\x01"), x["src"], F.lit("\x02")), F.concat(F.lit('<image l:href="#'), x["id"], F.lit('"/>'))),
    )
    has_cover = F.coalesce(F.length("cover"), F.lit(0)) > 0
    cover_id = F.concat(F.lit("cover."), kind(F.col("cover_mime")))
    cover_page = F.when(has_cover, F.concat(F.lit('<coverpage><image l:href="#'), cover_id, F.lit('"/></coverpage>'))).otherwise("")
    cover_data = F.when(has_cover, F.concat(F.lit('<binary id="'), cover_id, F.lit('" content-type="'), esc("cover_mime"), F.lit('">'), F.replace(F.base64("cover"), F.lit("\r\n"), F.lit("")), F.lit("</binary>\n"))).otherwise("")
    content = F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?>\n<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0" xmlns:l="http://www.w3.org/1999/xlink">\n<description><title-info><genre>novel</genre><author><nickname>'),
        F.when(F.col("author") == "", "—").otherwise(esc("author")), F.lit("</nickname></author><book-title>"), esc("title"), F.lit("</book-title><annotation><p>"), esc("description"), F.lit("</p></annotation>"), cover_page,
        F.lit("<lang>"), F.when(F.coalesce("language_code", F.lit("")) == "", "ar").otherwise(esc("language_code")), F.lit("</lang></title-info></description>\n<body>\n"), F.regexp_replace(body, "\x01[^\x02]*\x02", ""), F.lit("\n</body>\n"),
        cover_data, F.array_join(binaries, "\n"), F.lit("\n</FictionBook>"),
    )
    return rows.select("book_id", "volume", content.alias("content"))


_OUT = "book_id bigint, volume int, content binary"


def _pack(kind: str, schema: pa.Schema):
    def build(work: dict) -> bytes:
        from foliomill.functions import archive, pdf

        return {"epub": archive.epub, "docx": archive.docx, "pdf": pdf.pdf}[kind](work)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one work in memory at a time
                work = batch.slice(k, 1).to_pylist()[0]
                data = build(work | {"images": work["images"] or [], "unavailable": work["unavailable"] or []})
                yield pa.RecordBatch.from_pylist([{"book_id": work["book_id"], "volume": work["volume"], "content": data}], schema=schema)

    return run


def binary(kind: str, books: DataFrame, chapters: DataFrame, images: DataFrame) -> DataFrame:
    """``book_id``, ``volume``, ``content`` as EPUB, DOCX or PDF."""
    part = F.struct("idx", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.col("blocks"), F.array().cast(f"array<{B.BLOCK}>")).alias("blocks"))
    pairs = ordered(store.exportable(chapters), part, "chapters")
    gone = ordered(store.unavailable(chapters), F.struct("idx", "title"), "unavailable")
    keys = volumes(books, pairs, gone)
    fields = books.select("book_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "author", "description", "source_url", "language_code")], "cover", "cover_mime")
    by = ["book_id", "volume"]
    rows = keys.join(fields, "book_id").join(pairs, by, "left").join(gone, by, "left")
    pics = pictures(chapters, images)
    none = F.array().cast(f"array<struct<idx:int,title:string,blocks:array<{B.BLOCK}>>>")
    rows = rows.join(pics, by, "left").withColumn("chapters", F.coalesce("chapters", none))
    return rows.mapInArrow(_pack(kind, to_arrow_schema(T._parse_datatype_string(_OUT))), _OUT)


def export(kind: str, books: DataFrame, chapters: DataFrame, images: DataFrame) -> DataFrame:
    """Files of all works in a format: ``book_id``, ``volume``, ``filename``, ``mime``, ``content``."""
    if kind not in X.FORMAT_TYPES:
        raise ValueError(f"unknown format: {kind}")
    if kind in BINARY_FORMATS:
        files = binary(kind, books, chapters, images)
    elif kind == "fb2":
        files = fb2(books, chapters, images)
    else:
        files = {"txt": txt, "md": md, "html": html, "json": json}[kind](books, chapters)
    name = X.safe_filename(F.col("title"), F.col("book_id"), kind)
    name = F.when(F.col("volume") == 0, name).otherwise(F.concat((F.col("volume") + 1).cast("string"), F.lit(" "), name))
    return files.join(books.select("book_id", "title"), "book_id").select("book_id", "volume", name.alias("filename"), F.lit(X.FORMAT_TYPES[kind]).alias("mime"), "content")
