"""Book files, pictures, shaping, sources and streams."""

import io
import json
import random
import struct
import zipfile
import zlib
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from conftest import block
from foliomill.functions import images, pdf
from foliomill.functions.shaping import shape, visual
from foliomill.operators import export
from foliomill.sources import documents
from foliomill.streaming import progress

PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 30, 40) + b"\0" * 9


@pytest.fixture
def tables(spark, make_books, make_chapters):
    books = make_books([dict(title='A & "B"', description="D <x>", cover=PNG, cover_mime="image/png"), dict(book_id=2, title=None, author=None, language_code=None, description=None)])
    bs = [block("h", "Head"), block("p", "Text & more"), block("img", None, "https://a/1.png", "alt"), block("img", None, "https://a/gone.png"), block("img", None, "https://a/1.png")]
    chapters = make_chapters([dict(title="One", plain_text="x", blocks=bs), dict(chapter_id=2, idx=2, title="Two", status="failed"), dict(chapter_id=3, idx=3, title="نص", plain_text="y", blocks=[block("p", "سلام (عالم)")])])
    pics = spark.createDataFrame([("https://a/1.png", PNG, "image/png", 30, 40)], "src string, bytes binary, mime string, width int, height int")
    return books, chapters, pics


@pytest.mark.parametrize("kind", ["txt", "md", "html", "json", "fb2", "epub", "docx", "pdf"])
def test_every_format(tables, kind):
    rows = {r["book_id"]: r for r in export.export(kind, *tables).collect()}
    assert set(rows) == {1, 2} and rows[1]["filename"].endswith(f"- 1.{kind}") and rows[2]["filename"] == f"book-2 - 2.{kind}"
    data = rows[1]["content"]
    if kind == "json":
        got = json.loads(data)
        assert got["chapterCount"] == 2 and got["unavailableChapters"] == ["2. Two"] and got["chapters"][0]["text"] == "Head\n\nText & more"
    elif kind == "fb2":
        root = ElementTree.fromstring(data)
        ns = {"f": "http://www.gribuser.ru/xml/fictionbook/2.0"}
        assert len(root.findall(".//f:section", ns)) == 2 and len(root.findall("f:binary", ns)) == 2
        assert len(root.findall(".//f:section/f:image", ns)) == 2
    elif kind in ("epub", "docx"):
        z = zipfile.ZipFile(io.BytesIO(data))
        assert z.testzip() is None
        for n in z.namelist():
            if n.endswith((".xhtml", ".xml", ".opf", ".ncx", ".rels")):
                ElementTree.fromstring(z.read(n))
        assert (z.infolist()[0].filename, z.infolist()[0].compress_type) == ("mimetype", 0) if kind == "epub" else "word/document.xml" in z.namelist()
        assert sum("images/" in n or "media/" in n for n in z.namelist()) == (2 if kind == "epub" else 3)
    elif kind == "pdf":
        assert data.startswith(b"%PDF") and data.rstrip().endswith(b"%%EOF") and data.count(b"/Type /Page ") == 4
    else:
        assert "Text &" in data and "2. Two" in data
    assert rows[1]["content"] == {r["book_id"]: r for r in export.export(kind, *tables).collect()}[1]["content"]


def test_missing_parts_of_late_volumes(spark, make_books, make_chapters, monkeypatch):
    books = make_books([{}, dict(book_id=2)])
    far = [dict(chapter_id=k, idx=k, title=f"T{k}", status=s) for k, s in ((2001, "failed"), (4500, "pending"), (9000, None), (10000, "empty"))]
    chapters = make_chapters([dict(plain_text="x"), dict(chapter_id=3, idx=2002, plain_text="y"), *far])
    names = ["2001. T2001", "4500. T4500", "9000. T9000", "10000. T10000"]
    from foliomill.plans import exports

    monkeypatch.setattr(exports, "table", lambda _s, _d, name: {"books": books, "chapters": chapters}[name])
    got = {r["book_id"]: r["line"] for r in exports.notes_line(spark, "").collect()}
    assert got == {1: "Import notes — Chapters not retrieved: " + " • ".join(names), 2: None}
    for kind in ("json", "docx"):
        rows = {r["volume"]: r for r in export.export(kind, books, chapters, spark.createDataFrame([], "src string, bytes binary, mime string, width int, height int")).where("book_id = 1").collect()}
        assert set(rows) == {0, 1, 2, 4}
        if kind == "json":
            assert [json.loads(rows[v]["content"])["unavailableChapters"] for v in (0, 1, 2, 4)] == [[], names[:1], names[1:2], names[2:]]
        else:
            files = zipfile.ZipFile(io.BytesIO(rows[4]["content"]))
            assert "10000. T10000" in files.read("word/document.xml").decode()


def test_unknown_format(tables):
    with pytest.raises(ValueError):
        export.export("exe", *tables)


def test_dimensions():
    assert images.dimensions(PNG, "image/png") == (30, 40)
    assert images.dimensions(b"GIF89a" + struct.pack("<HH", 7, 8) + b"\0\0", "image/gif") == (7, 8)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 9, 11) + b"\0" * 9
    assert images.dimensions(jpeg, "image/jpeg") == (11, 9)
    webp = b"RIFF\0\0\0\0WEBPVP8X\0\0\0\0\0\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little") + b"\0\0"
    assert images.dimensions(webp, "image/webp") == (100, 50)
    assert images.dimensions(None, None) == (0, 0) and images.dimensions(b"\xff\xd8", "image/jpeg") == (0, 0)


def png(width, height, colour, rows, palette=b""):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def filtered(pixels, kind, step):
    """Rows of bytes with one line filter, by its definition."""
    out, above = bytearray(), bytes(len(pixels[0]))
    for row in pixels:
        out.append(kind)
        for x, v in enumerate(row):
            a, b, c = (row[x - step] if x >= step else 0), above[x], (above[x - step] if x >= step else 0)
            near = min(((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c)))[2]
            out.append((v - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        above = row
    return bytes(out)


def test_png_filters_and_alpha():
    rng = random.Random(1)
    pixels = [bytes(rng.randrange(256) for _ in range(5 * 4)) for _ in range(4)]
    for kind in range(5):
        facts, (colour, alpha) = images.png_pixels(png(5, 4, 6, filtered(pixels, kind, 4)))
        flat = b"".join(pixels)
        assert zlib.decompress(alpha) == flat[3::4] and zlib.decompress(colour) == b"".join(flat[k : k + 3] for k in range(0, len(flat), 4)) and facts["samples"] == 3
    assert images.png_pixels(PNG) is None and images.png_pixels(b"") is None and images.png_pixels(png(5, 4, 6, b"short")) is None


def test_pdf_draws_pictures():
    rgb, alpha = png(2, 2, 2, b"\0" + b"\1\2\3" * 2 + b"\0" + b"\4\5\6" * 2), png(2, 1, 6, b"\0" + b"\1\2\3\4" * 2)
    jpeg = b"\xff\xd8\xff\xc0\x00\x11\x08" + struct.pack(">HHB", 9, 11, 3) + b"\0" * 9 + b"\xff\xd9"
    w = pdf.Writer(None)
    assert [w.picture(x, m) for x, m in ((rgb, "image/png"), (alpha, "image/png"), (jpeg, "image/jpeg"), (rgb, "image/png"), (b"GIF89a", "image/gif"), (None, None))] == [True] * 4 + [False] * 2
    data = w.finish()
    assert data.count(b"/Subtype /Image") == 4 and data.count(b"/SMask") == 1 and b"/DCTDecode" in data and b"/Predictor 15" in data and jpeg in data
    work = dict(language_code="en", title="T", author="", source_url="", description="", cover=jpeg, cover_mime="image/jpeg", unavailable=[], images=[dict(src="a", bytes=rgb, mime="image/png")], chapters=[dict(idx=1, title="x", blocks=[block("img", None, "a"), block("img", None, "b", "lost")])])
    assert pdf.pdf(work).count(b"/Subtype /Image") == 2


def test_shaping():
    assert shape("سلام") == "ﺳﻼﻡ"
    assert visual("سلام (a)") == ")a( ﻡﻼﺳ" or visual("سلام (a)").endswith("ﻡﻼﺳ")
    assert visual("abc") == "abc" and shape("") == ""


def test_pdf_without_font():
    w = pdf.Writer(None)
    w.paragraph("word " * 400, 11.5, False)
    w.paragraph("x" * 400, 11.5, False)
    assert len(w.pages) > 1 and all(w.measure(x, 11.5) <= pdf.WIDE - 2 * pdf.MARGIN for x in w.wrap("y" * 300, 11.5, False))
    assert w.finish().startswith(b"%PDF")


def test_charsets():
    assert documents.decode_page("é".encode()) == "é"
    assert documents.decode_page("سلام".encode("cp1256")) == "سلام"
    assert documents.decode_page("é".encode("latin-1"), "text/html; charset=iso-8859-1") == "é"
    assert documents.decode_page("<meta charset='windows-1252'>é".encode("cp1252")).endswith("é")
    assert documents.decode_page(None) is None and documents.decode_page(b"") == ""


def test_loose_columns(spark):
    df = spark.createDataFrame([('{"a":1}',), ("array ( 'a' => 2 )",), ("junk",), (None,)], "t string")
    assert [r[0] for r in df.select(documents.loose(F.col("t"))).collect()] == ['{"a":1}', '{"a": 2}', None, None]


def test_story_parts(spark):
    html = 'x={"title":"S","user":{"name":"U"},"parts":[{"id":1,"title":"P1","url":"/1"},{"id":2,"title":"P2","url":"/2"}]}'
    df = spark.createDataFrame([(1, html), (2, "none"), (3, None)], "page_id bigint, html string").select("page_id", documents.embedded(F.col("html")).alias("j"))
    assert [(r["page_id"], r["idx"], r["title"], r["author"]) for r in documents.story_parts(df, "j").orderBy("idx").collect()] == [(1, 1, "P1", "U"), (1, 2, "P2", "U")]


def test_json_and_binary_sources(spark, tmp_path):
    for name, text in (("a", '{"id": 1,\n "title": "x"}'), ("b", "{broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "meta.json").write_text(text)
    got = documents.read_json_documents(spark, f"{tmp_path}/*/meta.json", "id int, title string").where("id IS NOT NULL").collect()
    assert [(r["id"], r["title"]) for r in got] == [(1, "x")]
    (tmp_path / "p.png").write_bytes(PNG)
    assert documents.read_pictures(spark, f"{tmp_path}/*.png").count() == 1
    assert documents.read_pictures(spark, f"{tmp_path}/*.png", 10).count() == 0


def test_swapped_write(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        documents.write_swapped(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    documents.write_swapped(spark.read.parquet(path).where("id > 1"), path)
    assert spark.read.parquet(path).count() == 3


def test_page_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "https://a.example/1", "<article>" + "word " * 60 + "</article>"), (2, "https://a.example/2", None)], progress.PAGES).write.parquet(src)
    for _ in range(2):  # the second run finds nothing new
        progress.upsert_parts(progress.page_stream(spark, src), out, str(tmp_path / "cp")).awaitTermination(120)
    spark.createDataFrame([(3, "https://a.example/1", "<article>newer " + "word " * 60 + "</article>")], progress.PAGES).write.mode("append").parquet(src)
    progress.upsert_parts(progress.page_stream(spark, src), out, str(tmp_path / "cp")).awaitTermination(120)
    want = sorted(map(repr, progress.last_parts(spark.read.parquet(out)).collect()))
    progress.merge_parts(spark, out)
    assert sorted(map(repr, progress.last_parts(spark.read.parquet(out)).collect())) == want and spark.read.parquet(out).count() == 2
    rows = {r["url"]: r for r in progress.last_parts(spark.read.parquet(out)).collect()}
    assert rows["https://a.example/1"]["plain_text"].startswith("newer") and rows["https://a.example/2"]["status"] == "empty"
