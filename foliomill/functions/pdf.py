"""A small PDF writer: A5 pages, wrapped text, right-to-left lines, page numbers.

With a TrueType font the font is embedded and its metrics measure the text; without
one, text is set in the reader's Courier and letters it lacks become question marks.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from functools import cache

from foliomill.functions import images
from foliomill.functions.shaping import visual
from foliomill.functions.text import HEADERS

#: Page size, margin, sizes of body and titles, line height in points.
WIDE, HIGH, MARGIN, BODY, TITLE, LEAD = 419.53, 595.28, 42, 11.5, 16, 18
FONT_PATHS = ("/usr/share/fonts/truetype/dejavu/DejaVuSans.ttf", "/usr/share/fonts/dejavu/DejaVuSans.ttf")


class TrueType:
    """Tables of a font file that a writer needs: widths and the character map."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        count = struct.unpack(">H", data[4:6])[0]
        self.tables = {data[12 + 16 * k : 16 + 16 * k].decode("latin-1"): struct.unpack(">II", data[20 + 16 * k : 28 + 16 * k]) for k in range(count)}
        self.units = struct.unpack(">H", self._at("head", 18, 2))[0]
        self.box = struct.unpack(">4h", self._at("head", 36, 8))
        self.ascent, self.descent = struct.unpack(">2h", self._at("hhea", 4, 4))
        metrics = struct.unpack(">H", self._at("hhea", 34, 2))[0]
        self.advances = [w for w, _ in struct.iter_unpack(">Hh", self._at("hmtx", 0, 4 * metrics))]
        self.glyphs = self._character_map()

    def _at(self, table: str, offset: int, size: int) -> bytes:
        start = self.tables[table][0] + offset
        return self.data[start : start + size]

    def _character_map(self) -> dict[int, int]:
        base = self.tables["cmap"][0]
        out: dict[int, int] = {}
        for k in range(struct.unpack(">H", self.data[base + 2 : base + 4])[0]):
            at = base + struct.unpack(">I", self.data[base + 8 + 8 * k : base + 12 + 8 * k])[0]
            kind = struct.unpack(">H", self.data[at : at + 2])[0]
            if kind == 4:
                n = struct.unpack(">H", self.data[at + 6 : at + 8])[0] // 2
                read = lambda off, fmt: struct.unpack(f">{n}{fmt}", self.data[at + off : at + off + 2 * n])
                for j, (end, start, delta, shift) in enumerate(zip(read(14, "H"), read(16 + 2 * n, "H"), read(16 + 4 * n, "h"), read(16 + 6 * n, "H"))):
                    for c in range(start, min(end, 0xFFFE) + 1):
                        g = c
                        if shift:
                            where = at + 16 + 6 * n + 2 * j + shift + 2 * (c - start)
                            g = struct.unpack(">H", self.data[where : where + 2])[0]
                        if g or not shift:
                            out.setdefault(c, (g + delta) & 0xFFFF)
            elif kind == 12:
                for j in range(struct.unpack(">I", self.data[at + 12 : at + 16])[0]):
                    start, end, g = struct.unpack(">3I", self.data[at + 16 + 12 * j : at + 28 + 12 * j])
                    out.update((c, g + c - start) for c in range(start, end + 1))
        return out

    def subset(self, glyphs: set[int]) -> bytes:
        """The font file with the outlines of these glyphs only; numbers stay."""
        start, size = self.tables["loca"]
        wide = struct.unpack(">h", self._at("head", 50, 2))[0]
        places = [x[0] * (1 if wide else 2) for x in struct.iter_unpack(">I" if wide else ">H", self.data[start : start + size])]
        base = self.tables["glyf"][0]
        outline = lambda g: self.data[base + places[g] : base + places[g + 1]]
        need, todo = {0}, list(glyphs)
        while todo:
            g = todo.pop()
            need.add(g)
            body = outline(g)
            if len(body) > 10 and body[:2] >= b"\x80":  # made of other glyphs
                at, flags = 10, 0x20
                while flags & 0x20:
                    flags, part = struct.unpack(">HH", body[at : at + 4])
                    at += 4 + (4 if flags & 1 else 2) + (2 if flags & 8 else 4 if flags & 0x40 else 8 if flags & 0x80 else 0)
                    if part not in need:
                        todo.append(part)
        out, loca = bytearray(), [0]
        for g in range(len(places) - 1):
            if g in need:
                out += outline(g) + b"\0" * (-len(outline(g)) % 4)
            loca.append(len(out))
        keep = {t: self.data[o : o + n] for t, (o, n) in self.tables.items() if t in ("head", "hhea", "maxp", "hmtx", "cvt ", "fpgm", "prep")}
        keep["head"] = keep["head"][:50] + b"\0\1" + keep["head"][52:]
        keep |= {"glyf": bytes(out), "loca": struct.pack(f">{len(loca)}I", *loca)}
        head, body = struct.pack(">IHHHH", 0x00010000, len(keep), 128, 3, 16 * len(keep) - 128), b""
        for t in sorted(keep):
            data = keep[t] + b"\0" * (-len(keep[t]) % 4)
            total = sum(x[0] for x in struct.iter_unpack(">I", data)) & 0xFFFFFFFF
            head += t.encode() + struct.pack(">III", total, 12 + 16 * len(keep) + len(body), len(keep[t]))
            body += data
        return head + body

    def width(self, glyph: int) -> float:
        return self.advances[min(glyph, len(self.advances) - 1)] * 1000 / self.units


@cache
def load_font(path: str | None = None) -> TrueType | None:
    """The font at ``path`` or the first installed one; None if there is none."""
    for p in (path,) if path else FONT_PATHS:
        if os.path.exists(p):
            with open(p, "rb") as f:
                return TrueType(f.read())
    return None


class Writer:
    """Pages of text lines and the objects of the file."""

    def __init__(self, font: TrueType | None) -> None:
        self.font = font
        self.used: dict[int, int] = {}
        self.widths: dict[tuple[str, float, bool], float] = {}
        self.pages: list[list[bytes]] = [[]]
        self.drawn: dict[bytes, int] = {}
        self.streams: dict[int, tuple[dict, bytes, bytes | None]] = {}
        self.y = HIGH - MARGIN

    def measure(self, text: str, size: float) -> float:
        if self.font is None:
            return 0.6 * size * len(text)
        return sum(self.font.width(self.font.glyphs.get(ord(c), 0)) for c in text) * size / 1000

    def _word(self, word: str, size: float, rtl: bool) -> float:
        """Width of a word; letters don't join across spaces, so words add up."""
        key = (word, size, rtl)
        if key not in self.widths:
            self.widths[key] = self.measure(visual(word, rtl), size)
        return self.widths[key]

    def wrap(self, text: str, size: float, rtl: bool, most: float = WIDE - 2 * MARGIN) -> list[str]:
        """Lines that fit, broken between words and within words that are too long."""
        lines, line, room = [], "", 0.0
        space = self.measure(" ", size)
        for word in text.split():
            wide = self._word(word, size, rtl)
            if line and room + space + wide <= most:
                line, room = f"{line} {word}", room + space + wide
                continue
            if line:
                lines.append(line)
            line, room = word, wide
            if wide > most:
                line = ""
                for c in word:
                    if line and self.measure(visual(line + c, rtl), size) > most:
                        lines.append(line)
                        line = ""
                    line += c
                room = self.measure(visual(line, rtl), size)
        return lines + [line] if line else lines

    def _show(self, text: str) -> bytes:
        if self.font is None:
            raw = text.encode("latin-1", "replace").replace(b"\\", rb"\\").replace(b"(", rb"\(").replace(b")", rb"\)")
            return b"(" + raw + b")"
        out = []
        for c in text:
            g = self.font.glyphs.get(ord(c), 0)
            self.used.setdefault(g, ord(c))
            out.append(f"{g:04x}")
        return f"<{''.join(out)}>".encode()

    def put(self, text: str, x: float, y: float, size: float) -> None:
        self.pages[-1].append(f"BT /F1 {size} Tf {x:.2f} {y:.2f} Td ".encode() + self._show(text) + b" Tj ET")

    def new_page(self) -> None:
        self.pages.append([])
        self.y = HIGH - MARGIN

    def paragraph(self, text: str | None, size: float, rtl: bool, gap: float = 6) -> None:
        for part in (text or "").split("\n"):
            for line in self.wrap(part, size, rtl):
                lead = LEAD * size / BODY
                if self.y - lead < MARGIN:
                    self.new_page()
                self.y -= lead
                shown = visual(line, rtl)
                self.put(shown, WIDE - MARGIN - self.measure(shown, size) if rtl else MARGIN, self.y, size)
        self.y -= gap

    def picture(self, data: bytes | None, mime: str | None, most_high: float = HIGH / 2) -> bool:
        """Draw a JPEG or PNG picture in the width of the text; False if it can't be."""
        found = _picture_stream(data or b"", mime)
        if not found:
            return False
        key = hashlib.sha1(data or b"").digest()
        number = self.drawn.setdefault(key, len(self.drawn) + 1)
        self.streams[number] = found
        wide, high = found[0]["Width"], found[0]["Height"]
        scale = min((WIDE - 2 * MARGIN) / wide, most_high / high)
        wide, high = wide * scale, high * scale
        if self.y - high < MARGIN:
            self.new_page()
        self.y -= high + LEAD / 2
        self.pages[-1].append(f"q {wide:.2f} 0 0 {high:.2f} {(WIDE - wide) / 2:.2f} {self.y:.2f} cm /Im{number} Do Q".encode())
        return True

    def _picture_objects(self, first: int) -> tuple[dict[int, int], list[bytes]]:
        """Picture number to object number, and the objects, which begin at ``first``."""
        places, out = {}, []
        for number in sorted(self.streams):
            facts, data, mask = self.streams[number]
            if mask is not None:
                soft = {"Width": facts["Width"], "Height": facts["Height"], "ColorSpace": "/DeviceGray", "BitsPerComponent": 8, "Filter": "/FlateDecode"}
                out.append(_stream(soft, mask))
                facts = facts | {"SMask": f"{first + len(out) - 1} 0 R"}
            out.append(_stream(facts, data))
            places[number] = first + len(out) - 1
        return places, out

    def _font_objects(self) -> list[bytes]:
        if self.font is None:
            return [b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"]
        f, file = self.font, self.font.subset(set(self.used))
        data = zlib.compress(file, 6)
        scale = lambda v: round(v * 1000 / f.units)
        widths = " ".join(f"{g} [{f.width(g):.0f}]" for g in sorted(self.used))
        chars = sorted(self.used.items())
        blocks = [chars[k : k + 100] for k in range(0, len(chars), 100)]
        names = "\n".join(f"{len(b)} beginbfchar\n" + "\n".join(f"<{g:04x}> <{chr(c).encode('utf-16-be').hex()}>" for g, c in b) + "\nendbfchar" for b in blocks)
        cmap = zlib.compress(f"/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /U def /CMapType 2 def 1 begincodespacerange <0000> <ffff> endcodespacerange\n{names}\nendcmap end end".encode())
        box = " ".join(str(scale(v)) for v in f.box)
        return [
            b"<< /Type /Font /Subtype /Type0 /BaseFont /Embedded /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 7 0 R >>",
            f"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Embedded /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /FontDescriptor 5 0 R /CIDToGIDMap /Identity /W [{widths}] >>".encode(),
            f"<< /Type /FontDescriptor /FontName /Embedded /Flags 4 /FontBBox [{box}] /ItalicAngle 0 /Ascent {scale(f.ascent)} /Descent {scale(f.descent)} /CapHeight {scale(f.ascent)} /StemV 80 /FontFile2 6 0 R >>".encode(),
            f"<< /Length {len(data)} /Length1 {len(file)} /Filter /FlateDecode >>\nstream\n".encode() + data + b"\nendstream",
            f"<< /Length {len(cmap)} /Filter /FlateDecode >>\nstream\n".encode() + cmap + b"\nendstream",
        ]

    def finish(self) -> bytes:
        for k, page in enumerate(self.pages[1:], 2):
            shown = str(k)
            page.append(f"BT /F1 9 Tf {(WIDE - self.measure(shown, 9)) / 2:.2f} {MARGIN / 2:.2f} Td ".encode() + self._show(shown) + b" Tj ET")
        fonts = self._font_objects()
        first = 3 + len(fonts)
        places, drawn = self._picture_objects(first)
        first += len(drawn)
        pictures = f" /XObject << {' '.join(f'/Im{n} {at} 0 R' for n, at in places.items())} >>" if places else ""
        kids = " ".join(f"{first + 2 * k} 0 R" for k in range(len(self.pages)))
        objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(self.pages)} >>".encode(), *fonts, *drawn]
        for k, page in enumerate(self.pages):
            data = zlib.compress(b"\n".join(page), 6)
            objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {WIDE} {HIGH}] /Resources << /Font << /F1 3 0 R >>{pictures} >> /Contents {first + 2 * k + 1} 0 R >>".encode())
            objects.append(f"<< /Length {len(data)} /Filter /FlateDecode >>\nstream\n".encode() + data + b"\nendstream")
        out, places = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"), []
        for k, body in enumerate(objects, 1):
            places.append(len(out))
            out += f"{k} 0 obj\n".encode() + body + b"\nendobj\n"
        xref = len(out)
        out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
        out += f"trailer << /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{xref}\n%%EOF\n".encode()
        return bytes(out)


def _stream(facts: dict, data: bytes) -> bytes:
    said = " ".join(f"/{k} {v}" for k, v in ({"Type": "/XObject", "Subtype": "/Image"} | facts | {"Length": len(data)}).items())
    return f"<< {said} >>\nstream\n".encode() + data + b"\nendstream"


def _picture_stream(data: bytes, mime: str | None) -> tuple[dict, bytes, bytes | None] | None:
    """(dictionary, data, alpha) of a picture; JPEG data is taken as it is, PNG rows too
    unless they hold alpha. None for other formats and broken files."""
    spaces = {1: "/DeviceGray", 3: "/DeviceRGB", 4: "/DeviceCMYK"}
    if data.startswith(b"\xff\xd8"):
        wide, high, parts = images.jpeg_frame(data)
        if not wide or not high or parts not in spaces:
            return None
        return {"Width": wide, "Height": high, "ColorSpace": spaces[parts], "BitsPerComponent": 8, "Filter": "/DCTDecode"}, data, None
    found = images.png_pixels(data)
    if not found:
        return None
    facts, rows = found
    n, bits, palette = facts["samples"], facts["bits"], facts["palette"]
    space = f"[/Indexed /DeviceRGB {len(palette) // 3 - 1} <{palette.hex()}>]" if palette and n == 1 else spaces[n]
    out = {"Width": facts["width"], "Height": facts["height"], "ColorSpace": space, "BitsPerComponent": bits, "Filter": "/FlateDecode"}
    if len(rows) == 1:
        out["DecodeParms"] = f"<< /Predictor 15 /Colors {n} /BitsPerComponent {bits} /Columns {facts['width']} >>"
    return out, rows[0], rows[1] if len(rows) > 1 else None


def pdf(work: dict, font_path: str | None = None) -> bytes:
    """A work as PDF: cover, title page, then each part on a new page with its pictures,
    then what is missing. Pictures that can't be drawn are named in the text."""
    lang = (work["language_code"] or "")[:2].lower() or "ar"
    rtl = lang == "ar"
    w = Writer(load_font(font_path))
    stored = {p["src"]: p for p in work["images"] or []}
    if not w.picture(work["cover"], work["cover_mime"]):
        w.y -= 80
    w.paragraph(work["title"], TITLE + 4, rtl, 12)
    for x in (work["author"], work["source_url"], work["description"]):
        w.paragraph(x, BODY, rtl)
    for c in work["chapters"]:
        w.new_page()
        w.paragraph(f"{c['idx']}. {c['title'] or ''}", TITLE, rtl, 12)
        for b in c["blocks"]:
            if b["type"] == "img":
                p = stored.get(b["src"])
                if not p or not w.picture(p["bytes"], p["mime"]):
                    w.paragraph(f"[{b['alt'] or b['src'] or ''}]", BODY - 2, rtl)
            else:
                w.paragraph(b["text"], BODY + (1.5 if b["type"] == "h" else 0), rtl)
    if work["unavailable"]:
        w.new_page()
        w.paragraph(HEADERS.get(lang, HEADERS["ar"])["unavailable"], TITLE, rtl, 12)
        for u in work["unavailable"]:
            w.paragraph(f"{u['idx']}. {u['title'] or ''}", BODY, rtl)
    return w.finish()
