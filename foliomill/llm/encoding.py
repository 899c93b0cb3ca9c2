"""Problem 2: text decoded with the wrong character encoding.

Characters are mapped back to the bytes of a legacy encoding, an automaton over
those bytes finds the maximal well-formed UTF-8 multibyte spans, and only these
spans are decoded again; the rest of the text is left as it is. A second step
treats text of one legacy encoding that was read as another, where the bytes have
no structure and the words decide.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import map_batches

REPLACEMENT = "�"
#: Encodings as which UTF-8 is commonly misread, the most common first.
MISREAD_AS = ("cp1252", "mac_roman", "cp850", "cp437", "cp1256")
#: Encoded text is sometimes misread again; each round undoes one misreading.
ROUNDS = 4


@cache
def to_byte(codec: str) -> dict[int, int]:
    """Code point to byte of the upper half of a single-byte encoding.

    Bytes without a character stand for the control character of that number, as
    browsers read them."""
    out = {}
    for b in range(0x80, 0x100):
        c = bytes([b]).decode(codec, "replace")
        out[ord(c) if c != REPLACEMENT else b] = b
    return {b: b for b in range(0x80, 0xA0)} | out if codec == "cp1252" else out


def _class(table: dict[int, int], low: int, high: int) -> str:
    return "[" + "".join(re.escape(chr(c)) for c, b in sorted(table.items()) if low <= b <= high) + "]"


@cache
def automaton(codec: str) -> re.Pattern:
    """Accepts maximal runs of well-formed UTF-8 sequences of two to four bytes,
    written in the characters that ``codec`` shows for the bytes. A replacement
    character may stand for one lost continuation byte."""
    t = to_byte(codec)
    c = lambda low, high: _class(t, low, high)
    more = c(0x80, 0xBF)[:-1] + REPLACEMENT + "]"
    one = "|".join(
        (
            c(0xC2, 0xDF) + more,
            c(0xE0, 0xE0) + c(0xA0, 0xBF) + more,
            c(0xE1, 0xEC) + more + more,
            c(0xEE, 0xEF) + more + more,
            c(0xED, 0xED) + c(0x80, 0x9F) + more,
            c(0xF0, 0xF0) + c(0x90, 0xBF) + more + more,
            c(0xF1, 0xF3) + more + more + more,
            c(0xF4, 0xF4) + c(0x80, 0x8F) + more + more,
        )
    )
    return re.compile(f"(?:{one})+")


#: What a span may decode to: the letters and punctuation of scripts in wide use.
#: Rare blocks are left out because accidental byte pairs tend to land there.
_LIKELY = re.compile(
    "[\u0080-\u017f\u0192\u0218-\u021b\u02c6-\u02dc\u0300-\u0308\u0386-\u03ce\u0400-\u045f\u05d0-\u05ea\u060c-\u06d3"
    "\u06f0-\u06f9\u0900-\u097f\u0e00-\u0e5b\u1e00-\u1eff\u2010-\u206f\u20a0-\u20bf\u2100-\u214f\u2190-\u21ff\u2200-\u22ff"
    "\u2500-\u27bf\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3\ufb00-\ufb06\ufe8d-\ufefc\uff01-\uff5e\ufeff\ufffd\U0001f300-\U0001faff]+"
)
_LATIN = re.compile(r"[A-Za-z\u00c0-\u024f]")


def _decoded(span: str, codec: str) -> str:
    t = to_byte(codec)
    raw = bytes(0 if ch == REPLACEMENT else t[ord(ch)] for ch in span)
    plain = raw.decode("utf-8", "replace")
    return re.sub(REPLACEMENT + "*\x00", REPLACEMENT, plain) if REPLACEMENT in span else plain


def _plausible(span: str, plain: str, codec: str, text: str, start: int, end: int) -> bool:
    """Whether a span was really misread, not written so by the author."""
    letters = plain.replace(REPLACEMENT, "")
    if not letters:
        return len(span) > 2
    if not _LIKELY.fullmatch(plain):
        return False
    if len(letters) > 3 and len(set(letters)) == 1:
        return False  # ornament of one repeated pair
    if codec == "cp1256" and len(plain) < 2:
        around = text[start - 1 : start] + text[end : end + 1]
        if any("\u0600" <= ch <= "\u06ff" for ch in around):
            return False
        return bool(_LATIN.search(around)) or span[0] == "\u00e2"
    return True


_LEAD_CONT = {c: re.compile(_class(to_byte(c), 0xC2, 0xF4) + _class(to_byte(c), 0x80, 0xBF)[:-1] + REPLACEMENT + "]") for c in MISREAD_AS}

_lead, _cont = _class(to_byte("cp1256"), 0xC2, 0xF4), _class(to_byte("cp1256"), 0x80, 0xBF)[:-1] + REPLACEMENT + "]"
#: Ordinary Arabic has single well-formed pairs, so one pair must touch Latin text.
_LEAD_CONT["cp1256"] = re.compile(
    f"{_cont}(?:(?<={_lead}{_cont})(?={_lead}{_cont})|(?<=\u00e2{_cont})|(?<=[\u0622\u0623\u0625]{_cont})(?=[A-Za-z\u00c0-\u00ff\\s]))"
)


def _undo_utf8(text: str) -> str:
    """Undo one misreading, by the encoding that explains most characters."""
    best, most = text, 0
    for codec in MISREAD_AS:
        if not _LEAD_CONT[codec].search(text):
            continue
        explained = 0

        def put(m: re.Match, codec: str = codec) -> str:
            nonlocal explained
            plain = _decoded(m.group(), codec)
            if not _plausible(m.group(), plain, codec, m.string, *m.span()):
                return m.group()
            explained += m.end() - m.start()
            return plain

        new = automaton(codec).sub(put, text)
        if explained > most:
            best, most = new, explained
    return best


_ARABIC_WORD = re.compile(r"[ء-غف-ْ]+")
_ARABIC_PART = re.compile(r"[«(]?[ء-غف-ْ]+[،؛؟»:.!)]*")
_BOXES = re.compile("[\u2500-\u25ff]")


@cache
def _swap(read_as: str, meant: str) -> dict[int, str]:
    return {c: bytes([b]).decode(meant, "replace") for c, b in to_byte(read_as).items()}


@cache
def _high_run(codec: str) -> re.Pattern:
    return re.compile(_class(to_byte(codec), 0x80, 0xFF) + "{3,}+")


def _swapped_arabic(text: str, read_as: str) -> str | None:
    """The text if its lines hold Arabic of cp1256 that was read as ``read_as``."""
    if _BOXES.search(text):
        return None
    table = _swap(read_as, "cp1256")
    whole, letters = 0, set()
    for run in _high_run(read_as).findall(text):
        plain = run.translate(table)
        if _ARABIC_PART.fullmatch(plain) and len(_ARABIC_WORD.search(plain + "ا").group()) >= 3:
            whole += 1 + (plain.startswith("ال") and len(plain) > 3)
            letters.update(plain)
    if whole < 2 or len(letters) < 5:
        return None
    lines = []
    for line in text.split("\n"):
        plain = line.translate(table)
        before = sum(1 for ch in line if "ء" <= ch <= "ي")
        after = sum(1 for ch in plain if "ء" <= ch <= "ي")
        ascii_letters = sum(1 for ch in line if ch.isascii() and ch.isalpha())
        lines.append(plain if not before and after > ascii_letters else line)
    new = "\n".join(lines)
    return new if new != text else None


#: What no author writes: in text read as Mac Roman a capital or symbol inside a
#: word or quotes that became letters, in text read as cp1256 Arabic in Latin words.
_MAC_ODD = re.compile(
    "[\u00c0-\u00de\u2021\u2030\u00b8\u02d8\u02d9\u02da\u02dc\u02c6\u02c7\u2202\u00b7\u00ec\u00eb\u00ee\u00f8\u00b0](?:"
    "(?<=[a-z\u00df-\u00ff][\u00c0-\u00de\u2021\u2030\u00b8\u02d8-\u02dc\u02c6\u02c7\u2202])(?=[a-z\\s.,;:!?])"
    "|(?<=[a-km-z]\u00b7)(?=[a-z])"
    "|(?<=[\\s(][\u00ec\u00eb\u00f8\u00b0])(?=[A-Z])|(?<![^\\n][\u00ec\u00eb\u00f8\u00b0])(?<=[\u00ec\u00eb\u00f8\u00b0])(?=[A-Z])"
    "|(?<=[.,?!\u00c9]\u00ee)(?=\\s|$)|(?<=[\u2021\u2030\u00b8\u02d8-\u02da])(?=[a-z]))"
)
_MAC_TURNED = re.compile("[A-Za-z\u00a1\u00ab\u00bb\u00bf-\u00ff\u0152\u0153\u2013-\u201e\u2022\u2026 \\s.,;:!?()'\"\\d\u00a0\u00a9|/_-]+")
_ARABIC_IN_LATIN = re.compile(
    "[\u061f\u0621-\u06ff](?:(?<=[\u0621-\u0627\u0629-\u0640\u064b-\u06ff])(?<![\u0600-\u06ff].)(?=[a-z])|(?<![^\\s]\u06c1)(?<=\u06c1)(?= [a-z])|(?<=[A-Za-z\u00c0-\u00ff].)[\u0621-\u06ff]*(?=[A-Za-z\u00c0-\u00ff])|(?<=\u061f)(?=[A-Z])"
    "|(?<=[a-z][a-z][\u0621-\u0652])(?=[ .,;:!?\\n]|$))"
)


def _swapped_latin(text: str, read_as: str) -> str | None:
    odd = _MAC_ODD if read_as == "mac_roman" else _ARABIC_IN_LATIN
    if not odd.search(text):
        return None
    table = _swap(read_as, "cp1252")
    changed = False
    lines = []
    for line in text.split("\n"):
        if odd.search(line):
            plain = line.translate(table)
            fine = _MAC_TURNED.fullmatch(plain) and not odd.search(plain)
            if fine and len(odd.findall(line)) >= 1:
                lines.append(plain)
                changed = True
                continue
        lines.append(line)
    return "\n".join(lines) if changed else None


def repair(text: str | None) -> tuple[bool, str | None, bool]:
    """(damaged, text as far as it can be restored, fully restored).

    Null and empty texts are undamaged. Letters an author may have meant, such as
    a lone accented capital, never make a case: a span must be well-formed as
    bytes and plausible as text. A replacement character left in a text marks
    damage that can't be undone.
    """
    if not text or text.isascii():
        return False, text, True
    new = _swapped_arabic(text, "cp1252") or _swapped_arabic(text, "mac_roman") or text
    if new == text:
        for _ in range(ROUNDS):
            last = new
            new = _undo_utf8(new)
            if new == last:
                break
    if new == text:
        new = _swapped_latin(text, "mac_roman") or _swapped_latin(text, "cp1256") or text
    damaged = new != text or REPLACEMENT in text
    return damaged, new, REPLACEMENT not in new


def damaged_fields(df: DataFrame, key: str, field: str, table: str) -> DataFrame:
    """``src_table``, ``row_id``, ``field``, ``restored``, ``complete`` of the
    damaged values of one column; undamaged, empty and null values give no row."""

    def make() -> Callable:
        def run(cols: dict[str, list]) -> dict[str, list]:
            ids, texts, complete = [], [], []
            for i, t in zip(cols["id"], cols["t"]):
                bad, new, ok = repair(t)
                if bad:
                    ids.append(i), texts.append(new), complete.append(ok)
            return {"row_id": ids, "restored": texts, "complete": complete}

        return run

    rows = df.select(F.col(key).alias("id"), F.col(field).alias("t")).where("t IS NOT NULL AND t <> ''")
    got = map_batches(rows, make, "row_id bigint, restored string, complete boolean")
    return got.select(F.lit(table).alias("src_table"), "row_id", F.lit(field).alias("field"), "restored", "complete")


def damaged_values(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """The damaged values of the titles and descriptions of works and the texts of
    chapters, with what could be restored."""
    return (
        damaged_fields(books, "book_id", "title", "books")
        .unionByName(damaged_fields(books, "book_id", "description", "books"))
        .unionByName(damaged_fields(chapters, "chapter_id", "plain_text", "chapters"))
    )
